import unicodedata

from trackloom.llm.same_look import LOOK_ALIKES, consistent_form, decompositions, same_look_pairs

SCHEMA = "doc_id long, text string, run string, ch string"
TO = {o: k for k, v in LOOK_ALIKES.items() for o in v}
PARTS = dict(decompositions())


def brute(text):
    """One character at a time."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    parts = "".join("".join(p for p, _ in PARTS[c]) if c in PARTS else c for c in text)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", "".join(TO.get(c, c) for c in parts)))


def forms(spark, texts):
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r.form for r in consistent_form(df.select("doc_id", "text")).collect()}


def test_forms(spark):
    cases = {
        "Ｆｕｌｌ－ｗｉｄｔｈ！": "Full-width!", "é": "é", "é": "é", "a​b­c﻿": "abc", "a b　c d": "a b c d", "ﬁne ﬂow": "fine flow", "раypаl ЅОЅ": "paypal SOS", "Ⅻ ⅸ": "XII ix",
        "e​́": "é", "ậ": "ậ", "ậ": "ậ", "x²": "x²", "ªº™…½": "ªº™…½", "ё": "ë", "K": "K", "​": "", "a\r\nb\rc\n": "a\nb\nc\n", "️x": "x", "が": "が", "が": "が", "한": "한", "한": "한", "𝐀𝑏": "Ab", "😀é": "😀é", "": "", "ϲ": "c", "a\tb": "a\tb",
    }
    got = forms(spark, list(cases))
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_whole_documents_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.text, r.form) for r in consistent_form(docs).collect()}
    assert all(f == (brute(t) if t is not None else None) for t, f in got.values())
    groups = {}
    for i, (t, _) in got.items():
        if t:
            groups.setdefault(brute(t), []).append(i)
    want = {(a, b) for ids in groups.values() for a in ids for b in ids if a < b and got[a][0] != got[b][0]}
    assert {tuple(r) for r in same_look_pairs(docs).collect()} == want


def test_pairs_nulls_copies_and_empty(spark):
    rows = [(1, "pаypal"), (2, "paypal"), (3, "paypal"), (4, "раураl"), (5, "PAYPAL"), (6, None), (7, None), (8, ""), (9, "​"), (None, "paypa​l"), (2, "paypal"), (10, "x" * 200_000 + "é"), (11, "x" * 200_000 + "é")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in same_look_pairs(df).collect())
    assert got == [(1, 2), (1, 3), (1, 4), (2, 4), (3, 4), (10, 11)]
    assert same_look_pairs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_visible_ascii_is_never_changed():
    plain = {chr(c) for c in range(0x20, 0x7F)}
    assert not plain & (PARTS.keys() | TO.keys()) and set(LOOK_ALIKES) <= plain


def test_classes_hold_every_document_once(spark):
    from trackloom.llm.same_look import same_look_classes

    rows = [(1, "abc"), (2, "\uff41bc"), (3, "abc"), (4, "abd"), (5, None), (6, ""), (7, "\uff41bc"), (None, "abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.texts) for r in same_look_classes(docs).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 7: (1, 2), 4: (4, 1), 5: (None, None), 6: (None, None)}
    assert same_look_classes(docs.where("false")).collect() == []
