import base64
import random

import numpy as np
import pytest
import tiktoken

from trackloom.llm.byte_bpe import PATTERN, VOCABULARY, Encoder, encode, line_pieces, merges, token_counts

SCHEMA = "doc_id long, text string, ids string, n_tokens int"


@pytest.fixture(scope="module")
def public():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_document_as_the_public_encoder(spark, data, public):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.ids for r in encode(docs).collect()}
    assert got.keys() == texts.keys()
    assert all(got[i] == public.encode_ordinary(t or "") for i, t in texts.items())
    assert {r.doc_id: r.n_tokens for r in token_counts(docs).collect()} == {i: len(x) for i, x in got.items()}


def test_odd_texts(public):
    random.seed(3)
    letters = " \n\r\tab1'é². 　\x1c\x1f\x85あ​😀<|endoftext|>"
    odd = ["".join(random.choices(letters, k=random.randint(1, 40))) for _ in range(3000)]
    odd += ["a" * 5000, "é" * 3000, "=" * 999, "it's\n's 'll", " \n \r\n\r\n x\n\n", "x \n\ny", "<|endoftext|>", "\n", "0123456789" * 40]
    for text, ids in zip(odd, Encoder(VOCABULARY).encode(odd)):
        assert np.frombuffer(ids, np.int32).tolist() == public.encode_ordinary(text), ascii(text)
        assert "".join(line_pieces(text)) == text


def test_small_tables_are_emptied_and_refilled(public):
    small = Encoder(VOCABULARY, kept=3)
    for text in ["one two three four", "five six seven eight", "one two", ""]:
        assert np.frombuffer(small.encode([text])[0], np.int32).tolist() == public.encode_ordinary(text)


def test_rank_arrays_and_heap_agree():
    m = merges(VOCABULARY)
    words = [bytes(random.Random(i).choices(b"abcdeTHE thing\xc3\xa9", k=i % 48 + 1)) for i in range(500)]
    assert [np.frombuffer(x, np.int32).tolist() for x in m.encode_words(words)] == [m.encode_long(w) for w in words]
    assert m.encode_words([b"", b"a"])[0] == b""


def test_null_empty_long_repeated_and_clashing(spark, public):
    long = "word soup é\n" * 100_000
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, long, "x", 1), (4, "hi", "x", 1), (4, "hi", "x", 1), (None, "hi", "x", 1)]
    got = sorted(((r.doc_id, r.ids) for r in encode(spark.createDataFrame(rows, SCHEMA)).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    hi = public.encode_ordinary("hi")
    assert [x for i, x in got if i != 3] == [[], [], hi, hi, hi]
    assert got[2][1] == public.encode_ordinary(long)
    assert encode(spark.createDataFrame([], SCHEMA)).collect() == []
