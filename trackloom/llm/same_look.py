"""Visually identical text with different characters, brought to one consistent form.

Stretches of text that hold anything but plain ASCII ("runs", each with the visible ASCII character before
it, as marks may compose with that) are exploded to positioned code points. A broadcast table of
decompositions replaces composed letters, ligatures, full-width forms, blanks and marks without ink; a
broadcast table of look-alikes replaces letters that cannot be told from a Latin one. Combining marks are put
in the order of their classes, runs recomposed, and the texts rebuilt. Both tables are bounded by Unicode.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.session import written

RUN = r"[!-~]?[^\t\n\r -~]+"

# Letters of other scripts and blocks that are drawn like a Latin letter, by that letter.
LOOK_ALIKES = {
    "A": "ΑАᎪꓮ",
    "B": "ΒВᏴꓐ",
    "C": "СϹᏟꓚⲤ",
    "D": "ᎠꓓⅮ",
    "E": "ΕЕᎬꓰ",
    "F": "Ϝꓝ",
    "G": "ԌᏀꓖ",
    "H": "ΗНᎻꓧ",
    "I": "ΙІӀꓲ",
    "J": "ЈᎫꓙͿ",
    "K": "ΚКᏦꓗⲔ",
    "L": "Ꮮꓡ",
    "M": "ΜМᎷꓟⲘ",
    "N": "ΝꓠⲚ",
    "O": "ΟОꓳⲞՕ",
    "P": "ΡРᏢꓑⲢ",
    "Q": "Ԛ",
    "R": "Ꭱꓣ",
    "S": "ЅᏚꓢՏ",
    "T": "ΤТᎢꓔⲦ",
    "U": "ꓴ",
    "V": "Ꮩꓦ",
    "W": "ԜᎳꓪ",
    "X": "ΧХꓫⲬ",
    "Y": "ΥҮꓬⲨ",
    "Z": "ΖᏃꓜ",
    "a": "а",
    "c": "сϲⲥ",
    "d": "ԁ",
    "e": "е",
    "g": "ɡ",
    "h": "һ",
    "i": "і",
    "j": "јϳ",
    "l": "ӏ",
    "o": "оοօⲟ",
    "p": "рⲣ",
    "q": "ԛ",
    "s": "ѕ",
    "w": "ԝ",
    "x": "х",
    "y": "у",
}

# Marks and fillers without ink that Unicode does not class as format characters.
NO_INK = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x2065, 0x3164, 0xFFA0]


_LATIN = frozenset("".join(LOOK_ALIKES.values()))


def _no_ink(c: int, kind: str) -> bool:
    return kind in ("Cf", "Cc") or c in NO_INK or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF


def _parts(ch: str) -> str:
    """The character as its parts: canonical ones always; compatible ones only where they look the same,
    that is width, font and line-break variants, and letters or letter-like numerals written as letters."""
    kind, c = unicodedata.category(ch), ord(ch)
    if ch in _LATIN:
        return ch
    if _no_ink(c, kind):
        return ""
    if kind == "Zs" and c != 0x1680:  # the ogham space has ink
        return " "
    if kind in ("Zl", "Zp"):
        return "\n"
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if not tag:
        return ch
    if not tag.startswith("<"):
        return unicodedata.normalize("NFD", ch) if unicodedata.normalize("NFD", ch) == ch else "".join(map(_parts, unicodedata.normalize("NFD", ch)))
    to = "".join(chr(int(x, 16)) for x in rest.split())
    letters = all(unicodedata.category(x)[0] == "L" for x in to)
    if tag in ("<wide>", "<narrow>", "<noBreak>", "<font>") or (tag in ("<compat>", "<initial>", "<medial>", "<final>", "<isolated>") and letters):
        return "".join(map(_parts, to))
    return ch


def decompositions() -> list[tuple[str, list[tuple[str, int]]]]:
    """(character, parts with combining class) for every character that is not a single starter part."""
    rows = []
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if 0x20 <= c < 0x7F or ch in "\t\n\r" or unicodedata.category(ch) in ("Cs", "Cn", "Co"):
            continue
        # precomposed Hangul is algorithmic
        parts = unicodedata.normalize("NFD", ch) if 0xAC00 <= c <= 0xD7A3 else _parts(ch)
        classed = [(p, unicodedata.combining(p)) for p in parts]
        if classed != [(ch, 0)]:
            rows.append((ch, classed))
    return rows


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    part = T.StructType([T.StructField("part", T.StringType()), T.StructField("mark_class", T.IntegerType())])
    kind = T.StructType([T.StructField("ch", T.StringType()), T.StructField("parts", T.ArrayType(part))])
    looks = [(other, latin) for latin, others in LOOK_ALIKES.items() for other in others]
    return (
        F.broadcast(spark.createDataFrame(decompositions(), kind).coalesce(1)),
        F.broadcast(spark.createDataFrame(looks, "part string, latin string").dropDuplicates(["part"]).coalesce(1)),
    )


@F.pandas_udf(T.StringType())
def _recompose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def run_forms(runs: DataFrame) -> DataFrame:
    """(run, form) for distinct runs; runs without any ink have the form ''."""
    parts, looks = _tables(runs.sparkSession)
    points = runs.select("run", F.posexplode(F.regexp_extract_all("run", F.lit("(?s)."), F.lit(0))).alias("at", "ch"))
    inner = (
        points.join(parts, "ch", "left")
        .select(
            "run",
            "at",
            F.posexplode(F.coalesce("parts", F.array(F.struct(F.col("ch").alias("part"), F.lit(0).alias("mark_class"))))).alias("sub", "p"),
        )
        .select("run", "at", "sub", "p.part", "p.mark_class")
        .join(looks, "part", "left")
        .withColumn("ch", F.coalesce("latin", "part"))
    )
    # a starter begins a stretch; in it marks are ordered by class, marks of one class as they stand
    along = Window.partitionBy("run").orderBy("at", "sub")
    ordered = inner.withColumn("stretch", F.sum(F.when(F.col("mark_class") == 0, 1).otherwise(0)).over(along))
    rebuilt = ordered.groupBy("run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "mark_class", "at", "sub", "ch"))), lambda x: x.ch), "").alias("form")
    )
    return rebuilt.withColumn("form", _recompose("form"))


def consistent_form(docs: DataFrame) -> DataFrame:
    """docs with two more columns: form, the consistent form of the whole text, and text_key, a 128-bit
    digest of the text as it stands.

    docs: text and any other columns but form, text_key, pieces, forms. Null text gives null form and key;
    empty text gives ''. Line ends \\r\\n and \\r count as \\n. Every row is kept, repeated ones included: equal
    texts share their runs by text_key. An empty table gives an empty result.

    Distinct runs, not occurrences, go through the code-point tables. Runs meet their forms, and texts
    their runs, in two shuffles; a run or text that makes up much of the corpus is combined map-side.
    """
    lines = F.regexp_replace("text", "\r\n?", "\n")
    mixed = F.coalesce(F.col("text").rlike(r"[^\t\n\r -~]"), F.lit(False))
    keyed = docs.withColumn("text_key", F.md5("text"))
    occurring = (
        keyed.where(mixed)
        .select("text_key", F.posexplode(F.regexp_extract_all(lines, F.lit(RUN), F.lit(0))).alias("place", "run"))
    )
    forms = written(run_forms(occurring.select("run").distinct()))
    by_text = (
        occurring.join(forms, "run", "left")
        .groupBy("text_key")
        .agg(F.array_sort(F.collect_set(F.struct("place", F.coalesce("form", F.lit("")).alias("form")))).alias("forms"))
    )
    whole = F.array_join(F.zip_with(F.split(lines, RUN, -1), "forms.form", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    # plain texts stay where they are
    plain = keyed.where(~mixed).withColumn("form", lines)
    return keyed.where(mixed).join(by_text.hint("merge"), "text_key", "left").withColumn("form", whole).select(*plain.columns).unionByName(plain)


def same_look_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, texts): for every document the smallest doc_id of those that look the same, and how many
    different texts look so. Null and empty texts are classes of their own (class_id null); null doc_ids are left
    out. One row per document, however large a class is: its members only meet the one row of their class."""
    own = docs.select("doc_id", "text").where("doc_id is not null")
    keys = written(consistent_form(own.where("text <> ''")).select("doc_id", "text_key", F.md5("form").alias("form_key")))
    texts = keys.groupBy("form_key", "text_key").agg(F.min("doc_id").alias("doc_id"))
    classes = texts.groupBy("form_key").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("texts"))
    found = keys.join(classes.hint("merge"), "form_key").select("doc_id", "class_id", "texts")
    none = own.where("text is null or text = ''").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("texts"))
    return found.unionByName(none)


def same_look_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), doc_id_a < doc_id_b: documents with non-empty texts that differ in characters but
    have one form. Null doc_ids form no pairs. Texts and forms are compared by 128-bit digests.

    Copies with equal characters are no pairs; a form of which there is only one text leaves before the
    pairs are made, so the join is over the groups that have a case.
    """
    keys = written(
        consistent_form(docs.select("doc_id", "text").where("doc_id is not null and text <> ''")).select("doc_id", "text_key", F.md5("form").alias("form_key"))
    )
    shared = keys.groupBy("form_key").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a <> b").select("form_key")
    own = written(keys.join(shared.hint("merge"), "form_key"))
    a, b = (own.select("form_key", F.col("doc_id").alias(f"doc_id_{x}"), F.col("text_key").alias(f"key_{x}")) for x in "ab")
    return a.join(b, "form_key").where("doc_id_a < doc_id_b and key_a <> key_b").select("doc_id_a", "doc_id_b").distinct()
