"""Text, number and hash functions against stated values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corrobora.functions import hashing as H
from corrobora.functions import numbers as N
from corrobora.functions import text as T
from corrobora.operators import chunks, report


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("v")).first().v


def test_normalisers(spark):
    assert one(spark, T.norm_for_chunks("t"), t="a \t\f b\n\n\n\nc\r") == "a b\n\nc\r"
    assert one(spark, T.slug("t"), t="a b/é.md") == "a_b_.md"
    df = spark.createDataFrame([(1, "  “It’s” — A  B﻿ "), (2, "é"), (3, "m²"), (4, None)], "k int, t string")
    got = {r.k: r.n for r in T.with_norm(df, "t", "n").collect()}
    assert got == {1: '"it\'s" - a b', 2: "é", 3: "m²", 4: ""}


def test_words_and_sentences(spark):
    assert one(spark, T.tokens("t"), t="The log-file is OK, log2") == ["the", "log", "file", "log2"]
    assert one(spark, T.keywords("t"), t="That risk policy and Risk from data") == ["risk", "policy", "data"]
    assert one(spark, T.sentences("t"), t=" One.  Two! x? Three ") == ["One.", "Two!", "x?", "Three"]
    assert one(spark, T.substantive("t"), t="the the the the the the") is True
    assert one(spark, T.substantive("t"), t="a. 12345678901234567890") is False
    assert one(spark, T.is_intent("t"), t="We MUST do") is True
    assert one(spark, T.is_operational("t"), t="listless") is False


@pytest.mark.parametrize("value,want", [("a,b", '"a,b"'), ('q"q', '"q""q"'), ("l\nl", '"l\nl"'), ("=SUM(A1:A2)", "'=SUM(A1:A2)"), ("+1", "'+1"), ("@c", "'@c"), ("-2", "'-2"), ("plain", "plain"), (None, "")])
def test_csv(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(T.csv_field("v").alias("o")).first().o == want


def test_csv_document():
    assert report.csv_document(["1,2"], ["a", "b"]) == "﻿a,b\r\n1,2\r\n"


def test_labels(spark):
    assert one(spark, T.truncated("t", 5), t="abc  def") == "abc…"
    assert one(spark, T.location(F.lit("f"), F.lit(0))) == "f"
    assert one(spark, T.location(F.lit("f"), F.lit(3))) == "f, p.3"


def test_numbers(spark):
    assert one(spark, N.half_up(F.lit(0.575), 2)) == 0.57
    assert one(spark, N.percent(F.lit(1), F.lit(8))) == 13
    assert one(spark, N.percent(F.lit(0), F.lit(0))) == 0
    assert [one(spark, N.clamp_int(F.lit(x), 0, 9)) for x in (-3.7, 4.9, 99.0, float("nan"))] == [0, 4, 9, 0]
    assert one(spark, N.level(F.lit("full"))) == 3 and one(spark, N.level(F.lit("odd"))) == 0
    assert one(spark, N.l2_normalised(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8], abs=1e-7)
    assert one(spark, N.l2_normalised(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def test_hashes(spark):
    assert one(spark, H.fnv1a(F.lit("inventory"))) == 4244489279 == H.fnv1a_of("inventory")
    none = F.array().cast("array<struct<source_file:string,quote:string>>")
    assert one(spark, H.assessment_hash(F.lit("none"), none)) == "cc98bcab3632"
    assert one(spark, H.assessment_hash(F.lit("none"), F.lit(None).cast("array<struct<source_file:string,quote:string>>"))) == "cc98bcab3632"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n!", max_size=900), st.integers(0, 400), st.integers(0, 500))
def test_chunks_cover_the_text(text, size, overlap):
    found = chunks.spans(text, size, overlap)
    limit = max(100, size)
    assert found[0][0] == 0 and found[-1][1] == len(text)
    for (a, b), (c, d) in zip(found, found[1:], strict=False):
        assert a < c <= b < d
    assert all(b - a <= limit for a, b in found)


def test_chunk_rows(spark):
    segments = spark.createDataFrame([(1, 1, 0, "Page one text."), (1, None, 1, "  \n "), (1, 2, 2, "Page two text."), (2, None, 0, "x" * 500)], "doc_id long, page int, seg int, text string")
    rows = sorted((r.doc_id, r.ord, r.page, r.char_start, r.char_end) for r in chunks.chunk(segments, 100, 999).collect())
    assert rows[:2] == [(1, 0, 1, 0, 14), (1, 1, 2, 0, 14)]
    assert rows[-1][4] == 500
