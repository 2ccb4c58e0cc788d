"""Chunks of long segments by blocks against the sequential ones."""

import random
import re

import numpy as np
import pytest

from corrobora.operators import chunks, long_chunks

SEGMENT = "doc_id long, page int, seg int, text string"


def drawn(rng, n, alphabet="ab.!? \n é🙂"):
    kind = rng.choice(["mixed", "words", "nospace"])
    if kind == "words":
        return " ".join("x" * rng.randint(1, 30) + rng.choice(["", "", ".", "?"]) for _ in range(n // 12 + 1))[:n]
    return "".join(rng.choice("ab" if kind == "nospace" else alphabet) for _ in range(n))


def by_blocks(text, size, overlap, length):
    """What the tasks do, one after another."""
    out, at = [], 0
    for block, a in enumerate(range(0, len(text), length)):
        piece = text[a : a + length + size + 1]
        inside = min(length, len(text) - a)
        exits = long_chunks.table(piece, block, length, len(text), size, overlap)
        end, after = long_chunks.following(piece, inside, a, len(text), size, overlap)
        first, here = at, at
        while here < a + inside:
            out.append((here, int(end[here - a])))
            here = int(after[here - a])
        if first < a + inside:
            assert exits[first - a] == here
            at = int(exits[first - a])
    return out


@pytest.mark.parametrize(("size", "overlap"), [(100, 0), (100, 99), (150, 20), (1200, 200), (121, 120)])
def test_blocks_are_the_sequence(size, overlap):
    rng = random.Random(size + overlap)
    for _ in range(12):
        text = drawn(rng, rng.choice([size + 1, 3 * size, 7 * size + 5, 40 * size]))
        if len(text) > size:
            for length in (16 * size, 17 * size + 3):
                assert by_blocks(text, size, overlap, length) == chunks.spans(text, size, overlap)


def test_segments(spark):
    rng = random.Random(4)
    rows = [(k, None if k % 2 else k, k % 3, drawn(rng, rng.choice([10, 900, 30_000, 90_000]))) for k in range(8)]
    rows += [(50, 1, 0, ""), (51, 1, 0, None), rows[3], (None, None, 1, "a b. " * 9000)]
    df = spark.createDataFrame(rows, SEGMENT)
    want = sorted(map(str, chunks.chunk(df, 500, 80).drop("ord").collect()))
    assert sorted(map(str, chunks.chunk(df, 500, 80, long=2000).drop("ord").collect())) == want
    assert sorted(map(str, chunks.chunk(df, 500, 80, long=0).drop("ord").collect())) == want
    assert chunks.chunk(df.limit(0), long=10).count() == 0


def test_one_very_long_segment(spark, tmp_path):
    """Forty million characters in one row, cut by tasks of a million each."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(7)
    words = np.array(["alpha", "be", "c.", "delta", "epsilon!", "of", "the", "long-windedness", "é?"])
    text = " ".join(words[rng.integers(0, len(words), 7_000_000)].tolist())[:40_000_000]
    pq.write_table(pa.table({"doc_id": [1], "page": pa.array([None], pa.int32()), "seg": pa.array([0], pa.int32()), "text": [text]}), tmp_path / "t.parquet")
    segments = spark.read.parquet(str(tmp_path / "t.parquet"))
    got = long_chunks.chunk_long(segments, 1200, 200).select("char_start", "char_end").toPandas().sort_values("char_start")
    want = chunks.spans(text)
    assert len(want) > 30_000 and list(zip(got.char_start.tolist(), got.char_end.tolist(), strict=True)) == want


def test_ways_and_tables_agree():
    rng = random.Random(9)
    for size, overlap in ((100, 0), (100, 99), (150, 20), (400, 90)):
        text = drawn(rng, 50 * size)
        for block, a in enumerate(range(0, len(text), 16 * size)):
            piece = text[a : a + 17 * size + 1]
            walked, tabled = (long_chunks.walks(piece, block, 16 * size, len(text), size, overlap, most) for most in (1 << 30, 0))
            for one, other in zip(walked, tabled, strict=True):
                assert one.tolist() == other.tolist()


def joined_rows(rng):
    """Sources of texts that meet in line feeds of all numbers, one without identifiers in part, some blank."""
    ends = ["", "", "\n", "\n\n", "\n\n\n\n", " \n", "\n \t", "﻿"]
    rows = [("a", k, rng.choice(ends) + drawn(rng, rng.choice([0, 0, 3, 40, 700, 4000])) + rng.choice(ends)) for k in range(120)]
    rows += [(None, k, rng.choice(ends) + "x. y") for k in range(500, 530)] + [("blank", k, rng.choice(["\n", " ", None, ""])) for k in range(600, 620)]
    rows += [("b", 700, "﻿one"), ("b", None, "\nlast\n\n\n"), ("none", None, "\n\n\nonly\n"), ("feeds first", 800, None), ("feeds first", 801, "\n\n"), ("feeds first", 802, "\nx" * 90), ("feeds first", 803, "\n"), ("feeds first", 804, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "overlap", "fan"), [(100, 30, 2), (100, 30, 1024), (120, 119, 3)])
def test_joined_texts(spark, monkeypatch, size, overlap, fan):
    """Against the joined text as one string, whatever partitions, blocks and levels of tables it is dealt over."""
    monkeypatch.setattr(long_chunks, "FAN", fan)
    rows = joined_rows(random.Random(size + fan))
    want = []
    for source in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == source), key=lambda r: (r[1] is None, r[1]))
        text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t\f\x0b]+", " ", "\n".join(r[2] or "" for r in own)))
        if re.search(long_chunks._SOLID, text):
            want += [(own[0][1], k, a, z, text[a:z]) for k, (a, z) in enumerate(chunks.spans(text, size, overlap))]
    got = long_chunks.chunk_joined(spark.createDataFrame(rows, "source string, doc_id long, text string").repartition(3), size, overlap, 1600)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_no_value_is_a_source_and_sql_agrees(spark, monkeypatch, tmp_path):
    """Three million characters of a source are nowhere in one value; the result is the SQL's, with its order of nulls."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from corrobora.plans import catalogue

    rng = random.Random(11)
    texts = [drawn(rng, 30_000) + "\n" * (k % 4) for k in range(100)]
    ids = [*range(99), None]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": ["﻿" + texts[0], *texts[1:]], "lang": ["en"] * 100, "source": ["one"] * 100}), tmp_path / "documents.parquet")
    stored, real = [], long_chunks.written

    def spied(df):
        stored.append(real(df))
        if "text" in df.columns:
            longest = stored[-1].selectExpr("max(length(text))").first()[0]
            assert longest < 1_200_000
        return stored[-1]

    monkeypatch.setattr(long_chunks, "written", spied)
    got = catalogue.QUERIES["x1_long_chunks"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    found = con.execute(catalogue.ORACLES["x1_long_chunks"])
    columns = [d[0] for d in found.description]
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, found.fetchall()))
