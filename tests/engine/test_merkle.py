"""Merkle trees against plain hashing, and their differences against a plain comparison."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corrobora.operators import chunks, merkle


def made(spark, rows, fan):
    return merkle.tree(spark.createDataFrame(list(enumerate(rows)), "pos long, text string").repartition(3), F.sha2(F.coalesce("text", F.lit("")), 256), fan)


def plain(rows, fan):
    level = [hashlib.sha256((r or "").encode()).hexdigest() for r in rows]
    out = [(0, k, h) for k, h in enumerate(level)]
    k = 0
    while len(level) > fan:
        k += 1
        level = [hashlib.sha256("".join(level[a : a + fan]).encode()).hexdigest() for a in range(0, len(level), fan)]
        out += [(k, n, h) for n, h in enumerate(level)]
    return out


@pytest.mark.parametrize(("n", "fan"), [(0, 4), (1, 4), (4, 4), (5, 4), (64, 4), (65, 4), (300, 3)])
def test_nodes(spark, n, fan):
    rows = [f"row {k}" for k in range(n - 1)] + [None] * (n > 0)
    assert sorted(map(tuple, made(spark, rows, fan).collect())) == sorted(plain(rows, fan))


@pytest.mark.parametrize("seed", range(4))
def test_changes_are_those_of_all_rows(spark, seed):
    rng = random.Random(seed)
    one = [f"row {rng.randrange(5)}" for _ in range([70, 70, 3, 0][seed])]
    other = [x if rng.random() < 0.9 else "new" for x in one]
    other = [other + ["more"] * 30, other[:20], other + ["x"] * 90, ["a"] * 10][seed]
    trees = made(spark, one, 4), made(spark, other, 4)
    want = [(k, "added" if k >= len(one) else "removed" if k >= len(other) else "changed") for k in range(max(len(one), len(other))) if k >= len(one) or k >= len(other) or one[k] != other[k]]
    assert sorted(map(tuple, merkle.changes(*trees, 4).collect())) == want
    found = {(r.first, r["last"]): r.changed for r in merkle.ranges(*trees, 4).collect()}
    assert found == {(g * 4, g * 4 + 3): sum(k // 4 == g for k, _ in want) for g in {k // 4 for k, _ in want}}
    assert merkle.changes(trees[0], trees[0], 4).count() == 0


def test_only_what_differs_is_compared(spark):
    one = [f"r{k}" for k in range(64)]
    other = [*one[:40], "x", *one[41:]]
    assert [tuple(r) for r in merkle.changes(made(spark, one, 4), made(spark, other, 4), 4).collect()] == [(40, "changed")]


def test_the_identifier_of_an_index_takes_all_levels(spark, monkeypatch):
    rows = [(k, f"id{k}", "f", None, 0, 5, f"text {k}") for k in range(20)]
    kind = "pos long, id string, source_file string, page int, char_start int, char_end int, text string"
    found = lambda x: chunks.index_id(spark.createDataFrame(x, kind), "mock", 1200, 200).first().index_id
    line = lambda r: f'{{"char_end":5,"char_start":0,"id":"{r[1]}","page":null,"source_file":"f","text":"{r[6]}"}}'
    head = '{"chunk_params":{"overlap":200,"size":1200},"embedder_id":"mock"}'
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found(rows) == sha(head + sha("".join(sha(line(r)) for r in rows)))[:12]
    assert found(rows[:-1]) != found(rows) != found([*rows[:-1], (*rows[-1][:6], "other")])
