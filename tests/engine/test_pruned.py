"""Pruned top-k against the full scan, and that its bounds hold."""

import random

import numpy as np
import pytest

from corrobora.operators import pruned, vectors


def both(spark, rows, asked, k, kind="long"):
    table = spark.createDataFrame(rows, f"id {kind}, vector array<float>").repartition(3)
    queries = spark.createDataFrame(asked, "qid long, vector array<float>")
    index = pruned.build(table)
    full = sorted(map(tuple, vectors.top_k(table, queries, k).collect()))
    assert sorted(map(tuple, pruned.search(index, queries, k).collect())) == full
    return {r.qid: (r.pairs, r.scored) for r in pruned.work(index, queries, k).collect()}, full


def sparse(rng, n, dim, some):
    out = []
    for _ in range(n):
        v = [0.0] * dim
        for _ in range(some):
            v[rng.randrange(dim)] += rng.choice([-1.0, 1.0])
        out.append(vectors.unit(np.array(v, np.float32)).tolist())
    return out


@pytest.mark.parametrize("k", [1, 6, 40])
def test_it_is_the_full_scan(spark, monkeypatch, k):
    monkeypatch.setattr(pruned, "SEGMENT", 128)
    rng = random.Random(k)
    rows = sparse(rng, 500, 64, 8)
    rows += [rng.choice(rows) for _ in range(120)] + [[0.0] * 64]
    work, full = both(spark, [*enumerate(rows), (9999, None)], [*enumerate(sparse(rng, 15, 64, 4)), (77, [0.0] * 64), (78, None)], k)
    assert len(full) == 16 * k and all(pairs == 621 and 0 < scored <= 621 for pairs, scored in work.values())


def test_text_identifiers_tie_in_the_locales_order(spark):
    rows = [(i, [1.0, 0.0]) for i in ("B", "a", "C", "b", "A", "_x", "é")] + [("z", [0.9, 0.1])]
    for k in range(1, 9):
        both(spark, rows, [(1, [3.0, 0.0]), (2, [-1.0, 0.5])], k, "string")


def test_groups_of_like_rows_are_skipped(spark):
    """Families around centres: a query near one of them scores few rows of the others."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32))
    rows = [(i, (centres[i % 60] + 0.1 * rng.normal(size=32)).astype(np.float32).tolist()) for i in range(3000)]
    work, _ = both(spark, rows, [(q, centres[q].tolist()) for q in range(10)], 6)
    assert sum(s for _, s in work.values()) < 0.5 * sum(p for p, _ in work.values())


def test_edges(spark):
    empty = spark.createDataFrame([], "id long, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0])], "qid long, vector array<float>")
    assert pruned.search(pruned.build(empty), asked).count() == 0
    index = pruned.build(spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<float>"))
    assert pruned.search(index, asked.limit(0)).count() == pruned.search(index, asked.where("qid > 1")).count() == 0
    assert pruned.search(index, spark.createDataFrame([(1, [1.0, 1.0])], "qid long, vector array<float>"), 0).count() == 0
    with pytest.raises(Exception, match="another embedder"):
        pruned.search(index, asked).collect()


def test_bounds_and_order():
    rng = np.random.default_rng(5)
    for n in (1, 7, 8, 9, 300):
        v = np.where(rng.random((n, 20)) < 0.3, rng.normal(size=(n, 20)), 0).astype(np.float32)
        order = pruned.neighbours(v)
        assert sorted(order.tolist()) == list(range(n))
        (ids, place, dim, counts, rows, values), = pruned._segments(pruned.pa.array(range(n)), v, 4096)
        segment = pruned.Segment(*(pruned._pack(x) if isinstance(x, np.ndarray) else x for x in (place, dim, counts, rows, values)))
        q = rng.normal(size=20)
        bound = np.repeat(segment.bounds(np.arange(20), q), pruned.LEAF)[:n]
        assert (bound >= v[ids.to_numpy()].astype(float) @ q - 1e-9).all()
