"""Hard negatives against all inner products, the bounds against exact scores, and odd rows."""

import math
import random

import numpy as np
import pytest

from corrobora.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score long, part string"


def usable(rows):
    for k, v, label in rows:
        if None not in (k, v, label) and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * float(np.float32(x))) for x in v]
            if sum(x * x for x in q) <= 2**62:
                yield k, q, label


def plain(rows, anchors, positives=5, negatives=5, percent=80):
    rows, out = list(usable(rows)), []
    for a, x, label in usable(anchors):
        scored = sorted((-sum(p * q for p, q in zip(x, v, strict=True)), k, other == label) for k, v, other in rows if k != a and len(v) == len(x))
        for p, pid in [(-s, k) for s, k, same in scored if same][:positives]:
            found = [(-s, k) for s, k, same in scored if not same and percent * p <= -100 * s <= 100 * p][:negatives]
            out.extend((a, pid, i + 1, k, p, s) for i, (s, k) in enumerate(found))
    return sorted(out)


def got(spark, rows, anchors, **kw):
    tables = [spark.createDataFrame([(*r, 1, "x") for r in x], SCHEMA).repartition(3) for x in (rows, anchors)]
    return sorted(tuple(r) for r in H.hard_negatives(*tables, **kw).collect())


def drawn(rnd, n, dim, spread=0.4):
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    return [(i, unit([x + rnd.gauss(0, 1) * spread for x in rnd.choice(centres)]), rnd.randrange(3)) for i in range(n)]


@pytest.mark.parametrize(("dim", "bits", "seed"), [(8, 6, 1), (3, 2, 2), (16, 4, 3), (1, 6, 4), (5, 9, 5)])
def test_bounds_hold(dim, bits, seed):
    rng = np.random.default_rng(seed)
    x, anchors = rng.integers(-300, 300, (200, dim)), rng.integers(-300, 300, (20, dim))
    code, low, width = H.cells(x, bits)
    least, more = H.lower_bounds(code, low, width, anchors, bits)
    exact = x @ anchors.T
    assert code.max() < 1 << bits and (least <= exact).all() and (exact <= least + more).all()


@pytest.mark.parametrize("bits", [6, 2, 10])
def test_it_is_all_inner_products(spark, monkeypatch, bits):
    monkeypatch.setattr(H, "ROWS", 37)
    monkeypatch.setattr(H, "ANCHORS", 5)
    rows = drawn(random.Random(bits), 400, 8)
    anchors = [r for r in rows if r[0] % 10 == 0]
    assert got(spark, rows, anchors, bits=bits) == plain(rows, anchors) != []
    assert got(spark, rows, anchors, bits=bits, positives=2, negatives=9, percent=50) == plain(rows, anchors, 2, 9, 50)


def test_passes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "PASS", 1)
    monkeypatch.setattr(H, "BLOCK", 640)
    rows = drawn(random.Random(8), 120, 8)
    anchors = rows[::5]
    assert got(spark, rows, anchors) == plain(rows, anchors) != []


def test_one_vector_has_a_third_of_all_rows(spark):
    rows = drawn(random.Random(9), 200, 4)
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(100)]
    anchors = [r for r in rows if r[0] % 50 == 0]
    assert got(spark, rows, anchors) == plain(rows, anchors)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (2, [0.9, 0.5], 2), (3, None, 1), (4, [1.0, None], 1), (5, [inf, 1.0], 1), (6, [nan, 1.0], 2), (7, [1.0, 1.0], None)]
    rows += [(None, [1.0, 1.0], 1), (8, [], 1), (9, [], 1), (10, [], 2), (11, [1.0], 1), (12, [3e38, 1.0], 1), (0, [0.8, 0.5], 2), (0, [0.9, 0.4], 1), (13, [-1.0, -0.5], 2), (14, [8e6, 8e6], 1), (15, [6e6, 6e6], 2)]
    assert got(spark, rows, rows) == plain(rows, rows) != []
    assert got(spark, rows, []) == got(spark, [], rows) == got(spark, [], []) == []
    assert got(spark, [(0, [-1.0], 1), (1, [1.0], 1), (2, [1.0], 2)], [(0, [-1.0], 1)]) == []


def test_whole_numbers_of_32_bit_components(spark):
    # floor goes down, and the product is made in doubles.
    rows = [(0, [-0.001, 0.1], 0), (1, [0.99999, -0.0039], 0), (2, [0.5, 0.3], 1), (3, [0.7, -0.9], 1)]
    assert got(spark, rows, rows, percent=-900) == plain(rows, rows, percent=-900)
