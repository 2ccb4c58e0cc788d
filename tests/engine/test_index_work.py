"""The embedder keeps few tokens, the index's chunks are cut once, and queries that nothing is pruned for are scored together."""

import numpy as np
import pyarrow as pa

from corrobora.operators import pruned, vectors
from corrobora.plans import catalogue


def test_the_embedder_keeps_few_tokens():
    model = vectors.HashEmbedder()
    for a in range(0, vectors.KNOWN + 5000, 1000):
        text = " ".join(f"tok{a + k}" for k in range(1000))
        counts = model.counts(text)
        assert counts.dtype == np.float32 and np.abs(counts).sum() <= 1000
    assert len(model.known) <= vectors.KNOWN
    assert vectors.HashEmbedder().counts("ab cd").sum() == 0 and np.abs(vectors.HashEmbedder().counts("One one ONE")).max() == 3


def test_chunks_are_cut_once(spark):
    made = catalogue._chunked(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in made._jdf.queryExecution().executedPlan().toString()


def test_queries_scored_together_find_the_same():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(700, 12)), 1).astype(np.float32)
    _, place, dim, counts, rows, vals = next(pruned._segments(pa.array(range(700)), x, 4096))
    segment = pruned.Segment(*(pruned._pack(a) if isinstance(a, np.ndarray) else a for a in (place, dim, counts, rows, vals)))
    q = np.round(rng.normal(size=(9, 12)), 1)
    least = np.array([-np.inf, -50.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 99.0])
    assert ((segment.possible(q, least) > 0) >= ((q @ segment.values[:, : segment.n]).max(1) >= least)).all()
    for own, low, (rows, scores, seen) in zip(q, least, segment.all_best(q, 6, least), strict=True):
        dims = np.flatnonzero(own)
        want = segment.best(dims, own[dims], 6, low)
        assert rows.tolist() == want[0].tolist() and scores.tolist() == want[1].tolist() and seen == 700
