"""The quality classifier on documents it has not seen."""

import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from corrobora.llm.quality import CHUNK, FILTERS, INPUT, LAGS, STEP, STRIDE, WIDTH, Network, chunks, classify, echo, keep_good, train


def rows(seed, size):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 8)))
    out = []
    for k in range(size):
        good = rng.random() < 0.7
        words = [word() for _ in range(rng.randint(5, 300))]
        text = " ".join(words) if good else rng.choice([" | ".join(words), "!! ".join(words).upper(), " ".join(w for w in words[:20] for _ in range(12))])
        out.append((k, text, int(good)))
    return out


def test_held_out_accuracy(spark):
    data = rows(1, 500)
    docs = spark.createDataFrame([(k, t, "en") for k, t, _ in data] + [(None, None, "x"), (1000, "", "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y, 0) for k, _, y in data] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = classify(docs, labels).collect()
    assert len(got) == 502
    truth = {k: y for k, _, y in data}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    net = train(docs, labels)
    kept = keep_good(docs, net)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    data = rows(2, 80)
    docs = spark.createDataFrame([(k, t) for k, t, _ in data], "doc_id long, text string")
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    a = spark.createDataFrame([(k, y) for k, _, y in data], "doc_id long, quality int")
    b = spark.createDataFrame([(k, 1 - y if held(k) else y) for k, _, y in data], "doc_id long, quality int")
    assert sorted(map(tuple, classify(docs, a).collect())) == sorted(map(tuple, classify(docs, b).collect()))


def test_few_or_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert classify(docs, none).first().score == 0.5
    assert classify(docs.limit(0), none).count() == 0


def test_chunks_cover_whole_texts():
    texts = [b"", b"x", bytes(range(1, 256)) * 20, b"y" * (CHUNK + 1)]
    rows_, owner, weight = chunks(texts)
    for k, text in enumerate(texts):
        own = rows_[owner == k]
        joined = b"".join(r[:STRIDE].tobytes() for r in own[:-1]) + own[-1].tobytes()
        assert joined.rstrip(b"\0") == text
    assert echo(np.frombuffer(b"abcabcabc" + b"\0" * 7, np.uint8).reshape(1, -1)).sum() >= 4


def test_gradients():
    rng = np.random.default_rng(0)
    net = Network.fresh(1)
    x = rng.integers(1, 255, (4, CHUNK)).astype(np.uint8)
    y = np.array([0, 1, 1, 0], np.float32)
    loss = lambda: float(np.mean(np.log1p(np.exp(net.logits(x))) - y * net.logits(x)))
    before = loss()
    for _ in range(30):
        net.step(x, y, np.ones(4), 0.01)
    assert loss() < before / 2


def plain_score(net, text):
    """One text's score by loops: every chunk, every step, every filter."""
    parts, logits, sizes = max(1, -(-(len(text) - WIDTH) // STRIDE)), [], []
    for k in range(parts):
        row = text[k * STRIDE : k * STRIDE + CHUNK].ljust(CHUNK, b"\0")
        seen = [[*net.vectors[b].tolist(), float(b > 0 and any(i >= lag and (row + b"\0\0")[i : i + 3] == row[i - lag : i - lag + 3] for lag in LAGS))] for i, b in enumerate(row)]
        best = []
        for f in range(FILTERS):
            values = []
            for at in range(0, CHUNK - WIDTH + 1, STEP):
                values.append(sum(seen[at + j * STEP + i][c] * float(net.filters[j][i * INPUT + c][f]) for j in range(WIDTH // STEP) for i in range(STEP) for c in range(INPUT)))
            best.append(max(max(values) + float(net.bias[f]), 0.0))
        logits.append(sum(b * float(o) for b, o in zip(best, net.out, strict=True)) + net.out_bias + net.shift)
        sizes.append(min(max(len(text) - k * STRIDE, 1), CHUNK))
    mean = sum(z * n for z, n in zip(logits, sizes, strict=True)) / sum(sizes)
    return 1 / (1 + math.exp(-mean))


def test_scores_are_those_of_plain_loops():
    rng = random.Random(5)
    net = Network.fresh(3)
    net.shift, net.out_bias = 0.3, -0.2
    texts = [b"", b"abcabcabcabc", " ".join(rng.choice(["one", "two", "zwölf", "|"]) for _ in range(400)).encode()]
    assert net.scores(texts) == pytest.approx([plain_score(net, t) for t in texts], abs=1e-4)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no tables")
def test_held_out_labels_of_the_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    held = [r for r in classify(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_bounds_of_fitting_and_repeated_identifiers(spark):
    data = rows(4, 60)
    docs = spark.createDataFrame([(k, t) for k, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in data], "doc_id long, quality int")
    twice = docs.unionByName(docs.selectExpr("doc_id", "concat(text, ' more of it') AS text"))
    # Sums of 32-bit floats depend on which rows share a batch.
    scores = lambda table, **kw: sorted((r.doc_id, r.held_out, round(r.score, 5)) for r in classify(table, labels, **kw).collect())
    assert scores(twice) == scores(twice.orderBy("text", ascending=False).repartition(5))
    assert all(r[2] == pytest.approx(0.5, abs=0.5) for r in scores(docs, longest_fitted=0, max_per_class=0))
    assert len({r[2] for r in scores(docs, longest_fitted=0)}) == 1
