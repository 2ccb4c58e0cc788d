"""Document quality by a byte-level convolutional network in numpy.

A text's bytes are cut into chunks of ``CHUNK`` bytes that overlap by one filter width and together cover it
whole. Each byte is a learned vector plus one channel that says whether its trigram occurred in the bytes
just before, which lets a filter see repetition. Filters of ``WIDTH`` bytes, one step per ``STEP`` bytes,
are max-pooled over a chunk; the chunks' logits, weighted by their bytes, are averaged to one probability.

The network is fitted on the driver, on at most ``max_per_class`` labelled rows of each class, of at most
``longest_fitted`` bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm.common import held_out, release, released, text_or_empty
from corrobora.llm.wordhash import blocks

CHUNK, WIDTH, STEP = 1024, 16, 4
STRIDE = CHUNK - WIDTH
VECTOR, FILTERS, LAGS = 4, 16, range(2, 21)
INPUT = VECTOR + 1
#: Bytes of text that are scored at a time.
BLOCK = 1 << 20


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk rows padded with zeros, the text of each, and the number of bytes that each adds."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-(sizes - WIDTH) // STRIDE))
    buffer = np.zeros(int((counts * STRIDE + WIDTH).sum()), np.uint8)
    starts, at = [], 0
    for text, k in zip(texts, counts.tolist(), strict=True):
        buffer[at : at + len(text)] = np.frombuffer(text, np.uint8)
        starts.append(at + STRIDE * np.arange(k))
        at += k * STRIDE + WIDTH
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.concatenate([np.arange(k) for k in counts]) if len(texts) else np.empty(0, np.int64)
    weight = np.clip(sizes[owner] - place * STRIDE, 1, CHUNK)
    rows = np.lib.stride_tricks.sliding_window_view(buffer, CHUNK)[np.concatenate(starts)] if starts else np.empty((0, CHUNK), np.uint8)
    return rows, owner, weight


def echo(rows: np.ndarray) -> np.ndarray:
    """Whether the three bytes from each place on also stand a few bytes before; padding does not count."""
    wide = rows.astype(np.uint32)
    tri = np.zeros_like(wide)
    tri[:, :-2] = wide[:, :-2] | wide[:, 1:-1] << 8 | wide[:, 2:] << 16
    same = np.zeros(rows.shape, bool)
    for lag in LAGS:
        same[:, lag:] |= tri[:, lag:] == tri[:, :-lag]
    return same & (rows > 0)


@dataclass
class Network:
    vectors: np.ndarray
    filters: np.ndarray  # (WIDTH / STEP, STEP * INPUT, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    shift: float = 0.0
    moments: dict = field(default_factory=dict, repr=False)

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        vectors = rng.normal(0, 0.5, (256, VECTOR)).astype(np.float32)
        vectors[0] = 0
        filters = rng.normal(0, 0.15, (WIDTH // STEP, STEP * INPUT, FILTERS)).astype(np.float32)
        return cls(vectors, filters, np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)

    def _input(self, rows: np.ndarray) -> np.ndarray:
        x = np.empty((*rows.shape, INPUT), np.float32)
        x[..., :VECTOR] = self.vectors[rows]
        x[..., VECTOR] = echo(rows)
        return x.reshape(len(rows), CHUNK // STEP, STEP * INPUT)

    def _conv(self, x: np.ndarray) -> np.ndarray:
        parts, steps = len(self.filters), x.shape[1]
        y = x[:, : steps - parts + 1] @ self.filters[0]
        for j in range(1, parts):
            y += x[:, j : steps - parts + 1 + j] @ self.filters[j]
        return y

    def logits(self, rows: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self._conv(self._input(rows)).max(1) + self.bias, 0)
        return pooled @ self.out + self.out_bias + self.shift

    def scores(self, texts: list[bytes]) -> np.ndarray:
        rows, owner, weight = chunks(texts)
        z = np.concatenate([self.logits(rows[a : a + 256]).astype(float) for a in range(0, len(rows), 256)] or [np.empty(0)])
        mean = np.bincount(owner, z * weight, len(texts)) / np.maximum(1, np.bincount(owner, weight, len(texts)))
        return 1 / (1 + np.exp(-np.clip(mean, -30, 30)))

    def step(self, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, rate: float) -> None:
        """One Adam step on chunks."""
        x = self._input(rows)
        conv = self._conv(x)
        where = conv.argmax(1)
        n = np.arange(len(rows))
        top = np.take_along_axis(conv, where[:, None, :], 1)[:, 0] + self.bias
        pooled = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.out_bias, -30, 30)))
        dz = ((p - labels) * weights / weights.sum()).astype(np.float32)
        dpool = dz[:, None] * self.out * (top > 0)
        grads = {"out": pooled.T @ dz, "bias": dpool.sum(0), "filters": np.zeros_like(self.filters), "vectors": np.zeros_like(self.vectors), "out_bias": np.float32(dz.sum())}
        bytes_of = rows.reshape(len(rows), CHUNK // STEP, STEP)
        for j in range(len(self.filters)):
            at = where + j
            seen = x[n[:, None], at]  # (chunk, filter, STEP * INPUT)
            grads["filters"][j] = np.einsum("nfi,nf->if", seen, dpool)
            back = (dpool[:, :, None] * self.filters[j].T[None]).reshape(len(rows), FILTERS, STEP, INPUT)[..., :VECTOR]
            np.add.at(grads["vectors"], bytes_of[n[:, None], at].reshape(-1), back.reshape(-1, VECTOR))
        grads["vectors"][0] = 0
        t = self.moments["t"] = self.moments.get("t", 0) + 1
        for name, g in grads.items():
            m, v = self.moments.get(name, (0, 0))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.moments[name] = m, v
            value = getattr(self, name) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            setattr(self, name, float(value) if name == "out_bias" else value.astype(np.float32))


def fit(texts: list[bytes], labels: list[int], prior: float, seed: int = 7, passes: int = 8) -> Network:
    """A network for these texts; both classes weigh the same in fitting, then ``prior`` shifts the scores."""
    net = Network.fresh(seed)
    net.shift = float(np.log(prior / (1 - prior)))
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        return net
    rows, owner, weight = chunks(texts)
    y = y[owner].astype(np.float32)
    share = weight / CHUNK
    each = np.where(y == 1, 0.5 / share[y == 1].sum(), 0.5 / share[y == 0].sum()) * share
    rng = np.random.default_rng(seed)
    total = max(400, passes * len(rows) // 128)
    for k in range(total):
        at = rng.integers(0, len(rows), 128)
        net.step(rows[at], y[at], each[at] * len(rows), 0.01 * (1 - k / total) + 1e-4)
    net.moments = {}
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_per_class: int = 1500, longest_fitted: int = 1 << 17) -> Network:
    """Fits on the labelled rows that are not held out, the same ones at every run.

    Takes the rows of each class in the order of a hash of their identifiers, ``max_per_class`` at most; null
    labels or identifiers are left out, and an identifier counts once, with the least of its texts by their hashes.
    The network sees texts of at most ``longest_fitted`` bytes; both bounds keep down what the driver holds, and only
    fitting is subject to them: all texts are scored, whole.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(4, 2, "id"))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_per_class) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])  # two ids and labels per row: bounded, so it is broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text")).where(F.octet_length("text") <= longest_fitted)
    rows = texts.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).collect()
    rows.sort(key=lambda r: r.id)
    return fit([bytes(r.text) for r in rows], [r.y for r in rows], (good + 0.5) / (good + bad + 1))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; only the text's bytes go into a score.

    A null text counts as empty; an empty text gets the score of a chunk of padding. Null and repeated
    identifiers are kept as they come, other columns are ignored, an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for a, b in blocks(lengths, BLOCK):
                part = batch.slice(a, b - a)
                yield pa.record_batch([part.column(0), pa.array(model.value.scores(part.column(1).to_pylist()))], names=["doc_id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    scored = source.mapInArrow(released(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, train(docs, labels, **options))


def keep_good(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows whose text scores ``threshold`` or more, with their columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            sizes = texts.str.len().to_numpy()
            yield pd.Series(np.concatenate([np.empty(0), *(model.value.scores([t.encode() for t in texts.iloc[a:b]]) for a, b in blocks(sizes, BLOCK))]))
        release()

    return docs.where(rate(text_or_empty(text_col)) >= threshold)
