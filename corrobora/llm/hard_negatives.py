"""Hard negatives by a vector-approximation file.

Rows are stored once in blocks: whole-number vectors, and beside them each dimension's cell of a block's own uniform
grid. Anchors go over all blocks, a bounded set of them at a time. A table per anchor and dimension gives what each
cell adds to a score at least; as all cells of a dimension are equally wide, what it adds at most is the same number
more for all rows of a block. Only rows whose bounds may put them among an anchor's nearest of its own label, or into
one of its windows, have their vectors multiplied. Both passes end in a few rows an anchor and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrobora.tables import discard, written

#: Bits of a cell's number.
BITS = 6
#: Bytes of whole-number vectors in a block, and in the anchors of one pass.
BLOCK, PASS = 4 << 20, 16 << 20
#: Rows and anchors whose bounds are looked up at a time.
ROWS, ANCHORS = 2048, 128
#: A vector whose squared length is above this has scores that 64 bits do not hold; it takes no part.
LONGEST = 2.0**62
NONE = np.iinfo(np.int64).min

FILE = "part long, dim int, ids binary, labels binary, vectors binary, cells binary, low binary, width binary"
FILE_SCHEMA = pa.schema([("part", pa.int64()), ("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "vectors", "cells", "low", "width"))])


def whole(batch: pa.RecordBatch, scale: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vec_id, label, vector) columns -> identifiers, labels and floor(scale * x), for each number of dimensions.

    A null component or one that is not finite takes its row out, and so does too long a vector.
    """
    ids, labels, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
    lengths = np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False))
    flat = np.asarray(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), float)
    ends = np.cumsum(lengths)
    out = []
    for dim in np.unique(lengths):
        own = np.flatnonzero(lengths == dim)
        x = np.floor(flat[(ends[own] - dim)[:, None] + np.arange(dim)] * scale)
        with np.errstate(over="ignore", invalid="ignore"):
            fine = np.isfinite(x).all(1) & ((x * x).sum(1) <= LONGEST)
        out.append((ids[own][fine].astype(np.int64), labels[own][fine].astype(np.int64), x[fine].astype(np.int64)))
    return out


def cells(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each component's cell, and each dimension's lowest value and cell width (whole numbers, 1 at least)."""
    low, high = x.min(0), x.max(0)
    width = (high - low) // (1 << bits) + 1
    return ((x - low) // width).astype(np.uint8 if bits <= 8 else np.uint16), low, width


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpack(blob: bytes, kind, *shape: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind).reshape(shape)


def _approximate(scale: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids, labels, x = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            code, low, width = cells(x, bits) if dim else (np.zeros((len(x), 0), np.uint8), np.zeros(0, np.int64), np.ones(0, np.int64))
            number += 1
            row = (number, dim, ids, labels, x, code, low, width)
            return pa.record_batch([[v if i < 2 else _pack(v)] for i, v in enumerate(row)], schema=FILE_SCHEMA)

        for batch in batches:
            for ids, labels, x in whole(batch, scale):
                dim, most = x.shape[1], max(1, BLOCK // (8 * max(1, x.shape[1])))
                for a in range(0, len(x), most):
                    if sum(len(h[0]) for h in held.get(dim, [])) + len(x[a : a + most]) > most:
                        yield block(dim)
                    held.setdefault(dim, []).append((ids[a : a + most], labels[a : a + most], x[a : a + most]))
        for dim in list(held):
            yield block(dim)

    return run


def approximation_file(rows: DataFrame, scale: int = 256, bits: int = BITS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The stored blocks of (vec_id, label, vector); rows without an identifier, label or vector are left out."""
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return written(kept.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").mapInArrow(_approximate(scale, bits), FILE))


def lower_bounds(code: np.ndarray, low: np.ndarray, width: np.ndarray, anchors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, anchors) of the least a row's score can be, and by anchor how much more it can be at most."""
    total = np.zeros((len(code), len(anchors)), np.int64)
    begin = low + np.arange(1 << bits)[:, None] * width
    for d in range(code.shape[1]):
        a = anchors[:, d]
        # From a cell's first value where the anchor's component is positive, from its last one where it is not.
        least = begin[:, d, None] * a + (width[d] - 1) * np.minimum(a, 0)
        total += least[code[:, d]]
    return total, (np.abs(anchors) * (width - 1)).sum(1)


def first(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of each anchor's ``k`` highest scores, ties by smaller identifier."""
    order = np.lexsort((ids, -score, anchor))
    a = anchor[order]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
    place = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
    return order[place < k]


class Best:
    """Each slot's ``k`` best rows so far, and the score below which no row gets in any more."""

    def __init__(self, slots: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.slot, self.score, self.ids = (np.empty(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = np.r_[self.slot, slot], np.r_[self.score, score], np.r_[self.ids, ids]
        keep = first(slot, score, ids, self.k)
        self.slot, self.score, self.ids = slot[keep], score[keep], ids[keep]
        full = np.flatnonzero(np.bincount(self.slot, minlength=len(self.floor)) == self.k)
        last = np.searchsorted(self.slot, full, "right") - 1
        self.floor[full] = np.maximum(self.floor[full], self.score[last])


def _chunks(batches: Iterator[pd.DataFrame], dims: dict[int, np.ndarray], x: list[np.ndarray], bits: int) -> Iterator[tuple]:
    """Rows' identifiers, labels and vectors with a group of anchors and their bounds, for all rows and anchors."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            if (asked := dims.get(r.dim)) is None:
                continue
            ids, labels = _unpack(r.ids, np.int64, -1), _unpack(r.labels, np.int64, -1)
            vectors = _unpack(r.vectors, np.int64, len(ids), r.dim)
            code = _unpack(r.cells, np.uint8 if bits <= 8 else np.uint16, len(ids), r.dim)
            low, width = _unpack(r.low, np.int64, -1), _unpack(r.width, np.int64, -1)
            for m in range(0, len(asked), ANCHORS):
                group = asked[m : m + ANCHORS]
                anchors = np.stack([x[i] for i in group])
                for a in range(0, len(ids), ROWS):
                    own = slice(a, a + ROWS)
                    least, more = lower_bounds(code[own], low, width, anchors, bits)
                    yield ids[own], labels[own], vectors[own], group, anchors, least, least + more


def _exact(vectors: np.ndarray, anchors: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Inner products of the chosen pairs, some at a time."""
    out = np.empty(len(row), np.int64)
    step = max(1, (1 << 20) // max(1, vectors.shape[1]))
    for a in range(0, len(row), step):
        out[a : a + step] = np.einsum("ij,ij->i", vectors[row[a : a + step]], anchors[col[a : a + step]])
    return out


def _nearest(held, k: int, bits: int):
    """Each anchor's ``k`` best rows of its own label in this task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, labels, x, dims = held.value
        best = Best(len(ids), k, np.full(len(ids), NONE))
        for rid, label, vectors, group, anchors, least, most in _chunks(batches, dims, x, bits):
            same = (label[:, None] == labels[group]) & (rid[:, None] != ids[group])
            if len(rid) >= k:
                # As many rows as asked for score at least this much.
                bound = np.partition(np.where(same, least, NONE), len(rid) - k, axis=0)[len(rid) - k]
                best.floor[group] = np.maximum(best.floor[group], bound)
            row, col = np.nonzero(same & (most >= best.floor[group]))
            best.add(group[col], _exact(vectors, anchors, row, col), rid[row])
        yield pd.DataFrame({"slot": best.slot, "score": best.score, "id": best.ids})

    return run


def _windows(held, places, k: int, bits: int):
    """Each window's ``k`` best rows of other labels in this task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, labels, x, dims = held.value
        owner, low, high = places.value
        best = Best(len(owner), k, low)
        edges = np.searchsorted(owner, np.arange(len(ids) + 1))
        for rid, label, vectors, group, anchors, least, most in _chunks(batches, dims, x, bits):
            sizes = edges[group + 1] - edges[group]
            floor, top = np.full(len(group), np.iinfo(np.int64).max), np.full(len(group), NONE)
            for j in range(int(sizes.max(initial=0))):
                some = np.flatnonzero(sizes > j)
                at = edges[group[some]] + j
                floor[some] = np.minimum(floor[some], best.floor[at])
                top[some] = np.maximum(top[some], high[at])
            # What may be at once high enough for one of the anchor's windows and not above all of them.
            row, col = np.nonzero((label[:, None] != labels[group]) & (rid[:, None] != ids[group]) & (most >= floor) & (least <= top))
            score = _exact(vectors, anchors, row, col)
            for j in range(int(sizes.max(initial=0))):
                at = edges[group[col]] + j
                own = np.flatnonzero(j < sizes[col])
                own = own[(score[own] <= high[at[own]]) & (score[own] >= best.floor[at[own]])]
                best.add(at[own], score[own], rid[row[own]])
        yield pd.DataFrame({"slot": best.slot, "score": best.score, "id": best.ids})

    return run


FOUND = "slot long, score long, id long"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """Each slot's ``k`` best of all tasks, with their ranks from 1."""
    w = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _anchors(blocks: list) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], dict[int, np.ndarray]]:
    """Identifiers, labels and vectors of a pass's anchors, and the anchors of each number of dimensions."""
    ids, labels, x, dims = [], [], [], {}
    for b in blocks:
        own = _unpack(b.ids, np.int64, -1)
        dims.setdefault(b.dim, []).extend(range(len(ids), len(ids) + len(own)))
        ids.extend(own)
        labels.extend(_unpack(b.labels, np.int64, -1))
        x.extend(_unpack(b.vectors, np.int64, len(own), b.dim))
    return np.array(ids, np.int64), np.array(labels, np.int64), x, {d: np.array(v) for d, v in dims.items()}


def _pass(spark: SparkSession, stored: DataFrame, blocks: list, positives: int, negatives: int, low: int, bits: int) -> DataFrame:
    ids, labels, x, dims = _anchors(blocks)
    held = spark.sparkContext.broadcast((ids, labels, x, dims))
    # Bounded by the anchors of a pass.
    near = sorted(tuple(r) for r in _ranked(stored.mapInPandas(_nearest(held, positives, bits), FOUND), positives).select("slot", "rank", "score", "id").collect())
    owner, _, score, pid = np.array(near, np.int64).reshape(-1, 4).T
    places = spark.sparkContext.broadcast((owner, -((-low * score) // 100), score))
    found = _ranked(stored.mapInPandas(_windows(held, places, negatives, bits), FOUND), negatives)
    asked = spark.createDataFrame(pd.DataFrame({"slot": np.arange(len(owner)), "anchor_id": ids[owner], "positive_id": pid, "positive_score": score}), "slot long, anchor_id long, positive_id long, positive_score long")
    return found.join(F.broadcast(asked), "slot").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256, bits: int = BITS, **columns: str) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components x become floor(scale * x), scores are inner products, higher ones come first and ties go by smaller
    identifier. An anchor's positives are its first rows of the same label; its negatives, for each positive, the
    first rows of other labels whose score is between ``percent`` percent of the positive's and the positive's own.

    ``anchors`` are rows of the same form, each a query of its own. Rows without identifier, label or vector, with a
    component that is null or not finite, or so long that 64 bits do not hold their scores take no part. Rows with the
    anchor's identifier are versions of itself and neither positives nor negatives; other repeated rows count one by
    one. Vectors with different numbers of dimensions do not meet. An anchor without positives gives no row, as does
    a window that no row is in; a positive with a negative score has an empty window. ``columns`` name id_col,
    vector_col and label_col.
    """
    spark = rows.sparkSession
    stored, asked = (approximation_file(df, scale, bits, **columns) for df in (rows, anchors))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Blocks are the unit of work, and a task's few best rows an anchor are all that leaves it.
    dealt = written(stored.repartition(max(1, min(n, stored.count())), "part"))
    sizes = sorted((r.part, r.size) for r in asked.select("part", F.octet_length("vectors").alias("size")).collect())
    out, batch, size = [], [], 0
    for part, own in [*sizes, (None, 0)]:
        if batch and (part is None or size + own > PASS):
            out.append(written(_pass(spark, dealt, asked.where(F.col("part").isin(batch)).collect(), positives, negatives, percent, bits)))
            batch, size = [], 0
        batch.append(part)
        size += own
    discard(stored, asked)
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
