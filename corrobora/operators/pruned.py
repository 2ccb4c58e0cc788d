"""Exact top-k by dot product over inverted lists with block maxima, and how much of the full scan it leaves out.

``build`` stores rows in segments. Within one, rows lie so that like ones are neighbours, LEAF of them make a leaf,
and each dimension has a list of the rows that are not zero there, with each leaf's largest and least value. A query
looks at its own dimensions only. The sum of its components times the leaf's largest values (its least ones where the
component is negative) is at least the score of every row in the leaf, so leaves are taken from the highest bound
down until none can hold a row that is better than the k best so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corrobora.operators.vectors import CELLS, QUERY_BLOCK, _matrix, _unit_rows

#: Rows of a segment and of a leaf, and bytes that a segment's values may take as plain rows.
SEGMENT, LEAF, BYTES = 4096, 8, 16 << 20
#: Leaves of the highest bounds that are taken before the others are looked at again.
FIRST = 8
#: Bounds and scores are sums in some order; what is this close counts as not below.
SLACK = 1e-9
#: A query that may have its best rows in this share of a segment's leaves is scored with all of them, with others of its
#: kind, CELLS scores at a time.
MOST = 0.9


def neighbours(v: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """An order of the rows in which like ones are close: halves along the line between two far rows, again and again."""
    out, stack = [], [np.arange(len(v))]
    while stack:
        own = stack.pop()
        if len(own) <= leaf:
            out.append(own)
            continue
        x = v[own]
        one = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
        other = x[((x - one) ** 2).sum(1).argmax()]
        along = np.argsort(x @ (one - other), kind="stable")
        half = max(leaf, len(own) // 2 // leaf * leaf)
        stack += [own[along[half:]], own[along[:half]]]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def _segments(ids: pa.Array, v: np.ndarray, size: int) -> Iterator[tuple]:
    for a in range(0, len(v), size):
        x = v[a : a + size]
        order = neighbours(x)
        x = x[order].T
        row_of = np.nonzero(x)[1].astype(np.uint16)
        yield ids[a : a + size].take(pa.array(order)), order.astype(np.uint16), x.shape[0], np.count_nonzero(x, 1).astype(np.uint32), row_of, x[np.nonzero(x)].astype(np.float32)


def build(rows: DataFrame, row_id: str = "id", vector: str = "vector") -> DataFrame:
    """The segments of (id, vector): rows (ids, place, dim, counts, rows, values), to be stored.

    Null vectors are passed over; all others must have one length within a partition. Identifiers that are text are
    put in the locale's order first, as ties go by it, and ``place`` keeps that order.
    """
    source = rows.where(F.col(vector).isNotNull()).select(row_id, vector)
    kind = source.schema[row_id].dataType
    textual = kind.simpleString() == "string"
    source = source.sortWithinPartitions(F.collate(F.col(row_id), "UNICODE"), F.col(row_id)) if textual else source.sortWithinPartitions(row_id)
    schema = pa.schema([("ids", pa.list_(to_arrow_type(kind))), ("place", pa.binary()), ("dim", pa.int32()), ("counts", pa.binary()), ("rows", pa.binary()), ("vals", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            ids, v = pa.concat_arrays([i for i, _ in held]), np.concatenate([m for _, m in held])
            held.clear()
            for own, place, dim, counts, row_of, values in _segments(ids, v, size):
                yield pa.record_batch([pa.array([own.to_pylist()], schema.field("ids").type), [_pack(place)], pa.array([dim], pa.int32()), [_pack(counts)], [_pack(row_of)], [_pack(values)]], schema=schema)

        size = SEGMENT
        for batch in batches:
            for a in range(0, batch.num_rows, SEGMENT):
                part = batch.slice(a, SEGMENT)
                m = _matrix(part.column(1))
                if held and m.shape[1] != held[0][1].shape[1]:
                    raise ValueError(f"rows have {m.shape[1]} and {held[0][1].shape[1]} dimensions")
                size = max(LEAF, min(SEGMENT, BYTES // max(1, 4 * m.shape[1])))
                held.append((part.column(0), m))
                if sum(len(x) for _, x in held) >= size:
                    yield from flush()
        if held:
            yield from flush()

    return source.mapInArrow(run, f"ids array<{kind.simpleString()}>, place binary, dim int, counts binary, rows binary, vals binary")


class Segment:
    """One stored segment, with its lists laid out by dimension."""

    def __init__(self, place: bytes, dim: int, counts: bytes, rows: bytes, vals: bytes):
        self.place = _unpack(place, np.uint16).astype(np.int64)
        n, counts = len(self.place), _unpack(counts, np.uint32)
        self.values = np.zeros((dim, -(-n // LEAF) * LEAF))
        self.values[np.repeat(np.arange(dim), counts), _unpack(rows, np.uint16)] = _unpack(vals, np.float32)
        leaves = self.values.reshape(dim, -1, LEAF)
        self.high, self.low, self.n = leaves.max(2), leaves.min(2), n

    def bounds(self, dims: np.ndarray, q: np.ndarray) -> np.ndarray:
        """For each leaf, what no row of it exceeds."""
        up = q > 0
        return q[up] @ self.high[dims[up]] + q[~up] @ self.low[dims[~up]]

    def possible(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each query, the share of leaves that can hold a row that is not below ``least``."""
        bound = np.maximum(q, 0) @ self.high + np.minimum(q, 0) @ self.low
        return (bound >= least[:, None] - SLACK).mean(1)

    def all_best(self, q: np.ndarray, k: int, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """As ``best`` of each query, all rows scored together."""
        s = q @ self.values[:, : self.n]
        out = []
        for own, low in zip(s, least, strict=True):
            rows = np.flatnonzero(own >= low - SLACK)
            scores = np.round(own[rows], 9)
            keep = np.lexsort((self.place[rows], -scores))[:k]
            keep = keep[scores[keep] >= low]
            out.append((rows[keep], scores[keep], self.n))
        return out

    def best(self, dims: np.ndarray, q: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and scores of the ``k`` best that are not below ``least``, ties by place, and how many rows were scored."""
        bound = self.bounds(dims, q)
        order = np.argsort(-bound, kind="stable")
        rows, scores, at, step, seen = np.empty(0, np.int64), np.empty(0), 0, FIRST, 0
        while at < len(order) and bound[order[at]] >= least - SLACK:
            leaves = order[at : at + step]
            leaves = leaves[bound[leaves] >= least - SLACK]
            own = (leaves[:, None] * LEAF + np.arange(LEAF)).reshape(-1)
            own = own[own < self.n]
            seen += len(own)
            s = np.round(q @ self.values[dims[:, None], own], 9)
            rows, scores = np.r_[rows, own], np.r_[scores, s]
            keep = np.lexsort((self.place[rows], -scores))[:k]
            rows, scores = rows[keep], scores[keep]
            if len(scores) == k:
                least = max(least, float(scores[-1]))
            at, step = at + step, 4 * step
        keep = scores >= least
        return rows[keep], scores[keep], seen


def _scan(index: DataFrame, queries: DataFrame, k: int, row_id: str, query_id: str, vector: str) -> DataFrame | None:
    """(qid, id, score, scored): each segment's best rows, and per task and query a row without id that counts."""
    spark = index.sparkSession
    asked = queries.where(F.col(vector).isNotNull()).select(query_id, vector)
    passes = max(1, -(-asked.count() // QUERY_BLOCK))
    asked_kind, kind = to_arrow_type(asked.schema[query_id].dataType), to_arrow_type(index.schema["ids"].dataType.elementType)
    schema = pa.schema([(query_id, asked_kind), (row_id, kind), ("score", pa.float64()), ("scored", pa.int64()), ("pairs", pa.int64())])
    ddl = f"{query_id} {asked.schema[query_id].dataType.simpleString()}, {row_id} {index.schema['ids'].dataType.elementType.simpleString()}, score double, scored long, pairs long"
    out = None
    for p in range(passes):
        block = asked.where(F.pmod(F.xxhash64(query_id), F.lit(passes)) == p).collect()
        if not block:
            continue
        unit = _unit_rows(np.array([r[1] for r in block], np.float32)).astype(float)
        held = spark.sparkContext.broadcast(([r[0] for r in block], unit))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            qids, unit = held.value
            asked_for, width = [(np.flatnonzero(q), q[np.flatnonzero(q)]) for q in unit], unit.shape[1]
            top = np.full((len(qids), k), -np.inf)
            scored, pairs = np.zeros(len(qids), np.int64), 0
            for batch in batches:
                for i in range(batch.num_rows):
                    ids = batch.column(0)[i].values
                    segment = Segment(*(batch.column(c)[i].as_py() for c in range(1, 6)))
                    if len(segment.values) != width:
                        raise ValueError(f"rows have {len(segment.values)} dimensions and queries {width}: another embedder made them")
                    pairs += segment.n
                    at, rows, scores = [], [], []
                    together = {}
                    step = max(1, CELLS // max(1, segment.n))
                    for a in range(0, len(unit), step):
                        least = top[a : a + step, -1]
                        js = np.flatnonzero(np.isfinite(least) & (segment.possible(unit[a : a + step], least) >= MOST))
                        together[a] = dict(zip(js.tolist(), segment.all_best(unit[a + js], k, least[js]), strict=True))
                    for j, (dims, q) in enumerate(asked_for):
                        own, s, seen = together[j - j % step].get(j % step) or segment.best(dims, q, k, top[j, -1])
                        scored[j] += seen
                        if len(own):
                            top[j] = np.sort(np.r_[top[j], s])[::-1][:k]
                            at.append(np.full(len(own), j))
                            rows.append(own)
                            scores.append(s)
                    if at:
                        at = np.concatenate(at).tolist()
                        yield pa.record_batch([pa.array([qids[j] for j in at], asked_kind), ids.take(pa.array(np.concatenate(rows))), np.concatenate(scores), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64())], schema=schema)
            yield pa.record_batch([pa.array(qids, asked_kind), pa.nulls(len(qids), kind), pa.nulls(len(qids), pa.float64()), scored, np.full(len(qids), pairs)], schema=schema)

        found = index.mapInArrow(scan, ddl)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], ddl)


def search(index: DataFrame, queries: DataFrame, k: int = 6, row_id: str = "id", query_id: str = "qid", vector: str = "vector") -> DataFrame:
    """(qid, rank, id, score): what ``vectors.top_k`` gives over the rows of the index.

    Queries are brought to unit length, scores rounded to nine decimals, ties go by identifier. Queries without a
    vector and ``k`` below 1 give no rows. QUERY_BLOCK queries are held by a task at a time, more make further passes.
    """
    found = _scan(index, queries, max(k, 1), row_id, query_id, vector).where(F.col("score").isNotNull() & F.lit(k > 0))
    textual = found.schema[row_id].dataType.simpleString() == "string"
    order = [F.collate(F.col(row_id), "UNICODE"), F.col(row_id)] if textual else [F.col(row_id)]
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), *order)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query_id, "rank", row_id, "score")


def work(index: DataFrame, queries: DataFrame, k: int = 6, row_id: str = "id", query_id: str = "qid", vector: str = "vector") -> DataFrame:
    """(qid, pairs, scored): of each query, the rows of the index and those whose scores were made in ``search``."""
    counted = _scan(index, queries, max(k, 1), row_id, query_id, vector).where("score IS NULL")
    return counted.groupBy(query_id).agg(F.sum("pairs").alias("pairs"), F.sum("scored").alias("scored"))
