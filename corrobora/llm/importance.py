"""Importance resampling towards a target corpus, from bucket-partitioned inverted postings.

Blocks of documents become postings (bucket, document, count), inverted within the block and cut into parts of the
bucket space; they are stored once. The buckets' totals in both corpora are summed before anything is dealt by bucket,
and each bucket's gain is made of them. A part's postings then meet the gains of its own buckets, and no others: a
part is dealt out in slices by block, as a bucket that a third of all words fall into would else be one task's. Each
slice emits what its buckets contribute to each document of a block, and a block adds its parts up.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm.common import partitions, text_or_empty
from corrobora.llm.wordhash import blocks
from corrobora.operators.ordering import with_position
from corrobora.tables import discard, written

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK = 4 << 20
#: Bytes of a text whose words are listed at a time.
PIECE = 1 << 20
#: Buckets in a part of the bucket space.
PART = 1024
#: Words, and sums of buckets, that a task remembers at a time.
KNOWN = 500_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NO_WORD = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")

ROW = "block long, part int, a binary, b binary, c binary"
ROWS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


class Buckets(dict):
    """Features to the buckets of their bytes, made on first sight; emptied when there are too many."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        number = self[feature] = zlib.crc32(feature) % self.buckets
        return number


def pieces(text: bytes) -> Iterator[bytes]:
    """``text`` in stretches that cut no word; a word longer than PIECE stays whole."""
    at = 0
    while len(text) - at > PIECE:
        cut = NO_WORD.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def features(text: bytes, known: Buckets, most: int) -> tuple[np.ndarray, int]:
    """The buckets of all runs of 1 to ``most`` words, repeats kept, and the number of words."""
    out, n, tail = [], 0, []
    for piece in pieces(text):
        words = WORD.findall(piece.lower())
        out.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        n += len(words)
        if most > 1:
            for k in range(2, most + 1):
                # Runs that end in this piece; they may begin in the pieces before.
                joined = tail[len(tail) - min(len(tail), k - 1) :] + words
                out.append(np.array([known[b" ".join(joined[i : i + k])] for i in range(len(joined) - k + 1)], np.int64))
            tail = (tail + words)[1 - most :]
    return np.concatenate(out), n


def pack(array: np.ndarray, kind: str = "<u4") -> bytes:
    """Little-endian, each byte of the numbers apart, compressed."""
    kind = np.dtype(kind)
    return zstandard.compress(np.ascontiguousarray(array.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T).tobytes(), 3)


def unpack(blob: bytes, kind: str = "<u4") -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _invert(buckets: int, most: int):
    """Blocks of documents to one row per part: postings in order of bucket; part -1 lists the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = Buckets(buckets), TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for x, y in blocks(lengths, BLOCK):
                keys, counts, words = [], np.zeros(y - x, np.int64), np.zeros(y - x, np.int64)
                for i in range(y - x):
                    own, words[i] = features(batch.column(1)[x + i].as_py(), known, most)
                    counts[i] = len(own)
                    keys.append(own * (y - x) + i)
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                bucket, doc = np.divmod(key, y - x)
                listed = pa.record_batch([batch.column(0).slice(x, y - x), counts, words], names=["doc_id", "n_features", "n_words"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, listed.schema) as out:
                    out.write_batch(listed)
                rows = [(number, -1, sink.getvalue().to_pybytes(), None, None)]
                edges = np.searchsorted(bucket, np.arange(0, buckets + PART, PART))
                for k in np.flatnonzero(np.diff(edges)):
                    own = slice(edges[k], edges[k + 1])
                    rows.append((number, int(k), pack(bucket[own] - k * PART, "<u2"), pack(doc[own]), pack(n[own])))
                yield pa.record_batch([list(c) for c in zip(*rows, strict=True)], schema=ROWS)
                number += 1

    return run


def _summed(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and counts, added up within the task as far as KNOWN of them are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, np.concatenate([n for _, n in held]))
        return key, total

    for pair in pairs:
        held.append(pair)
        size += len(pair[0])
        if size > KNOWN:
            held = [merged()]
            size = len(held[0][0])
            if size > KNOWN // 2:
                yield held.pop()
                size = 0
    if held:
        yield merged()


def _posted_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = ((unpack(a, "<u2").astype(np.int64) + part * PART, unpack(n).astype(np.int64)) for batch in batches for part, a, n in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, n in _summed(pairs):
        yield pa.record_batch([key, n], names=["bucket", "n"])


def _text_totals(buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        for key, n in _summed(np.unique(features(text.as_py(), known, most)[0], return_counts=True) for batch in batches for text in batch.column(0)):
            yield pa.record_batch([key, n], names=["bucket", "n"])

    return run


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's gains, then its postings: what they contribute to each document of their block."""
    at, gains = None, np.zeros(PART, np.int64)
    for batch in batches:
        out = []
        for home, block, part, a, b, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if block is None:
                at, gains = home, np.zeros(PART, np.int64)
                gains[unpack(a, "<u2")] = unpack(b, "<i8")
                continue
            if home != at:
                raise ValueError("a part's postings came without its gains")
            docs = unpack(b)
            # Sums of whole numbers far below 2^53 are exact in doubles.
            sums = np.bincount(docs, weights=gains[unpack(a, "<u2")] * unpack(c).astype(float))
            out.append((block, part, pack(sums.astype(np.int64), "<i8"), None, None))
        if out:
            yield pa.record_batch([list(c) for c in zip(*out, strict=True)], schema=ROWS)


SUMS = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("n_words", pa.int64()), ("total", pa.int64()), ("block", pa.int64()), ("at", pa.int64())])


def _add_up(rows: pa.Table) -> pa.Table:
    """A block's documents with the sums over its parts."""
    part, a = rows.column("part").to_pylist(), rows.column("a").to_pylist()
    docs = pa.ipc.open_stream(a[part.index(-1)]).read_all()
    total = np.zeros(len(docs), np.int64)
    for k, blob in zip(part, a, strict=True):
        if k >= 0:
            own = unpack(blob, "<i8")
            total[: len(own)] += own
    return pa.table([docs.column("doc_id"), docs.column("n_features"), docs.column("n_words"), pa.array(total), pa.array(np.full(len(docs), rows.column("block")[0].as_py())), pa.array(np.arange(len(docs)))], schema=SUMS)


def gains(posted: DataFrame, target: DataFrame, buckets: int, most: int, text_col: str = "text") -> DataFrame:
    """(bucket, s, t, gain) of every bucket that holds a feature of either corpus."""
    schema = "bucket long, n long"
    corpus = posted.where(F.col("part") >= 0).select("part", "a", "c").mapInArrow(_posted_totals, schema).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    wanted = target.select(text_or_empty(text_col).cast("binary").alias("text")).mapInArrow(_text_totals(buckets, most), schema).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    both = written(corpus.unionByName(wanted).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    big_s, big_t = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * F.lit(float(big_s) + buckets) / ((s + 1) * F.lit(float(big_t) + buckets))
    return both.withColumn("gain", F.floor(1000 * F.log(ratio)).cast("long"))


def weights(docs: DataFrame, target: DataFrame, buckets: int = 10_000, most: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, n_words, weight, block, at): the floored mean gain of each row's features, 0 without any.

    A feature is a run of 1 to ``most`` words; its bucket is its bytes' crc32 modulo ``buckets``. A null text has no
    words. Rows are kept one by one, repeated and null identifiers too; (block, at) tells them apart.
    """
    n = partitions(docs.sparkSession)
    parts = -(-buckets // PART)
    slices = -(-n // parts)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    posted = written(source.mapInArrow(_invert(buckets, most), ROW))
    found = gains(posted, target, buckets, most, text_col)
    packed = found.groupBy(F.floor(F.col("bucket") / PART).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct((F.col("bucket") % PART).alias("k"), "gain"))).alias("g"))
    held = packed.select("part", F.col("g.k").alias("k"), F.col("g.gain").alias("gain"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    local = held.select((F.col("part") * slices + F.col("slice")).alias("home"), F.lit(None).cast("long").alias("block"), "part", "k", "gain").mapInArrow(_pack_gains, f"home int, {ROW}")
    homed = posted.where(F.col("part") >= 0).select((F.col("part") * slices + F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int")).alias("home"), "block", "part", "a", "b", "c")
    dealt = homed.unionByName(local).repartitionById(parts * slices, "home").sortWithinPartitions("home", F.asc_nulls_first("block"))
    sums = dealt.mapInArrow(_contribute, ROW)
    added = posted.where(F.col("part") < 0).unionByName(sums).groupBy("block").applyInArrow(_add_up, "doc_id long, n_features long, n_words long, total long, block long, at long")
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("div(total - pmod(total, n_features), n_features)"))
    out = written(added.select("doc_id", "n_features", "n_words", weight.alias("weight"), "block", "at"))
    discard(posted, found)
    return out


def _pack_gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        home, block, part, k, gain = (c.to_pylist() for c in batch.columns)
        blobs = [pack(np.array(x), "<u2") for x in k], [pack(np.array(x), "<i8") for x in gain]
        yield pa.record_batch([pa.array(home, pa.int32()), pa.array(block, pa.int64()), pa.array(part, pa.int32()), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary()), pa.array([None] * len(home), pa.binary())], names=["home", *ROWS.names])


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, buckets: int = 10_000, most: int = 1, least_words: int = 20, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank): ``percent`` of the documents of ``least_words`` words or more, drawn
    without replacement with odds that follow their weights.

    score is the weight plus a Gumbel variate that the seed and the identifier fix (a null identifier counts as
    empty); the highest scores are drawn, ties to the smaller identifier, nulls last, then to fewer features, and
    rank counts them from 1. All rows are returned, undrawn ones with a null rank; an empty table gives none.
    """
    weighted = weights(docs, target, buckets, most, id_col, text_col)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weighted.withColumn("score", F.col("weight") + noise)
    eligible = F.col("n_words") >= least_words
    drawn = percent * scored.where(eligible).count() // 100
    order = [-F.col("score"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("n_features"), F.xxhash64("block", "at")]
    placed = with_position(scored.where(eligible), "rank", *order)
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*columns, rank.alias("rank")).unionByName(scored.where(~eligible).select(*columns, F.lit(None).cast("long").alias("rank")))
