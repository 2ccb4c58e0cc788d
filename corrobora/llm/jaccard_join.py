"""Exact Jaccard self-join of word n-gram sets, with set-relation skipping, down to its components.

Candidates come from an inverted index of prefixes: all sets use one global order, frequent grams last,
and two sets at or above the threshold share a gram among their first |x| - ceil(t|x|) + 1 ones. Index
lists hold (set, size, position) in blocks of one size, sorted by position. Blocks are skipped by their size
and by the position of the set that meets them, and cut at the position where min(|x| - i, |y| - j), with
positions from 0, falls below the overlap that the threshold asks for.

Answers of a set are derived from those of a highly similar one. The first rounds verify, in each list, each
set with a few others, mostly the same in all lists of a group; sets linked there share their answers from
then on, as what one reaches the other reaches. The last round takes only lists whose sets do not all share answers
yet, and in these the sets outside the list's most frequent label, each with all others. Hence a group of many near
copies costs about as many verifications as it has members, and no link between components is lost. Before sets are
fetched, parity sketches bound a pair's overlap from above, so only pairs that may be links cost a set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from corrobora.llm.common import BROADCAST_ROWS, discard, many_to_one, partitions, released, text_or_empty, without, written
from corrobora.llm.components import components
from corrobora.llm.wordhash import blocks, shingle_sets

U = np.uint64
#: Bytes of text whose sets a task holds at a time.
BLOCK = 4 << 20
#: Grams that the order moves to the end; the most frequent ones if there are more. It bounds a broadcast of 16 MB
#: and changes only how many candidates there are, never the result.
MOST_HEAVY = 1 << 20
#: A gram in so many sets counts as frequent: seen so often within blocks, or twice in one set of so many.
HEAVY_AT = 64
#: A list with more sets is handled by several tasks, each of which meets so many sets with so many others.
LONG_LIST = 4096
#: Rounds in which the sets of a list meet its hubs only, so many of them, before all of its sets meet.
STAR_ROUNDS = 2
HUBS = 3
#: A set in more pairs than this, and than twice a task's fair share of them, is a hub.
HUB_PAIRS = 256
#: Bytes of hubs' rows that are broadcast.
HUB_BYTES = 32 << 20
#: Prefix entries of a bucket, which one task sorts at a time.
BUCKET = 1 << 22


def identity(s: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 64-bit halves of a set's digest: its node, and what tells whether two sets got the same one."""
    digest = xxhash.xxh3_128_digest(s.tobytes(), seed)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def node_of(s: np.ndarray, seed: int) -> int:
    return identity(s, seed)[0]


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of elements at each of 2^k >= |s| places, 64 at least, packed in bits.

    Two sketches of one length differ in at most as many bits as the sets have elements apart.
    """
    size = max(64, 1 << (len(s) - 1).bit_length() if len(s) else 64)
    return np.packbits((np.bincount((s & U(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """At least so many elements are in one of the two sets only; the longer sketch is folded to the shorter."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    """Blocks of a batch whose columns are doc_id and the text's bytes."""
    column = batch.column(1)
    for a, b in blocks(np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]), BLOCK):
        yield a, b, column.slice(a, b - a).to_pylist()


SIGNED = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("gram", pa.bool_())])


def _signatures(n: int, seed: int):
    """Rows of documents (doc_id, node, check, set size n, sketch) and of grams (node the gram, n a count of sets).

    Grams are counted within each block where they occur twice, and in one set of HEAVY_AT for the whole table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _texts(batch):
                sets = shingle_sets(texts, n)
                names = [identity(s, seed) for s in sets]
                yield pa.record_batch([batch.column(0).slice(a, b - a), [x for x, _ in names], [y for _, y in names], [len(s) for s in sets], [sketch(s) for s in sets], [False] * len(sets)], schema=SIGNED)
                own = dict(zip(names, sets, strict=True))
                grams, count = np.unique(np.concatenate(list(own.values())), return_counts=True)
                often = count >= 2
                sampled = [s for (_, check), s in own.items() if check % HEAVY_AT == 0]
                found = [(grams[often], count[often].astype(np.int64)), *((s, np.full(len(s), HEAVY_AT // 2)) for s in sampled)]
                values, counts = (np.concatenate(x) for x in zip(*found, strict=True))
                if k := len(values):
                    none = pa.nulls(k, pa.int64())
                    yield pa.record_batch([none, values.view(np.int64), none, counts, pa.nulls(k, pa.binary()), [True] * k], schema=SIGNED)

    return run


def _prefixes(n: int, percent: int, seed: int, heavy: np.ndarray, rank: np.ndarray, buckets: int):
    """One row per block and bucket: the prefix entries of the block's distinct sets that fall there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in _texts(batch):
                toks, lens, nodes, sizes = [], [], [], []
                seen: set[int] = set()
                for s in shingle_sets(texts, n):
                    if not len(s) or (node := node_of(s, seed)) in seen:
                        continue
                    seen.add(node)
                    if len(heavy):
                        at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                        hot = heavy[at] == s
                        if hot.any():
                            s = np.concatenate([s[~hot], s[hot][np.argsort(rank[at[hot]])]])
                    p = len(s) + (-percent * len(s)) // 100 + 1
                    toks.append(s[:p])
                    lens.append(p)
                    nodes.append(node)
                    sizes.append(len(s))
                if not toks:
                    continue
                tok, lens = np.concatenate(toks), np.array(lens)
                doc = np.repeat(np.arange(len(lens), dtype=np.uint32), lens)
                pos = (np.arange(len(tok)) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.uint32)
                nodes, sizes = np.array(nodes, np.int64), np.array(sizes, np.int32)
                bucket = (tok % U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                tok = (tok >> U(32)).astype(np.uint32)[order]
                doc, pos = doc[order], pos[order]
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows: list[tuple] = []
                for k in np.flatnonzero(np.diff(edges)):
                    x = slice(edges[k], edges[k + 1])
                    used, local = np.unique(doc[x], return_inverse=True)
                    rows.append((int(k), tok[x].tobytes(), local.astype(np.uint32).tobytes(), pos[x].tobytes(), nodes[used].tobytes(), sizes[used].tobytes()))
                yield pa.record_batch([list(c) for c in zip(*rows, strict=True)], names=["bucket", "tok", "doc", "pos", "nodes", "sizes"])

    return run


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _reachable(sx, sy, i, j, percent: int) -> np.ndarray:
    """May sets of these sizes that first meet at these positions reach the threshold?"""
    small, large = np.minimum(sx, sy), np.maximum(sx, sy)
    bound = 1 + np.minimum(sx - i - 1, sy - j - 1)
    return (100 * small >= percent * large) & (100 * bound >= percent * (sx + sy - bound))


INDEX = pa.schema([("pair", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("size", pa.int32()), ("pos", pa.int32())])


def _index(percent: int):
    """Builds the lists of each bucket, rows coming by bucket; lists of the same sets become one.

    Gives rows of lists (a list, b set, size, pos) and of the first round's pairs (a, b).
    """

    def build(parts: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        tok, node, size, pos = (np.concatenate(parts[k]) for k in ("tok", "node", "size", "pos"))
        order = np.lexsort((node, size, tok))
        tok, node, size, pos = (x[order] for x in (tok, node, size, pos))
        first = _runs(tok, node)
        tok, node, size, pos = (x[first] for x in (tok, node, size, pos))
        start = _runs(tok)
        count = np.diff(np.r_[start, len(tok)])
        held = np.repeat(count >= 2, count)
        if not held.any():
            return
        node, size, pos, count = node[held], size[held], pos[held], count[count >= 2]
        start = np.cumsum(count) - count
        salted = node.view(U) * U(0x9E3779B97F4A7C15)
        mark = np.add.reduceat(salted ^ (salted >> U(29)), start)
        sig = np.repeat(mark, count)
        order = np.lexsort((pos, node, size, sig))
        sig, node, size, pos = (x[order] for x in (sig, node, size, pos))
        first = _runs(sig, node)
        sig, node, size, pos = (x[first] for x in (sig, node, size, pos))
        k = len(sig)
        yield pa.record_batch([pa.array(np.zeros(k, bool)), pa.array(sig.view(np.int64)), pa.array(node), pa.array(size), pa.array(pos.astype(np.int32))], schema=INDEX)
        # In each list all sets meet the one of the smallest node: lists of one group share it mostly, so
        # their pairs coincide. A set out of its reach meets its neighbour by size instead.
        size, pos = size.astype(np.int64), pos.astype(np.int64)
        start = _runs(sig)
        count = np.diff(np.r_[start, k])
        run = np.repeat(np.arange(len(start)), count)
        head = np.flatnonzero(node == np.minimum.reduceat(node, start)[run])[run]
        ahead = np.maximum(np.arange(k) - 1, np.repeat(start, count))
        partner = np.where(_reachable(size, size[head], pos, pos[head], percent), head, ahead)
        near = (node != node[head]) & (node != node[partner]) & _reachable(size, size[partner], pos, pos[partner], percent)
        x, y = node[near], node[partner[near]]
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0) if len(x) else np.empty((0, 2), np.int64)
        k = len(pairs)
        yield pa.record_batch([pa.array(np.ones(k, bool)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32())], schema=INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("tok", "node", "size", "pos")
        parts: dict[str, list[np.ndarray]] = {k: [] for k in names}
        now = None
        for batch in batches:
            for bucket, tok, doc, pos, nodes, sizes in zip(*(batch.column(k).to_pylist() for k in ("bucket", "tok", "doc", "pos", "nodes", "sizes")), strict=True):
                if bucket != now and parts["tok"]:
                    yield from build(parts)
                    parts = {k: [] for k in names}
                now = bucket
                doc = np.frombuffer(doc, np.uint32)
                parts["tok"].append(np.frombuffer(tok, np.uint32))
                parts["node"].append(np.frombuffer(nodes, np.int64)[doc])
                parts["size"].append(np.frombuffer(sizes, np.int32)[doc])
                parts["pos"].append(np.frombuffer(pos, np.uint32))
        if parts["tok"]:
            yield from build(parts)

    return run


def reaches(x: str, y: str, percent: int):
    """``_reachable`` of the columns size and pos of two structs."""
    sx, sy = F.col(f"{x}.size").cast("long"), F.col(f"{y}.size").cast("long")
    bound = 1 + F.least(sx - F.col(f"{x}.pos") - 1, sy - F.col(f"{y}.pos") - 1)
    return (100 * F.least(sx, sy) >= percent * F.greatest(sx, sy)) & (100 * bound >= percent * (sx + sy - bound))


CELL = ("list", "i", "j")


def _across(percent: int):
    """Pairs of different labels in each cell of a list, of its own rows with all; rows come by cell, size and pos."""

    def pairs(node, size, pos, label, mine) -> np.ndarray:
        """Blocks of one size are sorted by position: those out of reach are skipped, others cut where it ends."""
        found = [np.empty((0, 2), np.int64)]
        size, pos = size.astype(np.int64), pos.astype(np.int64)
        start = _runs(size)
        end = np.r_[start[1:], len(size)]
        sizes = size[start]
        low = np.searchsorted(sizes, -(-percent * size // 100))
        high = np.searchsorted(sizes, 100 * size // percent, side="right")
        for i in np.flatnonzero(mine):
            other = sizes[low[i] : high[i]]
            need = -(-percent * (size[i] + other) // (100 + percent))
            for k in np.flatnonzero(size[i] - pos[i] >= need):
                b = low[i] + k
                y = slice(start[b], start[b] + np.searchsorted(pos[start[b] : end[b]], other[k] - need[k], side="right"))
                far = label[y] != label[i]
                if far.any():
                    met = node[y][far]
                    found.append(np.stack([np.minimum(met, node[i]), np.maximum(met, node[i])], 1))
        return np.unique(np.concatenate(found), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def close() -> pa.RecordBatch | None:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            starts = np.r_[_runs(*columns[: len(CELL)]), len(columns[0])]
            out = [pairs(*(c[a:b] for c in columns[len(CELL) :])) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            both = np.unique(np.concatenate(out), axis=0)
            return pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"]) if len(both) else None

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in (*CELL, "node", "size", "pos", "label", "mine")]
            # The last cell may go on in the next batch; those before it are whole once the held ones are added.
            cut = int(_runs(*cols[: len(CELL)])[-1])
            if held and (cut or any(h[-1] != c[0] for h, c in zip(held[-1], cols[: len(CELL)], strict=False))):
                held.append([c[:cut] for c in cols])
                if (out := close()) is not None:
                    yield out
                held, cols = [], [c[cut:] for c in cols]
            elif cut:
                held.append([c[:cut] for c in cols])
                if (out := close()) is not None:
                    yield out
                held, cols = [], [c[cut:] for c in cols]
            held.append(cols)
        if held and (out := close()) is not None:
            yield out

    return run


def _set_blobs(n: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in _texts(batch):
                sets = shingle_sets(texts, n)
                yield pa.record_batch([pa.array([node_of(s, seed) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "grams"])

    return run


def _may_link(percent: int):
    """Drops pairs (a, b) of sizes m, n whose sketches x, y show that they cannot reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n, x, y = (batch.column(k).to_pylist() for k in ("m", "n", "x", "y"))
            # |x n y| <= (m + n - d) / 2 and |x u y| = m + n - |x n y|
            keep = pa.array([(100 + percent) * (p + q - apart(s, t)) >= 2 * percent * (p + q) for p, q, s, t in zip(m, n, x, y, strict=True)], pa.bool_())
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)

    return run


def _verify(percent: int):
    """Keeps the pairs (a, b) whose sets x and y reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(k).to_pylist() for k in ("a", "b", "x", "y"))
            keep = []
            for s, t in zip(x, y, strict=True):
                s, t = np.frombuffer(s, U), np.frombuffer(t, U)
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.record_batch([[v for v, k in zip(a, keep, strict=True) if k], [v for v, k in zip(b, keep, strict=True) if k]], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _hubs() -> list:
    """In each of HUBS classes of a list's sets, the foremost one by ``like``: what stands in most lists for its size
    is what a group of near copies has in common."""
    row = F.struct((-F.col("like")).alias("order"), "node", "size", "pos", "label")
    return [F.min(F.when(F.pmod(F.xxhash64("node"), F.lit(HUBS)) == c, row)).alias(f"h{c}") for c in range(HUBS)]


class JaccardJoin:
    """The join over one table of documents; ``labels`` and ``components`` are its results."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75):
        if not 0 < percent <= 100 or words < 1:
            raise ValueError(f"words {words}, percent {percent}")
        self.spark, self.words, self.percent = docs.sparkSession, words, percent
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
        for self.seed in range(8):
            both = written(self.docs.mapInArrow(released(_signatures(words, self.seed)), "doc_id long, node long, check long, n long, sketch binary, gram boolean"))
            sets = both.where("not gram")
            nodes = written(sets.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), (F.min("check") != F.max("check")).alias("clash")))
            if nodes.where("clash").isEmpty():
                break
            discard(both, nodes)  # two sets of one node: other nodes
        self.sets = sets.select("doc_id", "node", "n")
        self.nodes = nodes.where("doc_id is not null").drop("clash")
        heavy = both.where("gram").groupBy(F.col("node").alias("g")).agg(F.sum("n").alias("df")).where(F.col("df") >= HEAVY_AT)
        found = heavy.orderBy(F.desc("df"), "g").limit(MOST_HEAVY).toArrow()
        grams = found.column("g").to_numpy().view(U)
        order = np.argsort(grams)
        self._heavy = grams[order], len(grams) - order.astype(np.int64)

    def _sets_of(self, pairs: DataFrame) -> DataFrame:
        """(node, grams) of the sets that occur in pairs, computed from one document of each."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        need = written(self.nodes.select("node", "doc_id").join(nodes, "node").select("doc_id"))
        few = need.count() <= BROADCAST_ROWS
        texts = self.docs.join(F.broadcast(need) if few else need, "doc_id", "left_semi")
        blobs = texts.mapInArrow(released(_set_blobs(self.words, self.seed)), "node long, grams binary")
        return written(blobs.dropDuplicates(["node"]))

    def _with_both(self, pairs: DataFrame, sets: DataFrame, *columns: tuple[str, str, str]) -> DataFrame:
        """Stored pairs (a, b) with columns of both sets, given as (column, its name for a, its name for b)."""
        x = sets.select(F.col("node").alias("a"), *(F.col(c).alias(p) for c, p, _ in columns))
        y = sets.select(F.col("node").alias("b"), *(F.col(c).alias(q) for c, _, q in columns))
        # A hub is in many pairs on either side. Its row is met by broadcast, so that no task gets all of them; rows that
        # are too large together for that are dealt to all tasks, and the pairs to one of them each.
        share = max(HUB_PAIRS, 2 * pairs.count() // partitions(self.spark))
        often = [r[0] for r in pairs.select(F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(k).alias("node")) for k in "ab"))).alias("e")).groupBy("e").count().where(F.col("count") > share).select("e.node").distinct().collect()]
        if not often:
            return pairs.join(x, "a").join(y, "b")
        hubs = self.spark.createDataFrame([(n,) for n in often], "node long")
        own = written(sets.join(F.broadcast(hubs), "node"))
        sizes = [F.octet_length(c) if own.schema[c].dataType == BinaryType() else F.lit(8) for c, _, _ in columns]
        size = own.agg(F.sum(sum(sizes, F.lit(8)))).first()[0] or 0
        hot, n = pairs, partitions(self.spark)
        for key, other, side, names in (("a", "b", x, [p for _, p, _ in columns]), ("b", "a", y, [q for _, _, q in columns])):
            near = own.select(F.col("node").alias(key), *(F.col(c).alias(n) for (c, _, _), n in zip(columns, names, strict=True)))
            keys = F.broadcast(hubs.select(F.col("node").alias(key)))
            if size <= HUB_BYTES:
                met = hot.join(F.broadcast(near), key)
            else:
                dealt = hot.join(keys, key, "left_semi").withColumn("__part", F.pmod(F.xxhash64(other), F.lit(n)).cast("int"))
                met = dealt.join(near.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), [key, "__part"]).drop("__part")
            hot = hot.join(keys, key, "left_anti").join(side, key).unionByName(met)
        return hot

    def _linked(self, pairs: DataFrame) -> DataFrame:
        """The links among stored pairs."""
        sized = self._with_both(pairs, self.nodes, ("n", "m", "n"), ("sketch", "x", "y"))
        left = written(sized.select("a", "b", "m", "n", "x", "y").mapInArrow(released(_may_link(self.percent)), "a long, b long"))
        sets = self._sets_of(left)
        found = written(self._with_both(left, sets, ("grams", "x", "y")).select("a", "b", "x", "y").mapInArrow(released(_verify(self.percent)), "a long, b long"))
        discard(left, sets)
        return found

    def _open(self, lists: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of lists with labels, and the lists (list, k sets) whose sets have several, both stored."""
        rows = written(lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
        several = rows.groupBy("list").agg(F.count("*").alias("k"), F.min("label").alias("lo"), F.max("label").alias("hi"), *_hubs()).where("lo <> hi")
        return rows, written(several.drop("lo", "hi"))

    def _stars(self, rows: DataFrame, several: DataFrame) -> DataFrame:
        """Pairs of each set of an open list with the list's hubs, and with as many outside the first one's label."""
        names = [f"h{c}" for c in range(HUBS)]
        hubs = several.select("list", "k", F.array_compact(F.array(*names)).alias("hubs"), F.least(*names)["label"].alias("main"))
        near = many_to_one(rows, hubs, ["list"], "k")
        others = written(near.where("label <> main").groupBy("list").agg(F.max("k").alias("k"), *_hubs()))
        away = many_to_one(rows, others.select("list", "k", F.array_compact(F.array(*names)).alias("hubs")), ["list"], "k")
        met = near.drop("main").unionByName(away).select(F.struct("node", "size", "pos", "label").alias("x"), F.explode("hubs").alias("y"))
        met = met.where("x.label <> y.label").where(reaches("x", "y", self.percent))
        return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    def _cells(self, rows: DataFrame, several: DataFrame) -> DataFrame:
        """Rows of open lists by cell: sets outside a list's most frequent label (mine) are to meet all others.

        A long list is a grid, of so many of the former and of so many of all to a cell, and its rows go to the cells
        of their line and column only.
        """
        by_label = many_to_one(rows, several.select("list", "k"), ["list"], "k").groupBy("list", "label").agg(F.count("*").alias("n"), F.max("k").alias("k"))
        main = written(by_label.groupBy("list").agg(F.max("k").alias("k"), F.max(F.struct("n", "label")).alias("main")))
        cells = lambda c: F.greatest(F.lit(1), F.ceil(c / LONG_LIST)).cast("int")
        grid = main.select("list", "k", F.col("main.label").alias("main"), cells(F.col("k") - F.col("main.n")).alias("lines"), cells(F.col("k")).alias("columns"))
        own = many_to_one(rows, grid, ["list"], "k").withColumn("mine", F.col("label") != F.col("main"))
        line, column = F.pmod(F.xxhash64("node"), F.col("lines")).cast("int"), F.pmod(F.xxhash64("node"), F.col("columns")).cast("int")
        kept = ["list", "node", "size", "pos", "label"]
        whole = own.where("lines * columns = 1").select(*kept, "mine", F.lit(0).alias("i"), F.lit(0).alias("j"))
        large = own.where("lines * columns > 1")
        met = large.select(*kept, F.lit(False).alias("mine"), F.explode(F.sequence(F.lit(0), F.col("lines") - 1)).alias("i"), column.alias("j"))
        mine = large.where("mine").select(*kept, "mine", line.alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"))
        both = whole.unionByName(met).unionByName(mine).select(*CELL, "node", "size", "pos", "label", "mine")
        return both.repartition(partitions(self.spark), *CELL).sortWithinPartitions(*CELL, "size", "pos", "node")

    def labels(self) -> DataFrame:
        """(node, label) of every set with a link: the smallest node that verified links reach.

        Labels are kept up: a round adds the links that it finds to those that lead to the labels so far.
        """
        n = partitions(self.spark)
        entries = (self.nodes.agg(F.sum("n")).first()[0] or 0) * (100 - self.percent) // 100
        buckets = max(4 * n, -(-entries // BUCKET))
        prefixes = self.docs.where("doc_id is not null").mapInArrow(released(_prefixes(self.words, self.percent, self.seed, *self._heavy, buckets)), "bucket long, tok binary, doc binary, pos binary, nodes binary, sizes binary")
        index = written(prefixes.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(released(_index(self.percent)), "pair boolean, a long, b long, size int, pos int"))
        lists = index.where("not pair").select(F.col("a").alias("list"), F.col("b").alias("node"), "size", "pos")
        often = lists.groupBy("node").agg((F.count("*") / F.max("size")).alias("like"))
        lists = written(lists.join(often, "node"))
        tried = written(index.where("pair").select("a", "b").distinct())
        discard(index)
        labels = written(components(self._linked(tried)))
        for star in (*[True] * STAR_ROUNDS, False):
            rows, several = self._open(lists, labels)
            if several.isEmpty():
                break
            found = self._stars(rows, several) if star else self._cells(rows, several).mapInArrow(released(_across(self.percent)), "a long, b long")
            pairs = written(found.distinct().join(tried, ["a", "b"], "left_anti"))
            discard(rows, several)
            if pairs.isEmpty():
                continue
            known = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
            tried, labels = tried.unionByName(pairs), written(components(known.unionByName(self._linked(pairs))))
        return labels

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id: one row per document."""
        labels = self.labels()
        own = self.sets.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node"))
        # Written, so that both sides of the join are plain shuffles, of which Spark can split a hot component.
        least = written(own.groupBy("comp").agg(F.min("doc_id").alias("least")))
        return own.join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """Set size and component of every document under Jaccard similarity of its distinct word n-grams.

    A-Z is lowered; words are runs of bytes other than space and \\x09-\\x0D. A text with fewer words than
    ``words`` has its whole sequence as its only element; one without words, or null, has the empty set and
    is linked with nothing. Documents are linked when 100 * |intersection| >= percent * |union|, compared in
    integers. component_id is the smallest identifier reachable by links, the document itself included. A
    row without identifier neither makes nor gets a link of its own. Repeated rows give repeated rows; an
    empty table gives none; other columns are ignored. Grams are compared by 64-bit
    hashes; no two different sets of such share a node.
    """
    return JaccardJoin(docs, id_col, text_col, words, percent).components()


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that come first, by identifier, in their component, with their columns as they are.

    Rows without identifier stay; rows that share an identifier stay or go together.
    """
    found = jaccard_components(docs, id_col, text_col, words, percent)
    return without(docs, found.where("doc_id <> component_id").select("doc_id"), F.col(id_col).cast("long"))
