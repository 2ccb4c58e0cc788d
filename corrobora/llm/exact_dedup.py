"""Exact deduplication with compressed radix tries owned by length-and-content-hash partitions.

Each scan task first collapses its own copies, so that a text travels once per scan task however many
copies that task holds. The collapsed texts are dealt by byte length and content hash; the owner of a
partition inserts their full byte strings into a radix trie, whose terminal nodes keep the identifier
that stays and the number of rows. A trie above ``SPILL_BYTES`` moves subtrees to files, of which each is taken up
as a trie of its own later. Equality is decided by the byte strings, never by a hash.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm.common import fresh, partitions, released, text_or_empty, without, written

#: Bytes of labels that a task's trie holds before it moves a subtree to disk.
SPILL_BYTES = 96 << 20
#: Bytes of text that a scan task collapses at a time.
LOCAL_BYTES = 48 << 20
#: What a node takes beside its label.
NODE_BYTES = 200


class Node:
    __slots__ = ("end", "kids", "label", "spill")

    def __init__(self, label: bytes):
        self.label, self.kids, self.end, self.spill = label, {}, None, None


class Spilled:
    """Keys below a node, in a file, and what had been moved from below before, by its place under the node."""

    __slots__ = ("file", "parts")

    def __init__(self) -> None:
        self.file, self.parts = tempfile.TemporaryFile(), []

    def add(self, *entry) -> None:
        pickle.dump(entry, self.file)

    def entries(self) -> Iterator[tuple]:
        stack = [(b"", self)]
        while stack:
            prefix, held = stack.pop()
            held.file.seek(0)
            while True:
                try:
                    key, *more = pickle.load(held.file)
                except EOFError:
                    break
                yield prefix + key, *more
            held.file.close()
            stack.extend((prefix + place, part) for place, part in held.parts)


class RadixTrie:
    """Byte strings to terminal payloads [count, best identifier, best representative, representatives].

    Memory holds the labels; above ``limit`` the keys below a heavy node move to a file, relative to that node,
    which keeps its own label. A key that the trie holds alone never moves, as moving it gains nothing.
    """

    def __init__(self, better, limit: int = SPILL_BYTES):
        self.root, self.held, self.better, self.limit, self.ceiling = Node(b""), 0, better, limit, limit

    def insert(self, key: bytes, count: int, best, rep: int, reps: list[int] | None = None) -> None:
        """Adds ``count`` rows; ``reps`` are all representatives where these are more than the best one, ``rep``."""
        node, at = self.root, 0
        while at < len(key) and node.spill is None:
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self.held += len(kid.label) + NODE_BYTES
                node, at = kid, len(key)
                break
            label = kid.label
            if key.startswith(label, at):
                node, at = kid, at + len(label)
                continue
            same = shared_prefix(label, key, at)
            upper = Node(label[:same])
            kid.label = label[same:]
            upper.kids[kid.label[0]] = kid
            node.kids[key[at]] = upper
            self.held += NODE_BYTES
            node, at = upper, at + same
        if node.spill is not None:
            node.spill.add(key[at:], count, best, rep, reps)
            return
        if node.end is None:
            node.end = [0, best, rep, []]
        end = node.end
        end[0] += count
        end[3].extend(reps or [rep])
        if self.better((best, rep), (end[1], end[2])):
            end[1], end[2] = best, rep
        if self.held > self.ceiling:
            self.spill()

    def spill(self) -> None:
        """Moves what stands below the deepest node that holds more than half of all, then the root's heaviest kids.

        The first leaves that node with its whole label, so keys with a long common prefix move by what follows it;
        the second takes over where no such node is below the root. A lone key stays.
        """
        total = weights(self.root)
        node = self.root
        while heavy := [kid for kid in node.kids.values() if kid.kids and 2 * total[id(kid)] > total[id(self.root)]]:
            node = heavy[0]
        if node is not self.root:
            self.move(node, total)
        elif len(self.root.kids) > 1:
            for kid in sorted((k for k in self.root.kids.values() if k.spill is None), key=lambda k: -total[id(k)]):
                if 2 * self.held <= self.limit:
                    break
                # Of a leaf the first byte stays, by which it is told from the other kids.
                rest, kid.label = (kid.label[1:], kid.label[:1]) if not kid.kids else (b"", kid.label)
                self.move(kid, total, rest)
        # What cannot be moved is not tried again until it has doubled.
        self.ceiling = max(self.limit, 2 * self.held)

    def move(self, node: Node, total: dict[int, int], rest: bytes = b"") -> None:
        out, stack = Spilled(), [(node, rest)]
        while stack:
            below, key = stack.pop()
            if below.spill is not None:
                out.parts.append((key, below.spill))
            if below.end is not None:
                out.add(key, *below.end)
            stack.extend((kid, key + kid.label) for kid in below.kids.values())
        self.held -= total[id(node)] - len(node.label) - NODE_BYTES
        node.kids, node.end, node.spill = {}, None, out

    def groups(self) -> Iterator[list]:
        """The terminal payloads; the files' tries are built one after another, from a list of work."""
        tries, files = [self], []
        while tries or files:
            if not tries:
                trie = RadixTrie(self.better, self.limit)
                for entry in files.pop().entries():
                    trie.insert(*entry)
                tries.append(trie)
            stack = [tries.pop().root]
            while stack:
                node = stack.pop()
                if node.spill is not None:
                    files.append(node.spill)
                if node.end is not None:
                    yield node.end
                stack.extend(node.kids.values())


def shared_prefix(label: bytes, key: bytes, at: int) -> int:
    low, high = 1, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[:mid] == key[at : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def weights(root: Node) -> dict[int, int]:
    """Bytes of each node with all below it."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(node.kids.values())
    total: dict[int, int] = {}
    for node in reversed(order):
        total[id(node)] = len(node.label) + NODE_BYTES + sum(total[id(kid)] for kid in node.kids.values())
    return total


def _largest(a, b) -> bool:
    """Is candidate a better than b: the larger identifier, then the smaller representative; null is least."""
    (x, r), (y, s) = a, b
    if x == y:
        return r < s
    return y is None or (x is not None and x > y)


def _smallest(a, b) -> bool:
    (x, r), (y, s) = a, b
    if x == y:
        return r < s
    return y is None or (x is not None and x < y)


LOCAL = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("rep", pa.int64()), ("first", pa.bool_()), ("n", pa.int64()), ("text", pa.binary())])
OWNED = pa.schema([("rep", pa.int64()), ("keep_id", pa.int64()), ("keep_rep", pa.int64()), ("group_size", pa.int64())])


def _collapse(keep_largest: bool):
    better = _largest if keep_largest else _smallest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 40, 0
        ids: list = []
        shas: list = []
        where: list[int] = []
        seen: dict[bytes, int] = {}
        best: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, held
            count = [0] * len(best)
            for g in where:
                count[g] += 1
            first = [best[g] == i for i, g in enumerate(where)]
            texts = list(seen)
            out = pa.record_batch(
                [ids, shas, [base + made + g for g in where], first, [count[g] if f else None for g, f in zip(where, first, strict=True)], [texts[g] if f else None for g, f in zip(where, first, strict=True)]],
                schema=LOCAL,
            )
            made += len(best)
            held = 0
            for x in (ids, shas, where, seen, best):
                x.clear()
            return out

        for batch in batches:
            for doc_id, text, sha in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                g = seen.setdefault(text, len(seen))
                i = len(ids)
                if g == len(best):
                    best.append(i)
                    held += len(text) + 200
                elif better((doc_id, i), (ids[best[g]], best[g])):
                    best[g] = i
                ids.append(doc_id)
                shas.append(sha)
                where.append(g)
                held += 100
                if held > LOCAL_BYTES:
                    yield flush()
        if ids:
            yield flush()

    return run


def _own(keep_largest: bool):
    better = _largest if keep_largest else _smallest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie(better)
        for batch in batches:
            for doc_id, rep, n, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                trie.insert(text, n, doc_id, rep)
        rows: list[tuple] = []
        for count, best, keep_rep, reps in trie.groups():
            rows.extend((rep, best, keep_rep, count) for rep in reps)
            if len(rows) >= 50_000:
                yield pa.record_batch([list(x) for x in zip(*rows, strict=True)], schema=OWNED)
                rows = []
        if rows:
            yield pa.record_batch([list(x) for x in zip(*rows, strict=True)], schema=OWNED)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """Group size and surviving row of every row's text.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per input row. A null text counts as
    the empty text. Of equal texts the row with the ``keep`` ("largest" or "smallest") identifier stays; a
    null identifier loses to any other. When the same identifier and text occur twice, exactly one of these
    rows is kept. An empty table gives no rows; other columns are ignored.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep: {keep!r}")
    text = text_or_empty(text_col).cast("binary")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("sha"))
    # Written, as both the owners and the last join read it and the representatives must be the same for both.
    local = written(source.mapInArrow(released(_collapse(keep == "largest")), "doc_id long, sha binary, rep long, first boolean, n long, text binary"))
    reps = local.where("first").select("doc_id", "rep", "n", "text")
    n = partitions(docs.sparkSession)
    owned = reps.repartition(n, F.octet_length("text"), F.xxhash64("text")).mapInArrow(released(_own(keep == "largest")), "rep long, keep_id long, keep_rep long, group_size long")
    return local.drop("text", "n").join(owned, "rep").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("first") & (F.col("rep") == F.col("keep_rep"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with their columns as they are.

    Rows that repeat identifier and text are told apart by nothing here: one of them stays.
    """
    verdicts = written(exact_dedup(docs, id_col, text_col, keep))
    key = ["doc_id", "text_sha256"]
    per_key = verdicts.groupBy(*key).agg(F.max("kept").alias("kept"), F.count("*").alias("k"))
    own = F.col(id_col).cast("long"), F.sha2(text_or_empty(text_col).cast("binary"), 256)
    left = without(docs, per_key.where("not kept").select(*key), *own)
    repeated = per_key.where("kept and k > 1").select(*key)
    if repeated.isEmpty():
        return left
    once = without(left, repeated, *own)
    ident, sha, i, s = fresh(docs.columns, "__id", "__sha", "__i", "__s")
    again = left.withColumns({ident: own[0], sha: own[1]}).join(repeated.toDF(i, s), F.col(ident).eqNullSafe(F.col(i)) & (F.col(sha) == F.col(s)), "left_semi")
    return once.unionByName(again.dropDuplicates([ident, sha]).select(*docs.columns))
