"""Chunks of long segments, made by many tasks; a segment may be longer than any value.

Where a chunk starts depends on where the one before it ended, all the way from the start. But a start is enough to know
the next one, so a block of text is a function from the first start in it to the first one behind it. Each block's
function is tabled by itself, for all starts that can be its first; following the tables from block to block gives the
true starts and the chunks before them, and then every block cuts its own chunks. So many tables that a task should not
hold them are made one table of their own, level by level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrobora.functions import text as T
from corrobora.tables import discard, written

LOOKBACK = 120
#: Characters of a block; longer ones where chunks are so long that tables would be as long as texts.
BLOCK = 1 << 20
#: Blocks whose tables are followed by one task; fewer where tables are long.
FAN = 1024
_SPACE = T.SPACE.replace("\\x0B", "\x0b")
_SOLID = re.compile(T.NOT_SPACE.replace("\\x0B", "\x0b"))
SENTENCE_CUT = re.compile(rf"(?s)^(.*[.!?]){_SPACE}")
SPACE_CUT = re.compile(rf"(?s)^(.*{_SPACE})")

#: A text's part within a block, ``at`` characters from the segment's start.
PARTS = "row long, block int, at long, total long, text string"
_PARTS = pa.schema([("row", pa.int64()), ("block", pa.int32()), ("at", pa.int64()), ("total", pa.int64()), ("text", pa.string())])
TABLES = "row long, block int, total long, exits array<int>, counts array<int>"
_TABLES = pa.schema([("row", pa.int64()), ("block", pa.int32()), ("total", pa.int64()), ("exits", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
STARTS = "row long, block int, start long, ord long"
STRETCHES = "part int, nth int, source string, doc_id long, before long, chars long, solid boolean, text string"
_STRETCHES = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("source", pa.string()), ("doc_id", pa.int64()), ("before", pa.int64()), ("chars", pa.int64()), ("solid", pa.bool_()), ("text", pa.string())])
SPANS = "row long, ord long, char_start long, char_end long, text string"
_SPANS = pa.schema([("row", pa.int64()), ("ord", pa.int64()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("text", pa.string())])


@lru_cache(1)
def kinds() -> np.ndarray:
    """Of each code point below 0x10000: bit 0 for white space, bit 1 for a sentence's mark."""
    out = np.zeros(0x10001, np.uint8)
    space = re.compile(_SPACE)
    out[[p for p in range(0x10000) if not 0xD800 <= p < 0xE000 and space.match(chr(p))]] = 1
    out[[ord(x) for x in ".!?"]] = 2
    return out


def length_of_block(size: int, least: int = BLOCK) -> int:
    return max(least, 16 * size)


def end_of(text: str, start: int, size: int, n: int) -> int:
    """Where a chunk from ``start`` ends in a text of ``n`` characters, of which the next ``size`` and one more are there."""
    end = min(start + size, n)
    if end < n:
        low = max(start + 1, end - LOOKBACK)
        cut = SENTENCE_CUT.match(text[low : end + 1]) or SPACE_CUT.match(text[low:end])
        end = low + len(cut[1]) if cut else end
    return end


def next_of(start: int, end: int, n: int, overlap: int) -> int:
    """Where the chunk after the one from ``start`` to ``end`` starts; ``n`` if that was the last one."""
    if end >= n:
        return n
    return end - overlap if end - overlap > start else end


def following(text: str, starts: int, at: int, total: int, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For the first ``starts`` places of a piece of text that begins at ``at``: where a chunk from there ends, and where
    the next one starts (``total``: nowhere). The piece must go on for ``size`` characters and one more, if the text does."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(c)
    kind = kinds()[np.minimum(c, 0x10000)]
    space, stop = (kind & 1).view(bool), kind == 2
    place = np.arange(n + 1, dtype=np.int32)
    # The last cut at or before each place, -1 if there is none: behind a sentence's mark and before white space, or behind white space.
    sentence, word = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32)
    np.copyto(sentence[1:n], place[1:n], where=stop[:-1] & space[1:])
    np.copyto(word[1:], place[1:], where=space)
    sentence, word = np.maximum.accumulate(sentence), np.maximum.accumulate(word)
    s, most = place[:starts], min(total - at, 2**31 - 1)
    end = np.minimum(s + size, most).astype(np.int32)
    low = np.maximum(s + 1, end - LOOKBACK)
    last = end >= total - at
    e = np.minimum(end, n)
    by_sentence, by_word = sentence[e], word[e]
    cut = np.where(by_sentence > low, by_sentence, np.where(by_word > low, by_word, end))
    end = np.where(last, end, cut)
    after = np.where(end - overlap > s, end - overlap, end)
    return end.astype(np.int64) + at, np.where(last, total, after.astype(np.int64) + at)


def walks(text: str, block: int, length: int, total: int, size: int, overlap: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """From each place among the first ``size`` ones of a block, the first start at or behind the block's end, and the
    chunks on the way.

    Ways from different places soon meet in most texts, so they are walked, each up to where another one has been. Where
    more than ``most`` chunks were made and there are places left, all places of the block are taken at once."""
    at = block * length
    inside = min(length, total - at)
    left, n = inside // 16 if most is None else most, total - at
    known: dict[int, tuple[int, int]] = {}
    for first in range(min(size, inside)):
        way, here = [], first
        while here < inside and here not in known and left > 0:
            way.append(here)
            here = next_of(here, end_of(text, here, size, n), n, overlap)
            left -= 1
        if here < inside and here not in known:
            break
        out, count = (here, 0) if here >= inside else known[here]
        for k, place in enumerate(reversed(way), count + 1):
            known[place] = out, k
    else:
        found = np.array([known[k] for k in range(min(size, inside))], np.int64)
        return found[:, 0] + at, found[:, 1].astype(np.int32)
    _, after = following(text, inside, at, total, size, overlap)
    # Places from the block's start; the last one is the end, and stays.
    out = np.r_[after - at, inside].astype(np.int32)
    count = np.r_[np.ones(inside, np.int32), np.int32(0)]
    # Twice as far each time, as long as some start within the block is left behind.
    where = np.minimum(out, inside)
    while (where[:size] < inside).any():
        within = where < inside
        out = np.where(within, out[where], out)
        count += np.where(within, count[where], 0)
        where = where[where]
    first = min(size, inside)
    return out[:first].astype(np.int64) + at, count[:first]


def table(text: str, block: int, length: int, total: int, size: int, overlap: int) -> np.ndarray:
    """From each place among the first ``size`` ones of a block, the first start at or behind the block's end."""
    return walks(text, block, length, total, size, overlap)[0]


def _dealt(length: int, size: int):
    """Texts (row, at, total, gap, text) at their places in segments, ``gap`` line feeds before them, as parts of the
    blocks that they are in and of those that look on into them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, at, total, gap, text = (batch.column(k)[i].as_py() for k in range(5))
                text = "\n" * gap + text
                total, end = len(text) if total is None else total, at + len(text)
                for b in range(max(0, (at - size - 1) // length), -(-end // length)):
                    a, z = max(at, b * length), min(end, (b + 1) * length + size + 1)
                    if a < z:
                        yield pa.record_batch([[row], [b], [a], [total], [text[a - at : z - at]]], schema=_PARTS)

    return run


def _entries(group: pa.Table, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Start, end, exits and counts of a group's blocks, which are in order."""
    for block, total, exits, counts in zip(group.column("block").to_pylist(), group.column("total").to_pylist(), group.column("exits"), group.column("counts"), strict=True):
        yield block * length, min((block + 1) * length, total), exits.values.to_numpy(), counts.values.to_numpy()


def composed(group: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The table of blocks that follow each other, as if they were one."""
    at = count = None
    for base, end, exits, counts in _entries(group, length):
        if at is None:
            at, count = exits + np.int64(end), counts.astype(np.int64)
            continue
        within = at < end
        k = at[within] - base
        count[within] += counts[k]
        at[within] = exits[k] + np.int64(end)
    return at - end, count


def _compose(length: int, fan: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        exits, counts = composed(group, length)
        first = group.slice(0, 1)
        return pa.table([first.column("row"), [first.column("block")[0].as_py() // fan], [group.column("total")[0].as_py()], [exits.tolist()], [counts.tolist()]], schema=_TABLES)

    return run


def _follow(length: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        at, ord, found = group.column("start")[0].as_py(), group.column("ord")[0].as_py(), []
        for base, end, exits, counts in _entries(group, length):
            found.append((at, ord))
            if at < end:
                at, ord = end + int(exits[at - base]), ord + int(counts[at - base])
        at, ord = zip(*found, strict=True)
        return pa.table([group.column("row"), group.column("block"), pa.array(at, pa.int64()), pa.array(ord, pa.int64())], names=["row", "block", "start", "ord"])

    return run


def _starts(tables: DataFrame, length: int, fan: int) -> DataFrame:
    """(row, block, start, ord): the first chunk that starts in or behind each block. A task holds ``fan`` tables."""
    up = F.floor(F.col("block") / fan).cast("int")
    levels = [tables.withColumn("up", up)]
    while (levels[-1].agg(F.max("up")).first()[0] or 0) > 0:
        above = levels[-1].groupBy("row", "up").applyInArrow(_compose(length * fan ** (len(levels) - 1), fan), TABLES)
        levels.append(written(above).withColumn("up", up))
    starts = None
    for k in reversed(range(len(levels))):
        if starts is None:
            met = levels[k].withColumn("start", F.lit(0).cast("long")).withColumn("ord", F.lit(0).cast("long"))
        else:
            met = levels[k].join(starts.withColumnRenamed("block", "up"), ["row", "up"])
        starts = written(met.groupBy("row", "up").applyInArrow(_follow(length * fan**k), STARTS))
    return starts


def _cut(parts: DataFrame, size: int, overlap: int, length: int) -> DataFrame:
    """(row, ord, char_start, char_end, text): the chunks of segments that are there as parts of blocks."""

    def tabled(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        row, block, total = (group.column(c)[0].as_py() for c in ("row", "block", "total"))
        text = "".join(group.column("text").to_pylist())
        exits, counts = walks(text, block, length, total, size, overlap)
        end = min((block + 1) * length, total)
        return pa.table([[row], [block], [total], [(exits - end).tolist()], [counts.tolist()], [text]], schema=_TABLES.append(pa.field("text", pa.string())))

    blocks = written(parts.groupBy("row", "block").applyInArrow(tabled, TABLES + ", text string"))
    fan = max(2, min(FAN, (1 << 22) // size))
    starts = _starts(blocks.drop("text"), length, fan)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, block, total, text, start, ord = (batch.column(k)[i].as_py() for k in range(6))
                base = block * length
                n, at, rows = total - base, start - base, []
                inside = min(length, n)
                while at < inside:
                    end = end_of(text, at, size, n)
                    rows.append((row, ord + len(rows), base + at, base + end, text[at:end]))
                    at = next_of(at, end, n, overlap)
                for a in range(0, len(rows), 512):
                    yield pa.record_batch([list(c) for c in zip(*rows[a : a + 512], strict=True)], schema=_SPANS)

    met = blocks.join(starts, ["row", "block"]).select("row", "block", "total", "text", "start", "ord")
    return met.mapInArrow(cut, SPANS)


def chunk_long(segments: DataFrame, size: int, overlap: int, length: int = BLOCK) -> DataFrame:
    """(doc_id, page, seg, char_start, char_end, text) of segments (doc_id, page, seg, text) with normalised texts.

    ``size`` and ``overlap`` must be in their bounds already. Segments that are shorter than a block are one block.
    """
    length = length_of_block(size, length)
    # Rows that repeat are told apart.
    numbered = written(segments.select("doc_id", "page", "seg", "text").withColumn("__row", F.monotonically_increasing_id()))
    texts = numbered.select("__row", F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(0), "text")
    chunks = _cut(texts.mapInArrow(_dealt(length, size), PARTS), size, overlap, length)
    about = numbered.select(F.col("__row").alias("row"), "doc_id", "page", "seg")
    spans = (F.col(c).cast("int").alias(c) for c in ("char_start", "char_end"))
    return chunks.join(about, "row").select("doc_id", "page", "seg", *spans, "text")


def _stretches(longest: int):
    """Sorted texts (part, source, doc_id, text) of one partition as stretches of some ``longest`` characters.

    Texts meet at a line feed, and runs of line feeds are two at most. Whether those before a stretch are kept depends
    on what comes before it, so they are counted (``before``) and left out. A source's last row here counts those behind
    its last stretch, and has no text, but the least identifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, now, least = None, 0, None, None
        pending, before, kept, chars, solid = 0, 0, [], 0, False

        def row(text: str, before: int, least: int | None) -> pa.RecordBatch:
            return pa.record_batch([[part], [nth], [now], pa.array([least], pa.int64()), [before], [len(text)], [solid], [text]], schema=_STRETCHES)

        for batch in batches:
            for p, source, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part is None:
                    part, now = p, source
                new = source != now
                if kept and (new or chars >= longest):
                    yield row("".join(kept), before, None)
                    nth, kept, chars, solid = nth + 1, [], 0, False
                if new:
                    yield row("", pending, least)
                    nth, now, least, pending = nth + 1, source, None, 0
                if doc_id is not None and (least is None or doc_id < least):
                    least = doc_id
                core = text.lstrip("\n")
                pending += 1 + len(text) - len(core)
                if core:
                    feeds = min(2, pending)
                    if kept:
                        kept.append("\n" * feeds)
                        chars += feeds
                    else:
                        before = pending
                    text = core.rstrip("\n")
                    kept.append(text)
                    chars += len(text)
                    solid = solid or bool(_SOLID.search(text))
                    pending = len(core) - len(text)
        if part is not None:
            if kept:
                yield row("".join(kept), before, None)
                nth, solid = nth + 1, False
            yield row("", pending, least)

    return run


def chunk_joined(texts: DataFrame, size: int = 1200, overlap: int = 200, length: int = BLOCK) -> DataFrame:
    """(segment, ord, char_start, char_end, text): the chunks of each source's texts, joined by line feeds in order of
    ``doc_id`` and normalised; ``segment`` is the least one.

    ``texts`` has (source string, doc_id long, text string). No task holds a source's text: ranges of texts are made
    stretches, whose places in their segment come from sums over one row per stretch.
    """
    size = max(100, min(100_000, int(size)))
    overlap = max(0, min(size - 1, int(overlap)))
    length = length_of_block(size, length)
    order = F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_last()
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select("source", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    normalised = ranged.select(F.spark_partition_id().alias("part"), "source", "doc_id", T.norm_for_chunks("text").alias("text"))
    stretches = written(normalised.mapInArrow(_stretches(length), STRETCHES))

    whole = Window.partitionBy("source")
    so_far = whole.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = so_far.rowsBetween(Window.unboundedPreceding, -1)
    # The first text has no line feed to meet another one at.
    about = stretches.drop("text").withColumn("feeds", F.sum("before").over(so_far) - 1)
    about = about.withColumn("last", F.lead("nth").over(whole.orderBy("part", "nth")).isNull())
    left = F.col("feeds") - F.coalesce(F.max(F.when(F.col("chars") > 0, F.col("feeds"))).over(earlier), F.lit(0))
    about = about.withColumn("gap", F.when((F.col("chars") > 0) | F.col("last"), F.least(left, F.lit(2))).otherwise(0).cast("int"))
    wide = F.col("gap") + F.col("chars")
    about = about.select(
        "part", "nth", "gap", F.coalesce(F.sum(wide).over(earlier), F.lit(0)).alias("at"), F.sum(wide).over(whole).alias("total"), F.max("solid").over(whole).alias("solid"),
        F.min(F.shiftleft(F.col("part").cast("long"), 32) + F.col("nth")).over(whole).alias("row"), F.min("doc_id").over(whole).alias("segment"),
    )
    placed = written(about.where("solid"))
    parts = stretches.join(placed, ["part", "nth"]).select("row", "at", "total", "gap", "text").mapInArrow(_dealt(length, size), PARTS)
    chunks = _cut(parts, size, overlap, length)
    discard(stretches)
    return chunks.join(placed.select("row", "segment").distinct(), "row").select("segment", "ord", "char_start", "char_end", "text")
