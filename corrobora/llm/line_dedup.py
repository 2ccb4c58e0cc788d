"""Near-duplicate lines by a deletion-neighbourhood join over words.

Two lines are alike when their word sequences are equal, or when both have at least ``min_words`` words and
one insertion, deletion or substitution of a word turns one into the other. Every line emits the hashed keys
of its variants within that bound: itself and itself without its i-th word. Lines that agree after dropping
the same position, or of which one equals the other without a word, are alike, so the earliest line of each
such key is a witness for all others and no key needs its pairs spelled out. Witnesses are verified on words.

One edit leaves the first or the last four words as they are, and indeed one half of the line. Only lines
that share an end, and then a half, with another distinct line emit variants; the rest have no neighbour.

With ``percent``, a line of n words may have max(1, n * percent // 100) edits, n being the longer one's. k edits
leave all but 3 k of a line's three-word grams, so of two such lines the 3 k + 1 grams that come first in any
common order share one. Grams that are frequent in a sample come last in that order. Of the lines that share
such a gram a line meets the earliest first, in growing rounds, until one is verified by edit distance; a group
of lines that are alike needs no pairs beyond its first ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrobora.llm.common import BROADCAST_ROWS, fresh, many_to_one, text_or_empty, written
from corrobora.llm.wordhash import blocks, grams, mix, word_hashes

U = np.uint64
BLOCK = 4 << 20
ANCHOR = 4
FIRST = 0xC2B2AE3D27D4EB4F
#: Of the keys' polynomials.
PRIME, BASES = (1 << 31) - 1, (1_103_515_245, 1_597_334_677)
NULL_ID = -(2**63)
#: Words of a gram of the wide bound, and the most percent for which the grams are sure to share one.
GRAM, MOST_PERCENT = 3, 20
#: Counters of frequent grams, and one document in so many that is counted. Both only shape an order.
HEATS, SAMPLED = 1 << 18, 16
#: The first round meets the lines of ranks below this; each later round reaches so many times as far.
REACH = 4


class Lines:
    """Word hashes of many lines with running sums of polynomials modulo a prime, from which any run's key follows.

    There are two of them, in different halves of the hashes and at different bases, so that no pattern of words
    makes different runs equal.
    """

    def __init__(self, lines: list[bytes]):
        self.words, self.at = word_hashes(lines)
        n = len(self.words)
        self.up = [powers(base, n) for base in BASES]
        self.down = [powers(pow(base, -1, PRIME), n + 1) for base in BASES]
        halves = self.words >> U(32), self.words & U(0xFFFFFFFF)
        self.sums = [np.r_[0, np.cumsum(half.astype(np.int64) % PRIME * up % PRIME)] for half, up in zip(halves, self.up, strict=True)]

    def runs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Keys of the words from a to b."""
        return _key(*((s[b] - s[a]) % PRIME * down[a] % PRIME for s, down in zip(self.sums, self.down, strict=True)))

    def keys(self) -> np.ndarray:
        """One key per line; lines without words all get the same."""
        return self.runs(self.at[:-1], self.at[1:]).view(np.int64)

    def halves(self) -> np.ndarray:
        """Six keys per line: its first and second half as one of two lines of n words, of n and n + 1, and of
        n - 1 and n. Lines within one edit agree in a half of the pair's lengths, split by the shorter line."""
        a, b = self.at[:-1], self.at[1:]
        n = b - a
        out = []
        for shorter, kind in ((n, 0), (n, 1), (np.maximum(n - 1, 0), 1)):
            first = shorter // 2
            second = shorter - first
            tag = mix((2 * shorter + kind).astype(U))
            out.append(mix(self.runs(a, a + first) ^ tag))
            out.append(mix(self.runs(b - second, b) ^ ~tag))
        return np.stack(out, 1).view(np.int64)

    def without_each(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each line and each word position: the line, the position and the key without that word."""
        a, b = self.at[:-1], self.at[1:]
        line = np.repeat(np.arange(len(a)), b - a)
        position = np.arange(len(line)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
        i, start, end = a[line] + position, a[line], b[line]
        rest = [((s[i] - s[start]) % PRIME + (s[end] - s[i + 1]) % PRIME * down[1]) % PRIME * down[start] % PRIME for s, down in zip(self.sums, self.down, strict=True)]
        return line, position, _key(*rest).view(np.int64)


def _key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x.astype(U) << U(31) | y.astype(U))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0, ..., base^(n - 1) modulo the prime, and perhaps more of them kept for later."""
    held = _powers.get(base, np.ones(1, np.int64))
    while len(held) < n:
        held = np.r_[held, held * pow(base, len(held), PRIME) % PRIME]
    _powers[base] = held
    return held[:n]


def identities(lines: list[bytes]) -> np.ndarray:
    """128 bits of each line's words as bytes, in two columns: what makes lines equal."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(line.lower().split())) for line in lines), "<i8").reshape(-1, 2)


LINE = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("line_no", pa.int32()), ("n", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("head", pa.int64()), ("tail", pa.int64())])
LINES = "doc_id long, mark long, line_no int, n int, k1 long, k2 long, head long, tail long"


def _lines(min_words: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for a, b in blocks(lengths, BLOCK):
                split = [t.split(b"\n") for t in batch.column(1).slice(a, b - a).to_pylist()]
                counts = np.array([len(s) for s in split])
                lines = [line for s in split for line in s]
                words, at = word_hashes(lines)
                same = identities(lines)
                n = np.diff(at)
                four = grams(words, anchor).view(np.int64)
                long = n >= min_words
                head, tail = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                head[long] = four[at[:-1][long]]
                tail[long] = ~four[at[1:][long] - anchor]
                no = np.arange(len(n)) - np.repeat(np.cumsum(counts) - counts, counts)
                ids, marks = (np.repeat(batch.column(k).slice(a, b - a).to_numpy(zero_copy_only=False), counts) for k in (0, 2))
                yield pa.record_batch(
                    [pa.array(ids), pa.array(marks), pa.array(no.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(same[:, 0]), pa.array(same[:, 1]), pa.array(head, mask=~long), pa.array(tail, mask=~long)],
                    schema=LINE,
                )

    return run


PLACED = [("doc_id", pa.int64()), ("line_no", pa.int32()), ("tie", pa.int64())]
WANTED = pa.schema([*PLACED, ("line", pa.binary()), ("halves", pa.list_(pa.int64()))])
VARIANT = pa.schema([*PLACED, ("position", pa.int32()), ("key", pa.int64())])
PLACE_COLUMNS = "doc_id long, line_no int, tie long"


def _wanted_lines(batch: pa.RecordBatch, tied: bool) -> Iterator[tuple[list, list[bytes]]]:
    """Columns of the places, and the lines, that are wanted of some documents' texts."""
    ids, texts, wanted = (batch.column(k).to_pylist() for k in range(3))
    for a, b in blocks(np.array([len(t) for t in texts]), BLOCK):
        own = [(doc_id, no, lines[no]) for doc_id, lines, nos in ((ids[i], texts[i].split(b"\n"), wanted[i]) for i in range(a, b)) for no in nos if no < len(lines)]
        if own:
            doc_ids, nos, lines = zip(*own, strict=True)
            tie = identities(lines)[:, 0] if tied else np.zeros(len(lines), np.int64)
            yield [np.array(doc_ids, np.int64), np.array(nos, np.int32), tie], list(lines)


def _wanted(tied: bool):
    """The wanted lines of each document, with the keys of their halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, lines in _wanted_lines(batch, tied):
                yield pa.record_batch([*places, lines, list(Lines(lines).halves())], schema=WANTED)

    return run


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of each line without each of its words in turn, and of the line itself at position -1."""
    for batch in batches:
        places, lines = [batch.column(k).to_numpy() for k in range(3)], batch.column(3).to_pylist()
        for a, b in blocks(np.array([len(t) for t in lines]), BLOCK):
            held = Lines(lines[a:b])
            line, position, key = held.without_each()
            own = [c[a:b] for c in places]
            yield pa.record_batch([*own, np.full(b - a, -1, np.int32), held.keys()], schema=VARIANT)
            yield pa.record_batch([*(c[line] for c in own), position.astype(np.int32), key], schema=VARIANT)


def alike(x: list[bytes], y: list[bytes]) -> bool:
    """Do two word sequences differ by one inserted, deleted or substituted word at most?"""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    k = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), len(x))
    return x[k + 1 :] == y[k + 1 :] if len(x) == len(y) else x[k:] == y[k + 1 :]


def words(line: bytes) -> list[bytes]:
    return line.lower().split()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [alike(words(x), words(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))


#: A line's place. Where identifiers repeat, ``tie`` is of the line's words, so that a place is one line; else it is 0.
PLACE = "struct<doc_id:long,line_no:int,tie:long>"


def within(x: list[bytes], y: list[bytes], k: int) -> bool:
    """Do two word sequences differ by at most k edits? Furthest reaching points of each diagonal, edit by edit."""
    m, n = len(x), len(y)
    if abs(m - n) > k:
        return False
    reach = {0: -1}
    for edits in range(k + 1):
        new = {}
        for d in range(-edits, edits + 1):
            # Of diagonal d, i - j: a substitution, a word more in x, a word more in y.
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2) + 1, reach.get(d + 1, -2)) if edits else 0
            i = min(i, m, n + d)
            if i < 0 or i - d < 0:
                continue
            while i < m and i - d < n and x[i] == y[i - d]:
                i += 1
            if i == m and i - d == n:
                return True
            new[d] = i
        reach = new
    return False


def _within(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = words(a), words(b)
                keep.append(within(x, y, max(1, max(len(x), len(y)) * percent // 100)))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def _heats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters far above their mean in this task."""
    total = np.zeros(HEATS, np.int64)
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(0)).to_numpy(zero_copy_only=False)
        for a, b in blocks(lengths, BLOCK):
            g = grams(word_hashes(batch.column(0).slice(a, b - a).to_pylist())[0], GRAM)
            total += np.bincount((g % U(HEATS)).astype(np.int64), minlength=HEATS)
    found = np.flatnonzero(total > 8 + 8 * total.mean())
    yield pa.record_batch([found, total[found]], names=["at", "n"])


def most_edits(n: np.ndarray, percent: int) -> np.ndarray:
    """The largest bound of a line of n words and a longer one that is within it."""
    best = n * percent // 100
    for longer in (n * 100 // (100 - percent) + d for d in range(-1, 3)):
        k = longer * percent // 100
        best = np.where(longer - k <= n, np.maximum(best, k), best)
    return best


def first_grams(lines: Lines, percent: int, heat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line numbers and keys of the grams that come first in the common order; a gram's repeats are numbered."""
    n = np.diff(lines.at)
    k = most_edits(n, percent)
    own = np.flatnonzero(k >= 2)
    size = n[own] - GRAM + 1
    line = np.repeat(own, size)
    start = np.repeat(np.cumsum(size) - size, size)
    g = grams(lines.words, GRAM)[lines.at[:-1][line] + np.arange(len(line)) - start]
    order = np.lexsort((g, line))
    new = np.r_[True, (np.diff(line[order]) != 0) | (g[order][1:] != g[order][:-1])][: len(order)]
    runs = np.flatnonzero(new)
    repeat = np.empty(len(line), np.int64)
    repeat[order] = np.arange(len(order)) - np.repeat(runs, np.diff(np.r_[runs, len(order)]))
    key = mix(g + repeat.astype(U) * U(FIRST))
    order = np.lexsort((key, heat[(g % U(HEATS)).astype(np.int64)], line))
    taken = order[np.arange(len(order)) - start < GRAM * k[line] + 1]
    return line[taken], key[taken].view(np.int64)


def _first_grams(percent: int, min_words: int, heat: np.ndarray, tied: bool):
    schema = pa.schema([*PLACED, ("n", pa.int32()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, lines in _wanted_lines(batch, tied):
                held = Lines(lines)
                n = np.diff(held.at)
                line, key = first_grams(held, percent, heat)
                some = n[line] >= min_words
                line, key = line[some], key[some]
                yield pa.record_batch([*(c[line] for c in places), n[line].astype(np.int32), key], schema=schema)

    return run


def _texts(source: DataFrame, places: DataFrame) -> DataFrame:
    """Documents' texts with the numbers of those of their lines that are among ``places`` (column first)."""
    wanted = written(places.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list("first.line_no").alias("nos")))
    # A document has any number of lines, so both are counted.
    held = wanted.agg(F.count("*") + F.coalesce(F.sum(F.size("nos")), F.lit(0))).first()[0]
    few = held <= BROADCAST_ROWS
    return source.join(F.broadcast(wanted) if few else wanted, "doc_id").select("doc_id", "text", "nos")


def _wide(source: DataFrame, distinct: DataFrame, min_words: int, percent: int, tied: bool) -> DataFrame:
    """(x, y): distinct lines, with the earliest line before them within the bound that grows with length."""
    heat = np.zeros(HEATS, np.int64)
    sample = source.where(F.abs(F.xxhash64("doc_id")) % SAMPLED == 0).select("text").mapInArrow(_heats, "at long, n long")
    for at, n in sample.groupBy("at").agg(F.sum("n")).collect():
        heat[at] = n
    place = F.struct("doc_id", "line_no", "tie")
    keys = _texts(source, distinct.where("head is not null").select("first")).mapInArrow(_first_grams(percent, min_words, heat, tied), f"{PLACE_COLUMNS}, n int, key long")
    by_place = Window.partitionBy("key").orderBy("place")
    ranked = keys.select(place.alias("place"), "n", "key").distinct().select("*", F.row_number().over(by_place).alias("rank"), F.lead("n").over(by_place).isNotNull().alias("more"))
    ranked = written(ranked.where("rank > 1 or more").drop("more"))
    texts = _texts(source, ranked.select(F.col("place").alias("first")).distinct())
    lines = written(texts.mapInArrow(_wanted(tied), f"{PLACE_COLUMNS}, line binary, halves array<long>").select(place.alias("place"), "line").dropDuplicates(["place"]))
    pending, best, low, high = ranked.where("rank > 1"), None, 1, REACH
    while not pending.isEmpty():
        early = ranked.where((F.col("rank") >= low) & (F.col("rank") < high)).select("key", F.col("place").alias("other"), F.col("n").alias("m"), F.col("rank").alias("r"))
        near = (F.col("r") < F.col("rank")) & (F.abs(F.col("n") - F.col("m")) <= F.greatest(F.lit(1), F.floor(F.greatest("n", "m") * percent / 100)))
        pairs = pending.join(early, "key").where(near).select("place", "other").distinct()
        if best is not None:
            pairs = pairs.join(best, pairs["place"] == best["x"], "left").where("y is null or other < y").select("place", "other")
        both = pairs.join(lines.withColumnRenamed("line", "a"), "place").join(lines.select(F.col("place").alias("other"), F.col("line").alias("b")), "other")
        found = both.select("place", "other", "a", "b").mapInArrow(_within(percent), f"x {PLACE}, y {PLACE}")
        best = written((found if best is None else found.unionByName(best)).groupBy("x").agg(F.min("y").alias("y")))
        # A gram is done with when all its lines from here on come after the one that is found.
        rest = ranked.where(F.col("rank") == high).select("key", F.col("place").alias("other"))
        left = pending.where(F.col("rank") > high).join(rest, "key")
        left = left.join(best, left["place"] == best["x"], "left").where("y is null or other < y")
        pending, low, high = written(left.select("place", "n", "key", "rank")), high, high * REACH
    return best if best is not None else source.sparkSession.createDataFrame([], f"x {PLACE}, y {PLACE}")


def _near(source: DataFrame, distinct: DataFrame, tied: bool) -> DataFrame:
    """(x, y): distinct lines by their first place, with the earliest verified neighbour before them."""
    long = distinct.where("head is not null").select("first", F.explode(F.array("head", "tail")).alias("anchor"))
    shared = long.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor")
    places = long.join(shared, "anchor").select("first").distinct()
    lines = written(_texts(source, places).mapInArrow(_wanted(tied), f"{PLACE_COLUMNS}, line binary, halves array<long>"))
    place = F.struct("doc_id", "line_no", "tie")
    halves = lines.select(place.alias("place"), F.explode(F.array_distinct("halves")).alias("half"))
    agreed = halves.groupBy("half").agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low < high").select("half")
    near = halves.join(agreed, "half").select("place.*").distinct()
    lines = written(lines.join(near, ["doc_id", "line_no", "tie"]).select("doc_id", "line_no", "tie", "line").dropDuplicates(["doc_id", "line_no", "tie"]))
    keys = written(lines.mapInArrow(_variants, f"{PLACE_COLUMNS}, position int, key long")).select(place.alias("place"), "position", "key")
    cut, whole = keys.where("position >= 0"), keys.where("position < 0").select("key", F.col("place").alias("other"))
    # Lines without the same position: the earliest is a witness for the others.
    least = cut.groupBy("key", "position").agg(F.min("place").alias("other"), F.max("place").alias("last")).where("other < last").drop("last")
    same = many_to_one(cut, written(least), ["key", "position"]).select("place", "other")
    # A line and another one without a word. Distinct lines have distinct keys, so each stands once on that side.
    crossed = many_to_one(cut.drop("position"), whole, ["key"]).select("place", "other")
    found = same.unionByName(crossed).unionByName(crossed.select(F.col("other").alias("place"), F.col("place").alias("other")))
    pairs = found.where("other < place").distinct()
    lines = lines.select(place.alias("place"), "line")
    both = pairs.join(lines.withColumnRenamed("line", "a"), "place").join(lines.select(F.col("place").alias("other"), F.col("line").alias("b")), "other")
    checked = both.select("place", "other", "a", "b").mapInArrow(_verified, f"x {PLACE}, y {PLACE}")
    return checked.groupBy("x").agg(F.min("y").alias("y"))


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8, percent: int = 0, short: int | None = None) -> DataFrame:
    """One row per line: doc_id, line_no, n_words, keep_doc, keep_line, kept.

    Lines are split at \\n and numbered from 0; words are runs of bytes other than space and \\x09-\\x0D with
    A-Z lowered. keep_doc and keep_line name the earliest line, by identifier and number, that is alike (see
    the module); the line is kept when that is itself. Lines without words are always kept. A null text has
    one empty line. A null identifier comes before all others. Of rows with one identifier, equal lines at the
    same number are both first. An empty table gives no rows. Lines are equal when 128
    bits of their words' bytes are.

    ``percent`` of the longer line's words may be edited if that is more than one word. With ``short``, lines
    from that many words on, 2 at least, are compared too.
    """
    return _verdicts(docs, id_col, text_col, min_words, percent, short).drop("mark")


def _verdicts(docs: DataFrame, id_col: str, text_col: str, min_words: int, percent: int, short: int | None, marked: bool = False) -> DataFrame:
    """``line_verdicts`` with a hash of the line's whole text as ``mark``, 0 unless asked for."""
    if min_words < 2 * ANCHOR:
        raise ValueError(f"min_words must be {2 * ANCHOR} at least")
    if not 0 <= percent <= MOST_PERCENT:
        raise ValueError(f"percent must be 0 to {MOST_PERCENT}")
    if short is not None and not 2 <= short <= min_words:
        raise ValueError("short must be 2 to min_words")
    least = min_words if short is None else short
    text = text_or_empty(text_col).cast("binary")
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), text.alias("text"))
    mark = F.xxhash64("text") if marked else F.lit(0).cast("long")
    lines = written(source.select("*", mark.alias("mark")).mapInArrow(_lines(least, min(ANCHOR, least // 2)), LINES))
    repeats = source.groupBy("doc_id").count().where("count > 1").limit(1)
    tied = not repeats.isEmpty()
    place = F.struct("doc_id", "line_no", (F.col("k1") if tied else F.lit(0).cast("long")).alias("tie"))
    distinct = lines.where("n > 0").groupBy("k1", "k2").agg(F.min(place).alias("first"), F.first("head").alias("head"), F.first("tail").alias("tail"))
    distinct = written(distinct)
    near = _near(source, distinct, tied)
    if percent:
        near = near.unionByName(_wide(source, distinct, least, percent, tied)).groupBy("x").agg(F.min("y").alias("y"))
    keep = distinct.join(near, distinct["first"] == near["x"], "left").select("k1", "k2", F.least("first", "y").alias("keep"))
    # least() of structs skips nulls, so a line without neighbour keeps its own first place.
    columns = ["doc_id", "mark", "line_no", "n", "keep", place.alias("place")]
    out = many_to_one(lines.where("n > 0").select("doc_id", "mark", "line_no", "n", "k1", "k2"), keep, ["k1", "k2"]).select(*columns)
    out = out.unionByName(lines.where("n = 0").select("doc_id", "mark", "line_no", "n", place.alias("keep"), place.alias("place")))
    real = lambda c: F.when(c != NULL_ID, c)
    return out.select(
        real(F.col("doc_id")).alias("doc_id"),
        "mark",
        F.col("line_no").cast("long").alias("line_no"),
        F.col("n").cast("long").alias("n_words"),
        real(F.col("keep.doc_id")).alias("keep_doc"),
        F.col("keep.line_no").cast("long").alias("keep_line"),
        (F.col("keep") == F.col("place")).alias("kept"),
    )


def _left(texts: pd.Series, gone: pd.Series) -> pd.Series:
    def left(text: str, numbers) -> str:
        out = set(numbers)
        return "\n".join(line for k, line in enumerate(text.split("\n")) if k not in out)

    return pd.Series([t if g is None else left(t or "", g) for t, g in zip(texts, gone, strict=True)], dtype=object)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8, percent: int = 0, short: int | None = None) -> DataFrame:
    """``docs`` with the lines that are not kept taken out of their texts; all rows and columns stay.

    Lines go by row: of rows that share an identifier each loses the lines of its own text only.
    """
    verdicts = _verdicts(docs, id_col, text_col, min_words, percent, short, marked=True).where("not kept")
    own_id, mark, gone_id, gone_mark, gone = fresh(docs.columns, "__id", "__mark", "__gone_id", "__gone_mark", "__gone")
    lost = verdicts.groupBy(F.col("doc_id").alias(gone_id), F.col("mark").alias(gone_mark)).agg(F.collect_set("line_no").alias(gone))
    rows = docs.withColumns({own_id: F.col(id_col).cast("long"), mark: F.xxhash64(text_or_empty(text_col).cast("binary"))})
    joined = rows.join(lost, F.col(own_id).eqNullSafe(F.col(gone_id)) & (F.col(mark) == F.col(gone_mark)), "left")
    texts = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.pandas_udf(_left, "string")(F.col(text_col).cast("string"), F.col(gone)))
    return joined.withColumn(text_col, texts).select(*docs.columns)
