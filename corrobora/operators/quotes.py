"""Which texts hold which quotes, by seeds: fingerprints that a quote shares with every text that it stands in.

Of each ``window`` consecutive runs of ``run`` characters a text keeps the one with the least hash (winnowing). Two texts
with a common stretch of run + window - 1 characters keep a common run, so a quote of that length or more stands only
where all of its own seeds are. Its rarest one gives the candidates, in an equi-join that can be split anywhere; then the
texts themselves decide. Short runs stand in ever more texts by chance as these grow, so that candidates grow with quotes
times texts: a quote has the longest runs of CLASSES that its length allows. Runs that leave little of a quote uncovered
also tell near copies apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.operators.joins import BROADCAST_ROWS, many_to_one
from corrobora.tables import discard, written

#: Lengths of runs and windows, by the least length of the quotes that have them.
CLASSES = ((12, 9), (28, 9), (52, 5))
RUN, WINDOW = CLASSES[0]
#: The shortest quote that is sure to have a seed.
SHORTEST = RUN + WINDOW - 1
#: Characters that are hashed at a time.
PIECE = 1 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: A filter of seeds has two to this many bits, made in two to the other many parts.
BITS, PARTS = 28, 6


def _runs(c: np.ndarray, run: int) -> np.ndarray:
    """The polynomial hash of every run, from those of runs of 1, 2, 4... characters."""
    power = lambda n: np.uint64(pow(int(FACTOR), n, 1 << 64))
    made, n, part, w = c[:0], 0, c, 1
    while True:
        if run & w:
            at = len(c) - n - w + 1
            made = part[:at] * power(n) + made[w : w + at] if n else part
            n += w
        if n == run:
            return made
        part = part[:-w] * power(w) + part[w:]
        w *= 2


def _least(h: np.ndarray, window: int) -> np.ndarray:
    """The least of each so many consecutive ones."""
    made, w = h, 1
    while 2 * w <= window:
        made = np.minimum(made[:-w], made[w:])
        w *= 2
    return np.minimum(made[: len(h) - window + 1], made[window - w :])


def seeds(text: str, run: int = RUN, window: int = WINDOW) -> np.ndarray:
    """The distinct seeds of a text; none if it is shorter than run + window - 1."""
    kept, shortest = [np.empty(0, np.uint64)], run + window - 1
    for a in range(0, max(1, len(text) - shortest + 1), PIECE):
        c = np.frombuffer(text[a : a + PIECE + shortest - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        if len(c) < shortest:
            continue
        h = _runs(c, run)
        h ^= h >> np.uint64(29)
        h *= FACTOR
        h ^= h >> np.uint64(32)
        found = _least(h, window)
        kept.append(found[np.flatnonzero(np.r_[True, found[1:] != found[:-1]])])
    return np.unique(np.concatenate(kept))


def class_of(length: int) -> tuple[int, int]:
    """The run and window that quotes of a length have."""
    return next((c for c in reversed(CLASSES) if sum(c) - 1 <= length), CLASSES[0])


def _bit(seeds: np.ndarray) -> np.ndarray:
    """Each seed's bit of the filter; seeds themselves are no even hashes, as they are the least of several."""
    return (seeds.view(np.uint64) * FACTOR >> np.uint64(64 - BITS)).astype(np.int64)


def _part(key: tuple, group: pa.Table) -> pa.Table:
    bits = np.zeros(1 << BITS - PARTS, np.uint8)
    bits[_bit(np.ascontiguousarray(group.column("seed").to_numpy())) & len(bits) - 1] = 1
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(bits).tobytes()])], names=["part", "bits"])


def filter_of(wanted: DataFrame) -> Broadcast:
    """The bits of seeds (seed long) for tasks to look up: of fixed size, whatever their number."""
    @F.arrow_udf("int")
    def part_of(seeds: pa.Array) -> pa.Array:
        return pa.array((_bit(np.ascontiguousarray(seeds.to_numpy(zero_copy_only=False))) >> BITS - PARTS).astype(np.int32))

    made = wanted.select("seed").withColumn("part", part_of("seed")).groupBy("part").applyInArrow(_part, "part int, bits binary").collect()
    each = (1 << BITS - PARTS) // 8
    whole = np.zeros(1 << BITS - 3, np.uint8)
    for r in made:
        whole[r.part * each : (r.part + 1) * each] = np.frombuffer(r.bits, np.uint8)
    return wanted.sparkSession.sparkContext.broadcast(whole)


def _passed(found: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
    """The seeds that may be among the wanted ones."""
    if bits is None:
        return found
    at = _bit(found)
    return found[(bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)]


def _seeded(batches: Iterator[pa.RecordBatch], held: Broadcast | None, classes: list[tuple[int, int]] | None) -> Iterator[pa.RecordBatch]:
    """(id, text, salt) -> (id, seeds)."""
    bits = None if held is None else held.value
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            ids, texts, salts = (batch.column(c).slice(a, 256) for c in range(3))
            found = []
            for text, salt in zip(texts.to_pylist(), salts.to_numpy().view(np.uint64), strict=True):
                own = np.concatenate([seeds(text or "", *c) for c in classes or [class_of(len(text or ""))]])
                found.append(_passed(np.unique(own) ^ salt, bits))
            at = np.cumsum([0, *(len(s) for s in found)])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)))
            yield pa.record_batch([ids, lists], names=["id", "seeds"])


def with_seeds(rows: DataFrame, held: Broadcast | None = None, classes: list[tuple[int, int]] | None = [CLASSES[0]]) -> DataFrame:
    """(id, seed) of (id, text[, salt]) rows, without most of those that a filter does not have.

    Texts have the seeds of all the classes, quotes (None) those of their own. Seeds with another salt are others.
    """
    salt = F.col("salt") if "salt" in rows.columns else F.lit(0).cast("long")
    return rows.select(F.col("id").cast("long"), "text", salt.alias("salt")).mapInArrow(lambda batches: _seeded(batches, held, classes), "id long, seeds array<long>").select("id", F.explode("seeds").alias("seed"))


def containing(quotes: DataFrame, texts: DataFrame, first: bool = False) -> DataFrame:
    """(quote, text): identifiers of the quotes and of the texts of the same group in which they stand.

    Both sides are (id long, group, text) with identifiers of their own, groups of one type and texts that are
    normalised already. Quotes shorter than SHORTEST are left out; null groups and texts match nothing. Both are read
    more than once, so they should be stored. Quotes travel to their candidates: a text is shuffled once, not by pair.

    ``first``: texts have a rank too, and the one of least rank is all that is wanted of a quote's. Others may be among
    those returned. A quote's candidate of least rank is looked at by itself, so that a large group of copies, in which
    many quotes stand many times, does not make pairs of all; only quotes that it does not hold meet the others.
    """
    salted = lambda rows: rows.select("id", "group", "text", F.xxhash64("group").alias("salt")).where(F.col("group").isNotNull() & F.col("text").isNotNull())
    ranks = texts.select(F.col("id").alias("text"), "rank") if first else None
    quotes, texts = salted(quotes).where(F.length("text") >= SHORTEST), salted(texts)
    least = F.lit(SHORTEST)
    for c in CLASSES[1:]:
        least = F.when(F.length("text") >= sum(c) - 1, sum(c) - 1).otherwise(least)
    classes = sorted(class_of(r[0]) for r in quotes.select(least.alias("least")).distinct().collect())
    asked = written(with_seeds(quotes, classes=None).withColumnRenamed("id", "quote"))
    wanted = written(asked.select("seed").distinct())
    # What no quote has is of no use and does not leave its task, but for what passes the filter by chance; the rest is
    # stored once, as it is counted and then met.
    own = with_seeds(texts, filter_of(wanted), classes or [CLASSES[0]]).withColumnRenamed("id", "text")
    few = wanted.count() <= BROADCAST_ROWS
    met = written(own.join(F.broadcast(wanted) if few else wanted, "seed", "left_semi"))
    counts = met.groupBy("seed").agg(F.count("*").alias("n"))
    # A seed that no text of the group has rules its quote out.
    rarest = asked.join(counts, "seed", "left").groupBy("quote").agg(F.min(F.coalesce("n", F.lit(0))).alias("n"), F.min_by("seed", F.struct(F.coalesce("n", F.lit(0)), "seed")).alias("seed")).where("n > 0")
    picked = written(rarest.select("quote", "seed"))
    discard(asked, wanted)

    def held(pairs: DataFrame) -> DataFrame:
        """The (text, quote) pairs, which are stored, of which the text holds the quote."""
        needles = many_to_one(pairs, quotes.select(F.col("id").alias("quote"), "group", F.col("text").alias("needle")), ["quote"])
        both = many_to_one(needles, texts.select(F.col("id").alias("text"), F.col("group").alias("of"), F.col("text").alias("hay")), ["text"], weigh=pairs)
        found = written(both.where((F.col("of") == F.col("group")) & F.contains("hay", "needle")).select("quote", "text"))
        discard(pairs)
        return found

    def every(picked: DataFrame) -> DataFrame:
        by_seed = written(picked.groupBy("seed").agg(F.collect_list("quote").alias("quotes")))
        pairs = written(many_to_one(met, by_seed, ["seed"]).select("text", F.explode("quotes").alias("quote")))
        discard(by_seed)
        return held(pairs)

    if not first:
        found = every(picked)
    else:
        candidates = written(met.join(picked.select("seed").distinct(), "seed", "left_semi"))
        foremost = many_to_one(candidates, ranks, ["text"]).groupBy("seed").agg(F.min_by("text", "rank").alias("text"))
        found = held(written(picked.join(foremost, "seed").select("text", "quote")))
        discard(candidates)
        left = written(picked.join(found.select("quote"), "quote", "left_anti"))
        if not left.isEmpty():
            found = found.unionByName(every(left))
        discard(left)
    discard(met, picked)
    return found
