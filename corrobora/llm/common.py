"""What the operators share: input tables, the shared scratch folder, and safe column handling."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.tables import discard, fresh, scratch, written

__all__ = ["BROADCAST_ROWS", "discard", "fresh", "held_out", "many_to_one", "partitions", "release", "released", "scratch", "stable", "table", "text_or_empty", "without", "written"]

#: A table of row keys with at most this many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(modulus: int, remainder: int, key: str = "doc_id") -> Column:
    """Rows set aside: crc32 of the id as text leaves that remainder; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release() -> None:
    """Gives back to the system what a task has freed: workers outlive their tasks, and other stages' tasks run beside them."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that ends with ``release``."""

    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def without(docs: DataFrame, keys: DataFrame, *on: Column) -> DataFrame:
    """The rows of ``docs`` whose expressions ``on`` equal no row of ``keys``, column by column; null equals null."""
    names = fresh(docs.columns, *(f"__{i}" for i in range(len(on))))
    keys = written(keys.toDF(*names).distinct())
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    same = F.lit(True)
    for name, c in zip(names, on, strict=True):
        same = same & c.eqNullSafe(F.col(name))
    return docs.join(keys, same, "left_anti")


def stable(df: DataFrame) -> DataFrame:
    """``df`` if it reads stored files with nothing but columns and filters chosen, else ``df`` as a table: two reads
    of anything else may differ in rows or in their order."""
    nodes = {line.lstrip(" :+-*").split(" ")[0].split("(")[0] for line in df._jdf.queryExecution().analyzed().toString().splitlines()}
    plain = nodes <= {"Project", "Filter", "Relation", "SubqueryAlias"} and df._jdf.queryExecution().analyzed().deterministic()
    return df if plain else written(df)


def many_to_one(many: DataFrame, one: DataFrame, on: list[str], counted: str | None = None, least: int = 256) -> DataFrame:
    """``many`` joined with ``one``, in which each key stands once, without a task per frequent key.

    Keys with more than twice a task's fair share of ``many`` get their row by broadcast; there are fewer of them
    than half the tasks, whatever the data. The others meet in a shuffle. ``many`` should be a stored table. With
    ``counted``, that column of ``one``, a stored table then, has the number of rows of ``many`` with the key.
    """
    spark = many.sparkSession
    share = max(least, 2 * many.count() // partitions(spark))
    n, *_ = fresh([*many.columns, *one.columns], "__n")
    if counted:
        hot = one.where(F.col(counted) > share).select(*on)
    else:
        hot = written(many.groupBy(*on).agg(F.count("*").alias(n)).where(F.col(n) > share).drop(n))
    if hot.isEmpty():
        return many.join(one, on)
    rows = F.broadcast(one.where(F.col(counted) > share) if counted else written(one.join(F.broadcast(hot), on)))
    return many.join(F.broadcast(hot), on, "left_anti").join(one, on).unionByName(many.join(rows, on))
