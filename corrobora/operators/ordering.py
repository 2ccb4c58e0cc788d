"""Positions in a global order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora.tables import fresh, written


def with_position(df: DataFrame, name: str, *order: Column, partitions: int | None = None) -> DataFrame:
    """``df`` with its 0-based place in the order: ranges, places within them, and the ranges' prefix sums.

    The ranges are written as a table once, as both sides of the join must see the very same ones: two range
    exchanges may sample different bounds. Rows that tie get some order, which stays as it was written.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, at, count, base, *ks = fresh([*df.columns, name], "__p", "__at", "__n", "__base", *(f"__k{i}" for i in range(len(order))))
    keys = df.select("*", *(c.alias(k) for c, k in zip(order, ks, strict=True)))
    ranged = keys.repartitionByRange(n, *ks).withColumn(part, F.spark_partition_id())
    placed = written(ranged.withColumn(at, F.row_number().over(Window.partitionBy(part).orderBy(*ks)) - 1).drop(*ks))
    # One row per range.
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy(part).agg(F.count("*").alias(count)).select(part, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(base))
    return placed.join(F.broadcast(bases), part).select(*df.columns, (F.col(base) + F.col(at)).cast("long").alias(name))


def with_position_in(df: DataFrame, group: str, name: str, *order: Column) -> DataFrame:
    """``df`` with its 0-based place within its group; a group with a third of all rows is still many ranges."""
    place, own, first = fresh([*df.columns, name], "__place", "__group", "__first")
    placed = with_position(df, place, F.col(group), *order)
    least = placed.groupBy(F.col(group).alias(own)).agg(F.min(place).alias(first))
    joined = placed.join(least, F.col(group).eqNullSafe(F.col(own)))
    return joined.select(*df.columns, (F.col(place) - F.col(first)).alias(name))
