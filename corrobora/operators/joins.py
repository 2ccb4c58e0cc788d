"""Joins that a frequent key does not make one task's work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.tables import fresh, written

#: A table of row keys with at most this many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def many_to_one(many: DataFrame, one: DataFrame, on: list[str], least: int = 256, weigh: DataFrame | None = None) -> DataFrame:
    """``many`` joined with ``one``, in which each key stands once, without a task per frequent key.

    Keys with more than twice a task's fair share of ``many`` get their row by broadcast; there are fewer of them than
    half the tasks, whatever the data. The others meet in a shuffle. Keys are counted in ``weigh``, a stored table with as many rows of each key,
    or else in ``many``, which should be stored then.
    """
    tasks = max(1, int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    weigh = many if weigh is None else weigh
    share = max(least, 2 * weigh.count() // tasks)
    n, *_ = fresh([*many.columns, *one.columns], "__n")
    hot = written(weigh.groupBy(*on).agg(F.count("*").alias(n)).where(F.col(n) > share).drop(n))
    if hot.isEmpty():
        return many.join(one, on)
    rows = F.broadcast(written(one.join(F.broadcast(hot), on)))
    return many.join(F.broadcast(hot), on, "left_anti").join(one, on).unionByName(many.join(rows, on))
