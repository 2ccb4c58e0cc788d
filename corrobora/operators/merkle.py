"""A Merkle tree over rows in order: one hash for all of them, and the ranges in which two tables differ.

Level 0 has the rows' own digests. Every node of a higher level is the hash of up to ``fan`` nodes below it, those of
one range of positions, so a task holds ``fan`` digests whatever the table's size. Two trees are compared from the
top down, and only below nodes that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.tables import written

FAN = 4096
NODES = "level int, node long, h string"


def joined(position: str) -> Column:
    """The digests of a group, one after another in order of position."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, "h"))), lambda x: x["h"]), "")


def tree(rows: DataFrame, digest: Column, fan: int = FAN, position: str = "pos") -> DataFrame:
    """The stored nodes (level, node, h) of rows that are numbered from 0 without gaps.

    Levels are added until one has at most ``fan`` nodes. A table without rows has no node.
    """
    level = rows.select(F.lit(0).alias("level"), F.col(position).cast("long").alias("node"), digest.alias("h"))
    out = written(level)
    count, k = out.count(), 0
    while count > fan:
        k += 1
        count = -(-count // fan)
        below = out.where(F.col("level") == k - 1)
        above = written(below.groupBy(F.floor(F.col("node") / fan).alias("__up")).agg(F.sha2(joined("node"), 256).alias("h")).select(F.lit(k).alias("level"), F.col("__up").alias("node"), "h"))
        out = out.unionByName(above)
    return out


def top(nodes: DataFrame) -> DataFrame:
    """(h): the digests of the highest level one after another, at most as many as a node has below it."""
    highest = nodes.agg(F.max("level")).first()[0]
    return nodes.where(F.col("level") == (highest or 0)).agg(joined("node").alias("h"))


def _unlike(one: DataFrame, other: DataFrame) -> DataFrame:
    """(node, change) of one level's nodes: ``added``, ``removed`` or ``changed`` from the first to the second."""
    both = one.select("node", F.col("h").alias("__a")).join(other.select("node", F.col("h").alias("__b")), "node", "full_outer").where(~F.col("__a").eqNullSafe(F.col("__b")))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("changed")
    return both.select("node", change.alias("change"))


def changes(one: DataFrame, other: DataFrame, fan: int = FAN) -> DataFrame:
    """(pos, change): the positions at which two trees of the same ``fan`` differ."""
    height = [t.agg(F.coalesce(F.max("level"), F.lit(-1))).first()[0] for t in (one, other)]
    at = lambda t, k: t.where(F.col("level") == k).select("node", "h")
    # The lower tree has no nodes above its own top; the comparison starts where both have some.
    k = min(height) if min(height) >= 0 else 0
    differing = written(_unlike(at(one, k), at(other, k)))
    while k > 0:
        k -= 1
        within = differing.select(F.col("node").alias("__up"))
        below = [at(t, k).join(within, F.floor(F.col("node") / fan) == F.col("__up"), "left_semi") for t in (one, other)]
        differing = written(_unlike(*below))
    return differing.select(F.col("node").alias("pos"), "change")


def ranges(one: DataFrame, other: DataFrame, fan: int = FAN) -> DataFrame:
    """(first, last, changed): the ranges of ``fan`` positions in which there is a change, and how many."""
    found = changes(one, other, fan).groupBy(F.floor(F.col("pos") / fan).alias("g")).agg(F.count("*").alias("changed"))
    return found.select((F.col("g") * fan).alias("first"), ((F.col("g") + 1) * fan - 1).alias("last"), "changed")
