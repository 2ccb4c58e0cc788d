"""What a folder of documents held when it was last ingested, and what has changed since.

A manifest has one row per path: the content's hash, its length and time, what reading it gave, and ``gone_at`` for a
file that is no longer there. Files whose length and time are as they were are not opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.sources import documents
from corrobora.tables import written

MANIFEST = "path string, sha string, length long, modified timestamp, file string, format string, status string, reason string, warnings array<string>, gone_at string"
#: What became of a file: its content is another one, it came, it went, or it stayed.
CHANGED, NEW, GONE, SAME = "changed", "new", "gone", "same"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, length, content) of the supported files below a folder; content is read only where it is used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.where(documents.supported(F.replace("path", F.lit(folder), F.lit("")))).select("path", F.col("modificationTime").alias("modified"), "length", "content")


def hashes(found: DataFrame) -> DataFrame:
    """(path, sha) of files with their content."""
    return found.select("path", F.sha2("content", 256).alias("sha"))


def diff(found: DataFrame, manifest: DataFrame, trust: bool = True) -> DataFrame:
    """(path, sha, length, modified, change) of all files there are or were.

    With ``trust`` the hash of a file is taken from the manifest if length and time are the same; else, or where these
    differ, its content is read. A file that was touched but not changed is the same. What is marked as gone and is back
    is new; one that could not be read before counts as changed only if its content is another one.
    """
    known = manifest.where("gone_at IS NULL").select("path", F.col("sha").alias("__sha"), F.col("length").alias("__length"), F.col("modified").alias("__modified"))
    listed = found.select("path", "length", "modified")
    joined = written(listed.join(known, "path", "full_outer"))
    like = F.lit(trust) & F.col("length").eqNullSafe(F.col("__length")) & F.col("modified").eqNullSafe(F.col("__modified"))
    opened = written(hashes(found.join(joined.where(F.col("length").isNotNull() & ~like).select("path"), "path", "left_semi")))
    both = joined.join(opened, "path", "left").withColumn("sha", F.coalesce("sha", F.when(F.col("length").isNotNull(), F.col("__sha"))))
    change = F.when(F.col("sha").isNull(), GONE).when(F.col("__sha").isNull(), NEW).when(F.col("sha") == F.col("__sha"), SAME).otherwise(CHANGED)
    return both.select("path", "sha", "length", "modified", change.alias("change"))


def entries(changes: DataFrame, parsed: DataFrame) -> DataFrame:
    """Manifest rows of new and changed files and what reading them gave."""
    told = parsed.select("path", "file", "format", "status", "reason", "warnings")
    return changes.select("path", "sha", "length", "modified").join(told, "path").withColumn("gone_at", F.lit(None).cast("string")).select(*(f.split()[0] for f in MANIFEST.split(", ")))


def tombstones(changes: DataFrame, manifest: DataFrame, now: str) -> DataFrame:
    """Manifest rows of files that are gone: as they were, with the time."""
    return manifest.join(changes.where(F.col("change") == GONE).select("path"), "path", "left_semi").withColumn("gone_at", F.lit(now))
