"""Human decisions: status by content hash, effective coverage, the queue, and bulk acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.hashing import assessment_hash
from corrobora.functions.numbers import LEVELS


def status(current_hash: Column, decision: Column, reviewed_against: Column) -> Column:
    """unreviewed without a decision, reviewed if it saw this assessment, else stale."""
    return F.when(decision.isNull(), "unreviewed").when(reviewed_against.eqNullSafe(current_hash), "reviewed").otherwise("stale")


def joined(assessments: DataFrame, decisions: DataFrame, key: str = "outcome_id") -> DataFrame:
    """Assessments (key, coverage, needs_review, hash) with their decisions (key, decision, final_coverage,
    reviewed_against), and review_status and effective_coverage. A stale override has no effect."""
    rows = assessments.join(decisions, key, "left").withColumn("review_status", status(F.col("hash"), F.col("decision"), F.col("reviewed_against")))
    overrides = (F.col("review_status") == "reviewed") & (F.col("decision") == "override") & (F.length("final_coverage") > 0)
    return rows.withColumn("effective_coverage", F.when(overrides, F.col("final_coverage")).otherwise(F.col("coverage")))


def queue(rows: DataFrame, show_all: bool = False) -> DataFrame:
    """What is to be reviewed of joined rows: all, or the stale ones and the unreviewed ones with a flag."""
    if show_all:
        return rows
    flagged = (F.col("review_status") == "unreviewed") & F.coalesce("needs_review", F.lit(False))
    return rows.where((F.col("review_status") == "stale") | flagged)


def accept_all(rows: DataFrame, by: str | None = None, at: str | None = None, show_all: bool = False, key: str = "outcome_id") -> DataFrame:
    """Decisions that accept the queue as it is."""
    return queue(rows, show_all).select(
        key, F.lit("accept").alias("decision"), F.col("coverage").alias("final_coverage"), F.lit(None).cast("string").alias("note"),
        F.lit(by).cast("string").alias("reviewed_by"), F.lit(at).cast("string").alias("reviewed_at"), F.col("hash").alias("reviewed_against"),
    )


DECISIONS = ("accept", "override", "note", "skip")


def decide(rows: DataFrame, given: DataFrame, by: str | None = None, at: str | None = None, key: str = "outcome_id") -> DataFrame:
    """Decisions from what reviewers gave: (key, decision[, final_coverage, note]).

    accept and note take the coverage as it is, note with its remark; override needs a coverage level; skip decides
    nothing. A decision on an outcome that was not assessed counts as one on a synthetic none. Of several for one
    outcome the job fails, as it does for anything else than these four.
    """
    text = lambda c: (F.trim(F.col(c).cast("string")) if c in given.columns else F.lit(None).cast("string")).alias(c)
    asked = given.select(key, F.lower(text("decision")).alias("__d"), F.lower(text("final_coverage")).alias("__f"), text("note").alias("__n"))
    good = F.col("__d").isin(*DECISIONS) & ((F.col("__d") != "override") | F.coalesce(F.col("__f").isin(*LEVELS), F.lit(False)))
    why = F.concat(F.lit("no decision: "), F.concat_ws(" ", F.col(key).cast("string"), "__d", "__f"))
    asked = asked.where(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(why).cast("boolean")))
    once = asked.groupBy(key).agg(F.first("__d").alias("__d"), F.first("__f").alias("__f"), F.first("__n").alias("__n"), F.count("*").alias("__k"))
    once = once.where(F.when(F.col("__k") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("several decisions: "), F.col(key).cast("string"))).cast("boolean")))
    seen = once.where("__d <> 'skip'").join(rows.select(key, "coverage", "hash"), key, "left")
    over = F.col("__d") == "override"
    return seen.select(
        key, F.when(over, "override").otherwise("accept").alias("decision"), F.when(over, F.col("__f")).otherwise(F.coalesce("coverage", F.lit("none"))).alias("final_coverage"),
        F.nullif("__n", F.lit("")).alias("note"), F.lit(by).cast("string").alias("reviewed_by"), F.lit(at).cast("string").alias("reviewed_at"),
        F.coalesce("hash", assessment_hash(F.lit("none"), F.array().cast("array<struct<source_file:string,quote:string>>"))).alias("reviewed_against"),
    )


def stats(rows: DataFrame) -> DataFrame:
    """One row: reviewed (accepted), overridden, skipped and remaining."""
    good = F.col("review_status") == "reviewed"
    return rows.agg(
        F.count_if(good & (F.col("decision") != "override")).alias("reviewed"),
        F.count_if(good & (F.col("decision") == "override")).alias("overridden"),
        F.count_if(F.col("decision") == "skip").alias("skipped"),
        F.count_if(~good).alias("remaining"),
    )
