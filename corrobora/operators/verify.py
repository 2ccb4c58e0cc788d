"""Verbatim verification of quotes against retrieved text, and the downgrade rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.functions import text as T
from corrobora.operators import quotes
from corrobora.operators.joins import many_to_one
from corrobora.tables import discard, written

DOWNGRADED = "downgraded_to_none_no_valid_quote"
PREFIX = "[Auto-downgraded: no claimed quote was found verbatim in the retrieved evidence.] "


#: An outcome with more pairs of a quote and a hit than this has them looked up by seeds.
PAIRS = 1 << 16


def verify_quotes(claims: DataFrame, hits: DataFrame, key: str = "outcome_id", bounded: bool = False) -> DataFrame:
    """Claims (key, pos, source_file, quote) with the first hit in rank order that holds the quote.

    Adds hit_source, page, chunk_id, score, verified and attribution_corrected. Quotes that are not
    substantive match nothing, and no quote matches across two hits. Hits are (key, rank, chunk_id,
    source_file, page, text[, score]); their text is normalised once, before the join.

    An outcome's few quotes meet its few hits by a join on the key. Outcomes with more than PAIRS pairs meet by the
    quotes' seeds instead, so that none of them is one task's. ``bounded`` says that there are none: hits are a top k.
    """
    score = F.col("score").cast("double") if "score" in hits.columns else F.lit(None).cast("double")
    shown = lambda rows: T.with_norm(rows.select(key, "rank", "chunk_id", F.col("source_file").alias("hit_source"), "page", score.alias("score"), F.col("text").alias("__norm")), "__norm", "__norm")
    asked = T.with_norm(claims, "quote", "__needle")
    ask = asked.where(T.substantive("__needle")).select(key, "pos", "__needle")
    if bounded:
        first = _first(ask.join(shown(hits), key).where(F.contains("__norm", "__needle")), key)
    else:
        large = written(ask.groupBy(key).agg(F.countDistinct("__needle").alias("q")).join(hits.groupBy(key).agg(F.count("*").alias("h")), key).where(F.col("q") * F.col("h") > PAIRS).select(key))
        if large.isEmpty():
            first = _first(ask.join(shown(hits), key).where(F.contains("__norm", "__needle")), key)
        else:
            # Only what a branch meets is normalised for it.
            small = ask.join(large, key, "left_anti").join(shown(hits.join(large, key, "left_anti")), key).where(F.contains("__norm", "__needle"))
            first = _first(small, key).unionByName(_by_seeds(ask.join(large, key, "left_semi"), shown(hits.join(large, key, "left_semi")), key))
    out = asked.drop("__needle").join(first, [key, "pos"], "left")
    return out.select(
        *(c for c in claims.columns),
        "hit.hit_source",
        "hit.page",
        "hit.chunk_id",
        "hit.score",
        F.col("hit").isNotNull().alias("verified"),
        (F.col("hit").isNotNull() & ~F.col("hit.hit_source").eqNullSafe(F.col("source_file"))).alias("attribution_corrected"),
    )


def _first(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key, "pos").agg(F.min_by(F.struct("hit_source", "page", "chunk_id", "score"), "rank").alias("hit"))


def _by_seeds(ask: DataFrame, shown: DataFrame, key: str) -> DataFrame:
    """(key, pos, hit) of outcomes with many quotes and hits; equal quotes of an outcome are looked up once."""
    shown = written(shown.withColumn("__h", F.monotonically_increasing_id()))
    needles = written(ask.select(key, "__needle").distinct().withColumn("__q", F.monotonically_increasing_id()))
    found = quotes.containing(needles.select(F.col("__q").alias("id"), F.col(key).alias("group"), F.col("__needle").alias("text")), shown.select(F.col("__h").alias("id"), F.col(key).alias("group"), F.col("__norm").alias("text"), "rank"), first=True)
    best = written(many_to_one(found.withColumnRenamed("text", "__h"), shown.drop("__norm", key), ["__h"]).groupBy(F.col("quote").alias("__q")).agg(F.min_by(F.struct("hit_source", "page", "chunk_id", "score"), "rank").alias("hit")))
    discard(shown, found)
    return ask.join(needles, [key, "__needle"]).join(best, "__q").select(key, "pos", "hit")


def downgrade(assessments: DataFrame, verified: DataFrame, key: str = "outcome_id") -> DataFrame:
    """Applies the forcing rule to (key, coverage, confidence, rationale, needs_review).

    Coverage above none without a verified quote becomes none with confidence 0 and review; else dropped
    quotes force review. Adds verifier_action, quotes_checked, quotes_verified, downgraded and evidence (kept
    quotes in order, none for coverage none).
    """
    kept = F.struct("pos", F.col("hit_source").alias("source_file"), "quote", "page", "chunk_id", "score", F.lit(True).alias("verified"), "attribution_corrected")
    counts = verified.groupBy(key).agg(
        F.count("*").alias("quotes_checked"),
        F.count_if("verified").alias("quotes_verified"),
        F.array_sort(F.collect_list(F.when(F.col("verified"), kept))).alias("evidence"),
    )
    kind = "array<struct<pos:int,source_file:string,quote:string,page:int,chunk_id:string,score:double,verified:boolean,attribution_corrected:boolean>>"
    rows = assessments.join(counts, key, "left").withColumns({
        "quotes_checked": F.coalesce("quotes_checked", F.lit(0)),
        "quotes_verified": F.coalesce("quotes_verified", F.lit(0)),
    })
    gone = (F.col("coverage") != "none") & (F.col("quotes_verified") == 0)
    dropped = F.col("quotes_checked") - F.col("quotes_verified")
    some = F.concat(F.lit("dropped_"), dropped.cast("string"), F.when(dropped == 1, F.lit("_unverifiable_quote")).otherwise(F.lit("_unverifiable_quotes")))
    rows = rows.withColumn("downgraded", gone).withColumn("verifier_action", F.when(gone, F.lit(DOWNGRADED)).when(dropped > 0, some))
    return rows.withColumns({
        "coverage": F.when(gone, F.lit("none")).otherwise(F.col("coverage")),
        "confidence": F.when(gone, F.lit(0.0)).otherwise(F.col("confidence")),
        "rationale": F.when(gone, F.concat(F.lit(PREFIX), F.coalesce("rationale", F.lit("")))).otherwise(F.col("rationale")),
        "needs_review": gone | (dropped > 0) | F.col("needs_review"),
        "evidence": F.when(gone | (F.col("coverage") == "none") | F.col("evidence").isNull(), F.array().cast(kind)).otherwise(F.col("evidence").cast(kind)),
    })
