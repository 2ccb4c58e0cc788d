"""Judges: columns in, a reply per outcome out. The lexical one is deterministic and built in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.functions import text as T
from corrobora.functions.numbers import clamp, to_fixed


def _best_sentence(sentences, words):
    """The first sentence with the most of the words."""
    counted = F.transform(sentences, lambda s, i: F.struct(F.size(T.contained(words, F.lower(s))).alias("n"), (-i).alias("order"), s.alias("s")))
    return F.array_max(counted)["s"]


def lexical(outcomes: DataFrame, hits: DataFrame, key: str = "outcome_id") -> DataFrame:
    """Judges each (key, outcome) by the words that its hits (key, rank, source_file, text) share with it.

    Returns key, n_keywords, matched, coverage, confidence, quote, source_file, rationale and needs_review.
    Of hits with equally many words the first counts, of sentences too; without three words and a quarter of
    all, or without hits, coverage is none. A sentence of mere intent is partial; operation gives substantial
    from 0.45 and full from 0.7 of the words.
    """
    asked = outcomes.select(key, T.keywords("outcome").alias("words"))
    scored = asked.join(hits, key).select(key, "rank", "source_file", "text", T.contained(F.col("words"), F.lower("text")).alias("found"))
    best = scored.groupBy(key).agg(F.max_by(F.struct("source_file", "text", "found"), F.struct(F.size("found"), -F.col("rank"))).alias("best"))
    rows = asked.join(best, key, "left").select(key, F.size("words").alias("n_keywords"), F.coalesce(F.size("best.found"), F.lit(0)).alias("size"), F.col("best.found").alias("found"), F.col("best.source_file").alias("source_file"), F.col("best.text").alias("text"))
    rows = rows.withColumn("matched", F.when(F.col("found").isNull(), 0).otherwise(F.col("size"))).withColumn("ratio", F.col("matched") / F.greatest(F.lit(1), F.col("n_keywords")))
    rows = rows.withColumn("nothing", (F.col("matched") < 3) | (F.col("ratio") < 0.25))
    rows = rows.withColumn("sentences", F.when(~F.col("nothing"), T.sentences("text")))
    rows = rows.withColumn("quote", F.when(~F.col("nothing"), F.coalesce(_best_sentence(F.col("sentences"), F.col("found")), F.col("text"))))
    does = T.is_operational("quote")
    intent = T.is_intent("quote") & ~does
    rows = rows.withColumn("coverage", F.when(F.col("nothing"), "none").when(intent, "partial").when((F.col("ratio") >= 0.7) & does, "full").when((F.col("ratio") >= 0.45) & does, "substantial").otherwise("partial"))
    r = F.col("ratio") * 0.2
    raw = F.when(F.col("nothing"), F.lit(0.3)).when(F.col("coverage") == "partial", clamp(0.45 + r, 0.4, 0.62)).when(F.col("coverage") == "substantial", clamp(0.6 + r, 0.6, 0.82)).otherwise(F.lit(0.85))
    rows = rows.withColumn("raw", raw)
    reason = F.when(F.col("nothing"), F.lit("The retrieved text does not show this outcome.")).when(F.col("coverage") == "partial", F.concat(F.lit("Partly shown in "), F.col("source_file"))).otherwise(F.concat(F.lit("Shown in operation in "), F.col("source_file")))
    return rows.select(
        key,
        "n_keywords",
        "matched",
        "coverage",
        to_fixed(F.col("raw"), 2).alias("confidence"),
        "quote",
        F.when(~F.col("nothing"), F.col("source_file")).alias("source_file"),
        reason.alias("rationale"),
        (F.col("nothing") | (F.col("coverage") == "partial") | (F.col("raw") < 0.6)).alias("needs_review"),
    )


def lexical_verdicts(outcomes: DataFrame, hits: DataFrame, key: str = "outcome_id", first: DataFrame | None = None) -> DataFrame:
    """The lexical judge's verdicts in the form that ``assess`` takes; see JUDGES. As a critic it confirms."""
    if first is not None:
        rationale = F.trim(F.concat(F.lit("Critique: confirmed on the same evidence. "), F.coalesce("rationale", F.lit(""))))
        return first.select(key, "coverage", "confidence", rationale.alias("rationale"), "needs_review", "evidence", F.lit(None).cast("string").alias("fallback_reason"))
    pair = F.struct("source_file", "quote")
    none = F.array().cast("array<struct<source_file:string,quote:string>>")
    evidence = F.when(F.col("quote").isNotNull(), F.array(pair)).otherwise(none).alias("evidence")
    return lexical(outcomes, hits, key).select(key, "coverage", "confidence", "rationale", "needs_review", evidence, F.lit(None).cast("string").alias("fallback_reason"))


#: Judges by name: functions of outcomes (key, outcome), hits and the key to rows (key, coverage, confidence,
#: rationale, needs_review, evidence of (source_file, quote), fallback_reason). For a critique they also get the first
#: judgements in the same form, without the reason, and answer those. See ``remote.judge`` for services.
JUDGES: dict[str, Callable] = {"lexical": lexical_verdicts, "mock": lexical_verdicts}
