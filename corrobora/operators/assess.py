"""Assessment of outcomes against hits: judge, verify, threshold, critique, fallback, cache and upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.numbers import to_fixed
from corrobora.operators.judge import JUDGES
from corrobora.operators.verify import downgrade, verify_quotes

NO_EVIDENCE = "no evidence retrieved from the corpus"


def flag_low(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Confidence below the threshold sets needs_review and never clears it."""
    return df.withColumn("needs_review", F.col("needs_review") | (F.col("confidence") < threshold))


def fallback(outcomes: DataFrame, reason: Column | str, key: str = "outcome_id") -> DataFrame:
    """The row of an outcome that could not be judged."""
    why = F.lit(reason) if isinstance(reason, str) else reason
    return outcomes.select(
        key, F.lit("none").alias("coverage"), F.lit(0.0).alias("confidence"), F.concat(F.lit("Automated fallback: "), why, F.lit(".")).alias("rationale"), F.lit(True).alias("needs_review"),
        F.lit(True).alias("fallback"), why.alias("fallback_reason"), F.lit(None).cast("string").alias("verifier_action"), F.lit(0).cast("long").alias("quotes_checked"), F.lit(0).cast("long").alias("quotes_verified"), F.lit(False).alias("downgraded"),
    )


IGNORED = "The critique's answer was invalid and was ignored; the first judgement stands."


def _verified(judged: DataFrame, hits: DataFrame, threshold: float, key: str) -> DataFrame:
    """Judgements with verified quotes, downgraded and flagged as these ask for.

    An outcome's hits are its top k, so quotes meet them by a join on the outcome, in the same plan as the judge's
    answers, which are asked for once.
    """
    claims = judged.select(key, F.posexplode("evidence").alias("pos", "e")).select(key, "pos", "e.source_file", "e.quote")
    checked = verify_quotes(claims, hits, key, bounded=True)
    return flag_low(downgrade(judged.select(key, "coverage", "confidence", "rationale", "needs_review"), checked, key), threshold)


def assess(outcomes: DataFrame, hits: DataFrame, judge: str | Callable = "lexical", threshold: float = 0.6, critique: bool = False, key: str = "outcome_id") -> DataFrame:
    """One assessment per outcome, as one plan: judged, verified and flagged, or a fallback where there is no hit.

    With ``critique`` the judge is asked again, shown its verified first judgement. A valid answer is verified in
    the same way and replaces the first; critique_applied tells whether it changed coverage or confidence, and
    critique_note is its rationale. An invalid one leaves the first and forces review. ``judge`` is a name in
    JUDGES or such a function.
    """
    ask = JUDGES[judge] if isinstance(judge, str) else judge
    judged = ask(outcomes, hits, key)
    done = _verified(judged, hits, threshold, key)
    failed = judged.select(key, "fallback_reason")
    if critique:
        answered = done.join(failed.where("fallback_reason is null").select(key), key, "left_semi")
        done = second_pass(done, ask(outcomes, hits, key, _as_verdicts(answered, key)), hits, threshold, key)
    else:
        done = done.withColumns({"critique_applied": F.lit(None).cast("boolean"), "critique_note": F.lit(None).cast("string")})
    seen = hits.select(key).distinct()
    rows = done.join(seen, key, "left_semi").join(failed, key).withColumn("fallback", F.col("fallback_reason").isNotNull())
    missing = fallback(outcomes.join(seen, key, "left_anti"), NO_EVIDENCE, key)
    return rows.unionByName(missing, allowMissingColumns=True)


def _as_verdicts(done: DataFrame, key: str) -> DataFrame:
    """Verified judgements in the form in which a critic is shown them."""
    evidence = F.transform("evidence", lambda e: F.struct(e["source_file"].alias("source_file"), e["quote"].alias("quote")))
    return done.select(key, "coverage", "confidence", "rationale", "needs_review", evidence.alias("evidence"))


def second_pass(first: DataFrame, second: DataFrame, hits: DataFrame, threshold: float = 0.6, key: str = "outcome_id") -> DataFrame:
    """Verified first judgements with the critic's answers; outcomes that it was not asked about stay as they are."""
    again = _verified(second.where("fallback_reason is null"), hits, threshold, key)
    before = first.select(key, F.col("coverage").alias("__c"), F.col("confidence").alias("__f"))
    changed = (F.col("coverage") != F.col("__c")) | (F.col("confidence") != F.col("__f"))
    replaced = again.join(before, key).withColumns({"critique_applied": changed, "critique_note": F.col("rationale")}).drop("__c", "__f")
    invalid = second.where("fallback_reason is not null").select(key, F.lit(True).alias("__invalid"))
    rest = first.join(again.select(key), key, "left_anti").join(invalid, key, "left")
    bad = F.col("__invalid").isNotNull()
    kept = rest.withColumns({"needs_review": F.col("needs_review") | bad, "critique_applied": F.when(bad, F.lit(False)), "critique_note": F.when(bad, F.lit(IGNORED))}).drop("__invalid")
    return replaced.unionByName(kept)


def enriched(assessments: DataFrame, outcomes: DataFrame, hits: DataFrame, key: str = "outcome_id") -> DataFrame:
    """Adds what display and provenance need: ``retrieved``, the hits in rank order as (chunk_id, source_file,
    page, score to four decimals), and the other columns of ``outcomes``, such as function and category."""
    shown = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "source_file", "page", _four_decimals(F.col("score")).alias("score")))).alias("__r"))
    kind = "array<struct<chunk_id:string,source_file:string,page:int,score:double>>"
    fields = lambda x: F.struct(x["chunk_id"], x["source_file"], x["page"], x["score"])
    rows = assessments.join(shown, key, "left").withColumn("retrieved", F.coalesce(F.transform("__r", fields).cast(kind), F.array().cast(kind))).drop("__r")
    more = [c for c in outcomes.columns if c == key or c not in rows.columns]
    return rows.join(outcomes.select(*more), key, "left")


def _four_decimals(c: Column) -> Column:
    return F.when(c < 0, -to_fixed(-c, 4)).otherwise(to_fixed(c, 4))


def flagged(assessments: DataFrame) -> DataFrame:
    """(flagged): how many of all stored assessments need review, whether or not the catalogue has them still."""
    return assessments.agg(F.count_if("needs_review").alias("flagged"))


def unfinished(outcomes: DataFrame, stored: DataFrame, signature: Column | str, key: str = "outcome_id", force: bool = False) -> DataFrame:
    """Outcomes without a stored assessment of the current signature; stored fallbacks count as done."""
    if force:
        return outcomes
    sig = F.lit(signature) if isinstance(signature, str) else signature
    return outcomes.join(stored.where(F.col("engine_sig") == sig).select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "outcome_id") -> DataFrame:
    """New rows replace old ones by key; old rows without a new one stay, whether or not the catalogue has them."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
