"""The profile, its summaries and orders, and the Markdown and CSV deliverables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corrobora.functions import text as T
from corrobora.functions.numbers import LEVELS, is_gap, percent
from corrobora.operators.ordering import with_position, with_position_in
from corrobora.tables import fresh, written

# The order of known function names, and the evidence map's columns.
FUNCTIONS = ["GOVERN", "IDENTIFY", "PROTECT", "DETECT", "RESPOND", "RECOVER"]
EVIDENCE_COLUMNS = ["subcategory_id", "function", "category", "coverage", "confidence", "review_status", "source_file", "page", "similarity", "quote", "quote_verified", "rationale"]


def profile(outcomes: DataFrame, assessments: DataFrame, decisions: DataFrame, key: str = "outcome_id") -> DataFrame:
    """Outcomes LEFT JOIN assessments LEFT JOIN decisions; what was not assessed is none, confidence 0, to review."""
    from corrobora.operators.review import joined

    own = assessments.drop(*(c for c in outcomes.columns if c != key))
    rows = outcomes.join(own, key, "left").withColumns({
        "coverage": F.coalesce("coverage", F.lit("none")), "confidence": F.coalesce("confidence", F.lit(0.0)), "needs_review": F.coalesce("needs_review", F.lit(True)), "downgraded": F.coalesce("downgraded", F.lit(False)),
    })
    rows = joined(rows, decisions, key)
    override = (F.col("review_status") == "reviewed") & (F.col("decision") == "override")
    return rows.withColumns({"ai_coverage": F.col("coverage"), "human_coverage": F.when(override, F.col("final_coverage"))}).withColumn("coverage", F.col("effective_coverage")).drop("effective_coverage")


def tally() -> list[Column]:
    return [F.count_if(F.col("coverage") == x).alias(f"n_{x}") for x in LEVELS]


def totals(entries: DataFrame, function: str = "function", category: str = "category") -> DataFrame:
    """All counts of a profile in one pass: (level, function, category, total, the four levels, gaps, ..., pct).

    Level 0 is the one row over everything, 1 has a row per function, 2 one per function and category; what a row sums
    over is null in it. Without entries there is no row.
    """
    names = fresh(entries.columns, "__function", "__category")
    is_status = lambda s: F.count_if(F.col("review_status") == s).alias(s)
    keyed = entries.withColumns({names[0]: F.col(function), names[1]: F.col(category)})
    rows = keyed.groupingSets([[], [names[0]], names], *names).agg(
        F.grouping_id().alias("__id"), F.count("*").alias("total"), *tally(), F.count_if(is_gap(F.col("coverage"))).alias("gaps"), is_status("reviewed"), is_status("unreviewed"), is_status("stale"),
        F.count("human_coverage").alias("overridden"), F.count_if("downgraded").alias("downgraded_by_verifier"),
    )
    level = F.when(F.col("__id") == 3, 0).when(F.col("__id") == 1, 1).otherwise(2)
    pct = percent(F.col("n_substantial") + F.col("n_full"), F.col("total"))
    return rows.select(level.alias("level"), F.col(names[0]).alias("function"), F.col(names[1]).alias("category"), *(c for c in rows.columns if not c.startswith("__")), pct.alias("pct"))


#: What ``summary`` and ``by_function`` take of ``totals``.
SUMMARY = ("total", *(f"n_{x}" for x in LEVELS), "gaps", "reviewed", "unreviewed", "stale", "overridden", "downgraded_by_verifier")
BY_FUNCTION = ("total", *(f"n_{x}" for x in LEVELS), "pct")


def summary(entries: DataFrame) -> DataFrame:
    """One row of totals over a profile, zeros if it has no entry."""
    is_status = lambda s: F.count_if(F.col("review_status") == s).alias(s)
    return entries.agg(
        F.count("*").alias("total"), *tally(), F.count_if(is_gap(F.col("coverage"))).alias("gaps"), is_status("reviewed"), is_status("unreviewed"), is_status("stale"),
        F.count("human_coverage").alias("overridden"), F.count_if("downgraded").alias("downgraded_by_verifier"),
    )


def by_function(entries: DataFrame, function: str = "function") -> DataFrame:
    """Per function: total, the four levels, and the percentage substantially or fully covered."""
    rows = entries.groupBy(function).agg(F.count("*").alias("total"), *tally())
    return rows.withColumn("pct", percent(F.col("n_substantial") + F.col("n_full"), F.col("total")))


def function_rank(name: Column) -> Column:
    """The known functions' place, 99 for any other."""
    place = F.array_position(F.array(*(F.lit(x) for x in FUNCTIONS)), name)
    return F.when(place > 0, place - 1).otherwise(F.lit(99))


def function_order(entries: DataFrame, function: str = "function") -> DataFrame:
    """(function, pos): the distinct functions, known ones first in their order, others by the locale's."""
    w = Window.orderBy(function_rank(F.col(function)), F.collate(function, "UNICODE"))
    return entries.select(function).distinct().withColumn("pos", F.row_number().over(w) - 1)


def gaps_order(entries: DataFrame, key: str = "outcome_id", function: str = "function") -> DataFrame:
    """Gaps with their place within the function: none before partial, then by identifier."""
    gaps = entries.where(is_gap(F.col("coverage")))
    return with_position_in(gaps, function, "pos", F.when(F.col("coverage") == "none", 0).otherwise(1), F.col(key))


def covered_order(entries: DataFrame, key: str = "outcome_id", function: str = "function") -> DataFrame:
    return with_position_in(entries.where(~is_gap(F.col("coverage"))), function, "pos", F.col(key))


class UnresolvedError(ValueError):
    """A strict report was asked for while items are unresolved."""


def unresolved(entries: DataFrame, key: str = "outcome_id", most: int = 10) -> DataFrame:
    """The first ten entries in catalogue order that no current decision resolves."""
    return entries.where("review_status <> 'reviewed'").orderBy(key).limit(most)


def strict_gate(entries: DataFrame, key: str = "outcome_id") -> None:
    first = [str(r[key]) for r in unresolved(entries, key).select(key).collect()]
    if first:
        n = entries.where("review_status <> 'reviewed'").count()
        raise UnresolvedError(f"{n} unresolved: {', '.join(first)}{'…' if n > len(first) else ''}")


def badge(status: Column, ai: Column, human: Column, downgraded: Column) -> Column:
    """The remark behind an entry, empty if there is none."""
    parts = F.concat_ws(
        "; ",
        F.when(status == "unreviewed", "⚠ UNREVIEWED").when(status == "stale", "⚠ STALE REVIEW"),
        F.when(human.isNotNull(), F.concat(F.lit("reviewer override: "), ai, F.lit(" → "), human)),
        F.when(downgraded, "verifier downgraded (unverifiable quote removed)"),
    )
    return F.when(parts == "", "").otherwise(F.concat(F.lit(" _("), parts, F.lit(")_")))


def evidence_map(entries: DataFrame, key: str = "outcome_id", at: str | None = None) -> DataFrame:
    """One row per entry and quote, and one with blanks for an entry without; see EVIDENCE_COLUMNS.

    With ``at``, that column has the quote's place in its entry.
    """
    rows = entries.select("*", F.posexplode_outer("evidence").alias("__at", "e"))
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return rows.select(
        F.col(key).cast("string").alias("subcategory_id"), "function", "category", "coverage", F.col("confidence"), "review_status",
        blank(F.col("e.source_file")).alias("source_file"), blank(F.col("e.page")).alias("page"), blank(F.col("e.score")).alias("similarity"), blank(F.col("e.quote")).alias("quote"),
        F.when(F.col("e").isNull(), "").when(F.col("e.verified"), "yes").otherwise("no").alias("quote_verified"), "rationale", *([F.coalesce("__at", F.lit(0)).alias(at)] if at else []),
    )


@F.pandas_udf(StringType())
def indented(rows: pd.Series) -> pd.Series:
    """Compact JSON as an element of a list within an object, two spaces a level."""
    return rows.map(lambda x: "    " + json.dumps(json.loads(x), indent=2, ensure_ascii=False).replace("\n", "\n    "))


def profile_lines(entries: DataFrame, now: str, key: str = "outcome_id") -> DataFrame:
    """(section, at, text): the profile as one JSON document, entries in catalogue order."""
    total = totals(entries).where("level = 0").select(*SUMMARY).first()
    total = total.asDict() if total else dict.fromkeys(SUMMARY, 0)
    head = json.dumps({"generatedAt": now, "summary": total, "subcategories": []}, indent=2, ensure_ascii=False)
    if not total["total"]:
        return entries.sparkSession.createDataFrame([(0, 0, head)], "section int, at long, text string")
    placed = with_position(entries.select(key, F.to_json(F.struct(*entries.columns), {"ignoreNullFields": "false"}).alias("__json")), "at", F.col(key))
    comma = F.when(F.col("at") == total["total"] - 1, F.lit("")).otherwise(F.lit(","))
    ends = entries.sparkSession.createDataFrame([(0, 0, head[: head.rindex("[") + 1]), (2, 0, "  ]\n}")], "section int, at long, text string")
    return ends.unionByName(placed.select(F.lit(1).alias("section"), "at", F.concat(indented("__json"), comma).alias("text")))


def evidence_lines(entries: DataFrame, key: str = "outcome_id", bom: bool = True) -> DataFrame:
    """(section, subcategory_id, at, text): the evidence map as CSV, the carriage return of every line with it."""
    rows = evidence_map(entries, key, at="at").select(F.lit(1).alias("section"), "subcategory_id", "at", F.concat(T.csv_line(*EVIDENCE_COLUMNS), F.lit("\r")).alias("text"))
    head = ("\ufeff" if bom else "") + ",".join(EVIDENCE_COLUMNS) + "\r"
    return entries.sparkSession.createDataFrame([(0, "", 0, head)], "section int, subcategory_id string, at int, text string").unionByName(rows)


def csv_document(lines: list[str], header: list[str], bom: bool = True) -> str:
    """Escaped lines as one CSV document: byte order mark, header, CRLF after every line."""
    return ("\ufeff" if bom else "") + "".join(f"{x}\r\n" for x in [",".join(header), *lines])


TITLES = (("Gaps and partial coverage", "_No gaps._"), ("Substantially or fully covered", "_Nothing is covered yet._"))
#: By what the report's lines are ordered.
MARKDOWN_ORDER = ("section", "rank", "function", "at", "id")


def markdown_lines(entries: DataFrame, key: str = "outcome_id", most: int = 300) -> DataFrame:
    """The gaps-first report as lines with what they are ordered by; see MARKDOWN_ORDER.

    Gaps come by function, known ones first, none before partial, then by identifier; all counts are of one pass.
    """
    counted = written(totals(entries).where("level < 2"))
    value = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    lines = lambda *parts: F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p)) for p in parts))
    place = lambda section, rank, function, at, ident, text: [F.lit(section).alias("section"), rank.cast("int").alias("rank"), function.alias("function"), at.cast("int").alias("at"), ident.cast("string").alias("id"), text.alias("text")]
    none, zero = F.lit(""), F.lit(0)
    one = counted.where("level = 0").agg(*(F.max(c).alias(c) for c in SUMMARY))  # a row even without entries
    draft = F.when((F.col("unreviewed") > 0) | (F.col("stale") > 0), F.concat(F.lit("> **DRAFT.** "), value("unreviewed"), F.lit(" unreviewed and "), value("stale"), F.lit(" stale items remain.\n\n"))).otherwise("")
    overview = F.concat(F.lit("# Current profile and gap analysis\n\n"), draft, lines(
        "## Overview", "", ("- Outcomes: ", value("total"), ", gaps: **", value("gaps"), "**"), ("- Coverage: none ", value("n_none"), ", partial ", value("n_partial"), ", substantial ", value("n_substantial"), ", full ", value("n_full")),
        ("- Review: reviewed ", value("reviewed"), ", unreviewed ", value("unreviewed"), ", stale ", value("stale"), ", overrides ", value("overridden")), ("- Downgraded by the verifier: ", value("downgraded_by_verifier")),
        "", "## Coverage by function", "", "| Function | Total | None | Partial | Substantial | Full | % addressed |", "| --- | ---: | ---: | ---: | ---: | ---: | ---: |",
    ))
    made = one.select(*place(0, zero, none, zero, none, overview))
    functions = counted.where("level = 1")
    rank = function_rank(F.col("function"))
    table = F.concat(F.lit("| "), F.concat_ws(" | ", "function", *(value(c) for c in BY_FUNCTION)), F.lit("% |"))
    made = made.unionByName(functions.select(*place(1, rank, F.col("function"), zero, none, table)))
    remark = badge(F.col("review_status"), F.col("ai_coverage"), F.col("human_coverage"), F.col("downgraded"))
    quotes = F.transform("evidence", lambda e: F.concat(F.lit("  - Evidence ("), T.location(e["source_file"], e["page"]), F.lit('): "'), T.truncated(e["quote"], most), F.lit('"')))
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    item = F.concat_ws("\n", F.concat(F.lit("- **"), shown(F.col(key)), F.lit("** — _"), F.col("coverage"), F.lit("_"), remark), F.concat(F.lit("  - Outcome: "), shown(F.col("outcome"))), F.concat(F.lit("  - Rationale: "), shown(F.col("rationale"))), quotes)
    gap = is_gap(F.col("coverage"))
    for k, ((title, empty), own, count) in enumerate(zip(TITLES, (gap, ~gap), (F.col("gaps"), F.col("total") - F.col("gaps")), strict=True)):
        head = F.concat(F.lit(f"\n## {title}\n"), F.when(F.coalesce(count, zero) == 0, F.lit(f"\n{empty}")).otherwise(""))
        made = made.unionByName(one.select(*place(2 + 2 * k, zero, none, zero, none, head)))
        made = made.unionByName(functions.where(count > 0).select(*place(3 + 2 * k, rank, F.col("function"), F.lit(-1), none, F.concat(F.lit("### "), "function", F.lit("\n")))))
        order = F.when(F.col("coverage") == "none", 0).otherwise(1) if k == 0 else zero
        made = made.unionByName(entries.where(own).select(*place(3 + 2 * k, rank, F.col("function"), order, F.col(key), item)))
    return made


def markdown_order() -> list[Column]:
    return [F.col("section"), F.col("rank"), F.collate("function", "UNICODE"), F.col("function"), F.col("at"), F.col("id")]
