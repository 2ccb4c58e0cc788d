"""A judge's reply: its JSON object, tolerant coercion, and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions import text as T
from corrobora.functions.numbers import LEVELS, clamp

EVIDENCE = "array<struct<source_file:string,quote:string>>"


def json_object(raw: Column) -> Column:
    """The reply as a variant: without code fences, else its outermost braces, else null."""
    text = F.regexp_replace(F.regexp_replace(T.trim_space(raw), rf"^(?i)```(?:json)?{T.SPACE}*", ""), rf"{T.SPACE}*```$", "")
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    inner = F.when((first > 0) & F.contains(text, F.lit("}")) & (last > first), F.substring(text, first, last - first + 1))
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(inner))


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def coerce(v: Column) -> Column:
    """The known fields of a reply: coverage trimmed and lowered, numbers and booleans from strings, confidence
    clamped to 0..1, malformed evidence dropped, anything else stripped. Null for what is no object."""
    get = lambda p, t: F.try_variant_get(v, p, t)
    kind = lambda p: F.coalesce(_kind(v, p), F.lit("VOID"))
    number = get("$.confidence", "double")
    number = F.when(~kind("$.confidence").isin("BOOLEAN", "VOID"), clamp(number, 0.0, 1.0))
    text = lambda p: F.when(kind(p) == "STRING", get(p, "string"))
    flag = F.when(kind("$.needs_review") == "BOOLEAN", get("$.needs_review", "boolean")).when(kind("$.needs_review") == "STRING", F.lower(T.trim_space(get("$.needs_review", "string"))) == "true")
    items = F.coalesce(get("$.evidence", "array<variant>"), F.array().cast("array<variant>"))
    string = lambda e, p: F.when(F.schema_of_variant(F.try_variant_get(e, p, "variant")) == "STRING", F.try_variant_get(e, p, "string"))
    pairs = F.transform(items, lambda e: F.struct(string(e, "$.source_file").alias("source_file"), string(e, "$.quote").alias("quote")))
    good = F.filter(pairs, lambda e: (F.length(T.trim_space(e["source_file"])) > 0) & (F.length(T.trim_space(e["quote"])) > 0))
    made = F.struct(
        text("$.subcategory_id").alias("subcategory_id"),
        F.lower(T.trim_space(text("$.coverage"))).alias("coverage"),
        number.alias("confidence"),
        good.alias("evidence"),
        text("$.rationale").alias("rationale"),
        flag.alias("needs_review"),
    )
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), made)


def problems(value: Column) -> Column:
    """What keeps a coerced reply from the contract, as an array of messages; empty if nothing does."""
    some = lambda c: F.coalesce(F.length(value[c]) > 0, F.lit(False))
    checks = [
        (~some("subcategory_id"), "/subcategory_id must be a non-empty string"),
        (~F.coalesce(value["coverage"].isin(*LEVELS), F.lit(False)), "/coverage must be one of the levels"),
        (value["confidence"].isNull(), "/confidence must be a number"),
        (~some("rationale"), "/rationale must be a non-empty string"),
        (value["needs_review"].isNull(), "/needs_review must be boolean"),
    ]
    found = F.array_compact(F.array(*(F.when(bad, F.lit(message)) for bad, message in checks)))
    return F.when(value.isNull(), F.array(F.lit("(root) must be object"))).otherwise(found)


def validated(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """``replies`` with columns value, errors and ok."""
    parsed = replies.withColumn("value", coerce(json_object(F.col(raw))))
    return parsed.withColumn("errors", problems(F.col("value"))).withColumn("ok", F.size("errors") == 0)
