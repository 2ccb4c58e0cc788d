"""Inputs of the registered queries, derived from the driver's tables in DataFrames and, equally, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.functions import hashing as H
from corrobora.operators import report as R
from corrobora.session import spread, table

IDS = ["GV", "ID", "PR", "DE", "RS", "RC"]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id").withColumn("text", F.coalesce("text", F.lit("")))


def function_of(source):
    """The first six sources stand for the known functions, the others for themselves."""
    out = source
    for i, name in enumerate(R.FUNCTIONS):
        out = F.when(source == f"src{i}", F.lit(name)).otherwise(out)
    return out


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as a catalogue: id like ``GV.C1-07``, by the length of the item's text."""
    items = table(spark, sf, "benchmark")
    n = F.length("text")
    fn = F.element_at(F.array(*(F.lit(x) for x in [*IDS, "XX"])), n % 7 + 1)
    return items.select("item_id", F.concat(fn, F.lit(".C"), (n % 3).cast("string"), F.lit("-"), F.lpad(F.col("item_id").cast("string"), 3, "0")).alias("id"), F.col("text").alias("outcome"))


OUTCOMES = """
    SELECT item_id, ['GV', 'ID', 'PR', 'DE', 'RS', 'RC', 'XX'][length(text) % 7 + 1] || '.C' || (length(text) % 3) || '-' || lpad(item_id::VARCHAR, 3, '0') AS id, text AS outcome
    FROM benchmark
"""


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a hit of one item: the one whose number is the text's length modulo their count."""
    n = table(spark, sf, "benchmark").count()
    docs = documents(spark, sf)
    return docs.select(
        F.pmod(F.length("text"), F.lit(n)).cast("long").alias("item_id"), F.col("doc_id").alias("rank"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"),
        F.col("source").alias("source_file"), F.when(F.col("lang") != "en", F.length("lang")).cast("int").alias("page"), "text",
    )


HITS = """
    SELECT length(coalesce(text, '')) % (SELECT count(*) FROM benchmark) AS item_id, doc_id AS rank, 'c' || doc_id AS chunk_id, source AS source_file,
           CASE WHEN lang <> 'en' THEN length(lang) END AS page, coalesce(text, '') AS text
    FROM documents
"""


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """Three quotes per item: its whole first hit under a wrong file, its own text, and a trivial one."""
    first = hits(spark, sf).groupBy("item_id").agg(F.min_by("text", "rank").alias("text"), F.min_by("source_file", "rank").alias("file"))
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("own"))
    rows = items.join(first, "item_id", "left").select(
        "item_id",
        F.posexplode(F.array(
            F.struct(F.lit("elsewhere").alias("source_file"), F.col("text").alias("quote")),
            F.struct(F.coalesce("file", F.lit("")).alias("source_file"), F.col("own").alias("quote")),
            F.struct(F.lit("x").alias("source_file"), F.lit("the").alias("quote")),
        )).alias("pos", "c"),
    )
    return rows.select("item_id", "pos", "c.source_file", F.coalesce("c.quote", F.lit("")).alias("quote"))


SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def norm_match_sql(x: str) -> str:
    return f"lower(trim(regexp_replace(translate(nfc_normalize(coalesce({x}, '')), '‘’‛“”–—', '''''''\"\"--'), '{SPACE}+', ' ', 'g')))"


CLAIMS = f"""
    h AS ({HITS}), first AS (SELECT item_id, arg_min(text, rank) AS text, arg_min(source_file, rank) AS file FROM h GROUP BY item_id),
    claims AS (
        SELECT b.item_id, 0 AS pos, 'elsewhere' AS source_file, coalesce(f.text, '') AS quote FROM benchmark b LEFT JOIN first f USING (item_id)
        UNION ALL SELECT b.item_id, 1, coalesce(f.file, ''), coalesce(b.text, '') FROM benchmark b LEFT JOIN first f USING (item_id)
        UNION ALL SELECT item_id, 2, 'x', 'the' FROM benchmark
    ), hn AS (SELECT *, {norm_match_sql('text')} AS norm FROM h),
    cn AS (SELECT *, {norm_match_sql('quote')} AS needle FROM claims),
    found AS (
        SELECT c.item_id, c.pos, arg_min({{'file': hn.source_file, 'page': hn.page, 'chunk_id': hn.chunk_id}}, hn.rank) AS hit
        FROM cn c JOIN hn USING (item_id)
        WHERE length(c.needle) >= 20 AND len(regexp_extract_all(c.needle, '[a-z]{{3,}}')) >= 3 AND contains(hn.norm, c.needle)
        GROUP BY ALL
    ), verified AS (
        SELECT c.item_id, c.pos, c.source_file, f.hit.file AS hit_source, f.hit.page AS page, f.hit.chunk_id AS chunk_id, f.hit IS NOT NULL AS verified,
               f.hit IS NOT NULL AND f.hit.file <> c.source_file AS attribution_corrected
        FROM claims c LEFT JOIN found f ON f.item_id = c.item_id AND f.pos = c.pos
    )
"""


def claimed(spark: SparkSession, sf: str) -> DataFrame:
    """A claimed coverage per item, by its text's length."""
    n = F.length("text")
    levels = F.array(*(F.lit(x) for x in ("none", "partial", "substantial", "full")))
    return table(spark, sf, "benchmark").select("item_id", F.element_at(levels, n % 4 + 1).alias("coverage"), (n % 100 / 100).alias("confidence"), F.lit("claimed").alias("rationale"), (n % 2 == 0).alias("needs_review"))


CLAIMED = "SELECT item_id, ['none', 'partial', 'substantial', 'full'][length(text) % 4 + 1] AS coverage, (length(text) % 100) / 100.0::DOUBLE AS confidence, length(text) % 2 = 0 AS needs_review FROM benchmark"

EVIDENCE = "array<struct<source_file:string,page:int,score:double,quote:string,verified:boolean>>"


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(F.col("doc_id").alias("outcome_id"), function_of(F.col("source")).alias("function"), F.col("lang").alias("category"), F.col("text").alias("outcome"))


def assessments(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as assessments, the longer the better covered, its halves as quotes; those without text have none."""
    n = F.length("text")
    docs = documents(spark, sf).where(n > 0)
    level = F.when(n < 400, "none").when(n < 1500, "partial").when(n < 5000, "substantial").otherwise("full")
    quote = lambda a, b: F.struct(F.col("source").alias("source_file"), F.when(F.col("lang") != "en", 1).cast("int").alias("page"), F.lit(0.5).alias("score"), F.substring("text", a, b).alias("quote"), F.lit(True).alias("verified"))
    half = F.floor(n / 2).cast("int")
    two = F.array(quote(F.lit(1), half), quote(half + 1, n))
    evidence = F.when(level == "none", F.array().cast(EVIDENCE)).when(n % 2 == 0, F.slice(two, 1, 1)).otherwise(two)
    rows = docs.select(F.col("doc_id").alias("outcome_id"), level.alias("coverage"), (n % 100 / 100).alias("confidence"), (F.col("lang") != "en").alias("needs_review"), (n % 13 == 0).alias("downgraded"), F.concat(F.lit("=seen in "), F.col("source")).alias("rationale"), evidence.alias("evidence"))
    return rows.withColumn("hash", H.assessment_hash(F.col("coverage"), F.col("evidence")))


_QUOTE = """'{"quote":' || to_json(%s)::VARCHAR || ',"source_file":' || to_json(source)::VARCHAR || '}'"""
ASSESSMENTS = f"""
    SELECT *, sha256('{{"coverage":"' || coverage || '","evidence":[' || CASE WHEN coverage = 'none' THEN '' WHEN n % 2 = 0 THEN {_QUOTE % 'q1'} ELSE {_QUOTE % 'q1'} || ',' || {_QUOTE % 'q2'} END || ']}}')[1:12] AS hash
    FROM (
        SELECT doc_id AS outcome_id, source, lang, length(text) AS n, text[1:length(text) // 2] AS q1, text[length(text) // 2 + 1:] AS q2,
               CASE WHEN length(text) < 400 THEN 'none' WHEN length(text) < 1500 THEN 'partial' WHEN length(text) < 5000 THEN 'substantial' ELSE 'full' END AS coverage,
               (length(text) % 100) / 100.0::DOUBLE AS confidence, lang <> 'en' AS needs_review, length(text) % 13 = 0 AS downgraded, '=seen in ' || source AS rationale
        FROM documents WHERE length(coalesce(text, '')) > 0
    )
"""


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as decisions: toxic ones override, poor ones were made against an older assessment."""
    rows = table(spark, sf, "labels").join(assessments(spark, sf).select(F.col("outcome_id").alias("doc_id"), "hash"), "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("outcome_id"),
        F.when(F.col("toxic") == 1, "override").otherwise("accept").alias("decision"),
        F.when(F.col("toxic") == 1, "full").otherwise("partial").alias("final_coverage"),
        F.when(F.col("quality") == 1, F.col("hash")).otherwise(F.lit("older")).alias("reviewed_against"),
    )


DECISIONS = """
    SELECT l.doc_id AS outcome_id, CASE WHEN toxic = 1 THEN 'override' ELSE 'accept' END AS decision, CASE WHEN toxic = 1 THEN 'full' ELSE 'partial' END AS final_coverage,
           CASE WHEN quality = 1 THEN a.hash ELSE 'older' END AS reviewed_against
    FROM labels l LEFT JOIN a ON a.outcome_id = l.doc_id
"""

_KNOWN = " ".join(f"WHEN 'src{i}' THEN '{name}'" for i, name in enumerate(R.FUNCTIONS))
#: a: assessments, d: decisions, j: assessments with decisions, p: the profile.
PROFILE = f"""
    a AS ({ASSESSMENTS}), d AS ({DECISIONS}),
    j AS (
        SELECT a.*, d.decision, d.final_coverage, d.reviewed_against,
               CASE WHEN d.decision IS NULL THEN 'unreviewed' WHEN d.reviewed_against IS NOT DISTINCT FROM a.hash THEN 'reviewed' ELSE 'stale' END AS review_status
        FROM a LEFT JOIN d USING (outcome_id)
    ), p0 AS (
        SELECT x.doc_id AS outcome_id, CASE source {_KNOWN} ELSE source END AS function, x.lang AS category, coalesce(x.text, '') AS outcome,
               coalesce(a.coverage, 'none') AS ai_coverage, coalesce(a.confidence, 0) AS confidence, coalesce(a.needs_review, true) AS needs_review, coalesce(a.downgraded, false) AS downgraded,
               a.rationale, a.n, a.q1, a.q2, d.decision, d.final_coverage,
               CASE WHEN d.decision IS NULL THEN 'unreviewed' WHEN d.reviewed_against IS NOT DISTINCT FROM a.hash THEN 'reviewed' ELSE 'stale' END AS review_status
        FROM documents x LEFT JOIN (SELECT * EXCLUDE (source, lang) FROM a) a ON a.outcome_id = x.doc_id LEFT JOIN d ON d.outcome_id = x.doc_id
    ), p AS (
        SELECT *, CASE WHEN review_status = 'reviewed' AND decision = 'override' THEN final_coverage END AS human_coverage,
               CASE WHEN review_status = 'reviewed' AND decision = 'override' THEN final_coverage ELSE ai_coverage END AS coverage
        FROM p0
    )
"""


def joined(spark: SparkSession, sf: str) -> DataFrame:
    from corrobora.operators.review import joined as join

    return join(assessments(spark, sf), decisions(spark, sf))


def profile(spark: SparkSession, sf: str) -> DataFrame:
    return R.profile(catalogue(spark, sf), assessments(spark, sf), decisions(spark, sf))


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as judges' replies: fenced, within prose, broken off, or out of range."""
    body = F.concat(F.lit('{"subcategory_id":"S'), F.col("doc_id").cast("string"), F.lit('","coverage":" Partial ","confidence":"0.8","evidence":[{"source_file":"a","quote":"q"},{"source_file":""},7],"rationale":"r","needs_review":" TRUE","extra":[1]}'))
    raw = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("quality") == 1, F.concat(F.lit("Here it is: "), body, F.lit(" Done.")))
        .when(F.col("toxic") == 0, F.substring(body, 1, 60))
        .otherwise(F.replace(F.replace(F.replace(body, F.lit('"0.8"'), F.lit("5")), F.lit("Partial"), F.lit("maybe")), F.lit('"r"'), F.lit('""')))
    )
    return table(spark, sf, "labels").select("doc_id", raw.alias("raw"))


REPLIES = """
    raw AS (
        SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN quality = 1 THEN 'Here it is: ' || body || ' Done.' WHEN toxic = 0 THEN body[1:60]
                            ELSE replace(replace(replace(body, '"0.8"', '5'), 'Partial', 'maybe'), '"r"', '""') END AS raw
        FROM (SELECT *, '{"subcategory_id":"S' || doc_id || '","coverage":" Partial ","confidence":"0.8","evidence":[{"source_file":"a","quote":"q"},{"source_file":""},7],"rationale":"r","needs_review":" TRUE","extra":[1]}' AS body FROM labels)
    ), cut AS (
        SELECT doc_id, regexp_replace(regexp_replace(trim(raw), '^```(json)?\\s*', '', 'i'), '\\s*```$', '') AS t FROM raw
    ), obj AS (
        SELECT doc_id, CASE WHEN json_valid(t) THEN t WHEN json_valid(regexp_extract(t, '(?s)\\{.*\\}')) AND t LIKE '%{%}%' THEN regexp_extract(t, '(?s)\\{.*\\}') END AS o FROM cut
    ), val AS (
        SELECT doc_id, o IS NOT NULL AS is_object, lower(trim(json_extract_string(o, '$.coverage'))) AS coverage, CASE WHEN o IS NOT NULL THEN greatest(0, least(1, json_extract_string(o, '$.confidence')::DOUBLE)) END AS confidence,
               CASE WHEN o IS NULL THEN NULL ELSE len(list_filter(json_extract(o, '$.evidence[*]'), lambda e: coalesce(trim(json_extract_string(e, '$.source_file')), '') <> '' AND coalesce(trim(json_extract_string(e, '$.quote')), '') <> '')) END AS n_evidence,
               lower(trim(json_extract_string(o, '$.needs_review'))) = 'true' AS needs_review, json_extract_string(o, '$.rationale') AS rationale
        FROM obj
    )
"""
