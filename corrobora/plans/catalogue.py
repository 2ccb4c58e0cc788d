"""Query keys of the evidence engine, each with its callable and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.functions import hashing as H
from corrobora.functions import numbers as N
from corrobora.functions import text as T
from corrobora.operators import assess, chunks, contract, judge, long_chunks, merkle, prompts, pruned, report, review, vectors, verify
from corrobora.operators.ordering import with_position
from corrobora.plans import inputs as I
from corrobora.plans import made_pdf, made_workbook
from corrobora.session import spread, table
from corrobora.sources import catalogue as cat
from corrobora.sources import documents as D
from corrobora.sources import workbook
from corrobora.tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)


DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents)"
WS = I.SPACE
NORM_CHUNK = r"regexp_replace(regexp_replace(text, '[ \t\f\x0B]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
TOKENS = "list_filter(string_split_regex(lower(%s), '[^a-z0-9]+'), lambda t: length(t) >= %d)"
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _keywords_sql(x: str) -> str:
    """Distinct kept tokens by first occurrence."""
    kept = f"list_filter({TOKENS % (x, 4)}, lambda t: NOT list_contains({STOP}, t))"
    return f"list_reduce(list_transform({kept}, lambda t: [t]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END, []::VARCHAR[])"


def _sentences_sql(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?]){WS}+', '\\1' || chr(1), 'g')"
    trimmed = f"regexp_replace(regexp_replace(s, '^{WS}+', ''), '{WS}+$', '')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {trimmed}), lambda s: length(s) > 0)"


# --- sources


def _paths(spark, sf):
    ext = F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "fr", ".md").when(F.col("lang") == "de", ".PDF").otherwise(".csv")
    folder = F.when(F.col("source") == "src3", ".src3").when(F.col("source") == "src4", "node_modules").otherwise(F.col("source"))
    return I.documents(spark, sf).select(F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"), F.encode("text", "UTF-8").alias("content"))


@query("""
    SELECT path, row_number() OVER (ORDER BY string_split(path, '/')[2], path) - 1 AS pos
    FROM (SELECT source || '/' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.md' ELSE '.PDF' END AS path FROM documents WHERE lang IN ('en', 'fr', 'de') AND source NOT IN ('src3', 'src4'))
""")
def s1_discover(spark, sf):
    return D.discover(_paths(spark, sf))


@query("SELECT doc_id, NULL::INTEGER AS page, sha256(ltrim(coalesce(text, ''), '\ufeff')) AS sha FROM documents")
def s2_text_segments(spark, sf):
    return D.text_segments(table(spark, sf, "documents")).select("doc_id", "page", F.sha2("text", 256).alias("sha"))


@query(r"""
    WITH w AS (
        SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents
    ), p AS (
        SELECT doc_id, a, array_to_string(w[a + 1:a + 300], ' ') AS t FROM (SELECT doc_id, w, unnest(range(0, len(w), 300)) AS a FROM w)
    )
    SELECT doc_id, (a // 300 + 1)::INT AS page, length(t) AS n_chars, sha256(t) AS text_sha256 FROM p
""")
def s4_pdf_pages(spark, sf):
    """Every document as a PDF file, in five ways of keeping text, and its pages read back."""
    files = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").mapInArrow(made_pdf.files, "path string, content binary")
    pages = D.parse(files).select(F.regexp_extract("path", r"^(-?\d+)\.", 1).cast("long").alias("doc_id"), F.explode("segments").alias("s"))
    return pages.select("doc_id", "s.page", F.length("s.text").alias("n_chars"), F.sha2("s.text", 256).alias("text_sha256"))


@query("""
    WITH l AS (SELECT doc_id, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS row FROM documents)
    SELECT doc_id, row::INT AS row, 'B' AS col, lang AS value FROM l UNION ALL SELECT doc_id, row::INT, 'C', line FROM l
""")
def s14_workbook_cells(spark, sf):
    """Every document as a workbook of its lines, with shared strings or without, and its cells read back."""
    files = table(spark, sf, "documents").select("doc_id", "text", "lang").mapInArrow(made_workbook.files, "path string, content binary")
    found = workbook.cells(files).where("sheet = 2")
    return found.select(F.regexp_extract("path", r"^(-?\d+)\.", 1).cast("long").alias("doc_id"), "row", "col", "value")


@query("""
    SELECT CASE WHEN lang NOT IN ('en', 'fr') THEN 'failed' WHEN trim(coalesce(text, '')) = '' THEN 'skipped' ELSE 'parsed' END AS status, count(*) AS n FROM documents GROUP BY 1
""")
def s6_ingest_report(spark, sf):
    return D.report(D.parse(_paths(spark, sf)))


@query(f"SELECT id, split_part(split_part(id, '-', 1), '.', 1) AS function_id, split_part(id, '-', 1) AS category_id, outcome, count(*) OVER (PARTITION BY id) > 1 AS duplicated FROM ({I.OUTCOMES})")
def s7_catalogue(spark, sf):
    rows = cat.derive_ids(I.outcomes(spark, sf))
    again = cat.duplicates(rows).withColumn("duplicated", F.lit(True))
    return rows.join(again.select("id", "duplicated"), "id", "left").select("id", "function_id", "category_id", "outcome", F.coalesce("duplicated", F.lit(False)).alias("duplicated"))


@query(f"SELECT id, split_part(id, '.', 1) AS function_id, split_part(id, '-', 1) AS category_id FROM ({I.OUTCOMES})")
def p1_derive_ids(spark, sf):
    return cat.derive_ids(I.outcomes(spark, sf)).select("id", "function_id", "category_id")


@query(f"SELECT id, coalesce(map {{'GV': 'GOVERN', 'ID': 'IDENTIFY', 'PR': 'PROTECT', 'DE': 'DETECT', 'RS': 'RESPOND', 'RC': 'RECOVER'}}[split_part(id, '.', 1)], split_part(id, '.', 1)) AS function_name FROM ({I.OUTCOMES})")
def j2_function_name(spark, sf):
    names = spark.createDataFrame(list(zip(I.IDS, report.FUNCTIONS, strict=True)), "id string, name string")
    return cat.with_names(cat.derive_ids(I.outcomes(spark, sf)), names).select("id", "function_name")


# --- text


@query(f"WITH {DOCS} SELECT doc_id, sha256({NORM_CHUNK}) AS sha FROM docs")
def f1_norm_chunk(spark, sf):
    return I.documents(spark, sf).select("doc_id", F.sha2(T.norm_for_chunks("text"), 256).alias("sha"))


@query(f"WITH {DOCS} SELECT doc_id, regexp_replace(source || ' / ' || text, '[^A-Za-z0-9._-]+', '_', 'g') AS slug FROM docs")
def f3_slug(spark, sf):
    return I.documents(spark, sf).select("doc_id", T.slug(F.concat("source", F.lit(" / "), "text")).alias("slug"))


@query(f"""
    WITH {DOCS} SELECT doc_id, regexp_replace(source || ' ' || lang, '[^A-Za-z0-9._-]+', '_', 'g') || '~' || sha256('"' || source || '/' || doc_id || '"')[1:6] || '#' || CASE WHEN lang = 'en' THEN 'na' ELSE 'p1' END || '#c' || length(text) AS id FROM docs
""")
def f4_chunk_id(spark, sf):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return I.documents(spark, sf).select("doc_id", chunks.chunk_id(path, F.concat("source", F.lit(" "), "lang"), F.when(F.col("lang") != "en", 1), F.length("text")).alias("id"))


@query(f"""
    WITH RECURSIVE {DOCS}, n AS (SELECT doc_id, {NORM_CHUNK} AS t FROM docs WHERE trim(regexp_replace(text, '{WS}+', ' ', 'g')) <> ''),
    c(doc_id, t, len, s, e, ord) AS (
        SELECT doc_id, t, length(t), 0, e, 0 FROM (SELECT doc_id, t, CASE WHEN length(t) <= 1200 THEN length(t) ELSE (SELECT 0) END AS e0, 0 AS s FROM n) x, LATERAL (SELECT CASE WHEN x.e0 > 0 THEN x.e0 ELSE
            CASE WHEN length(regexp_extract(t[1081:1201], '(?s)^(.*[.!?]){WS}', 1)) > 0 THEN 1080 + length(regexp_extract(t[1081:1201], '(?s)^(.*[.!?]){WS}', 1))
                 WHEN length(regexp_extract(t[1081:1200], '(?s)^(.*{WS})', 1)) > 0 THEN 1080 + length(regexp_extract(t[1081:1200], '(?s)^(.*{WS})', 1)) ELSE 1200 END END AS e)
        UNION ALL
        SELECT doc_id, t, len, b, CASE WHEN b + 1200 >= len THEN len
                WHEN length(regexp_extract(t[b + 1081:b + 1201], '(?s)^(.*[.!?]){WS}', 1)) > 0 THEN b + 1080 + length(regexp_extract(t[b + 1081:b + 1201], '(?s)^(.*[.!?]){WS}', 1))
                WHEN length(regexp_extract(t[b + 1081:b + 1200], '(?s)^(.*{WS})', 1)) > 0 THEN b + 1080 + length(regexp_extract(t[b + 1081:b + 1200], '(?s)^(.*{WS})', 1)) ELSE b + 1200 END, ord + 1
        FROM (SELECT *, CASE WHEN e - 200 > s THEN e - 200 ELSE e END AS b FROM c WHERE e < len)
    )
    SELECT doc_id, ord::BIGINT AS ord, s::BIGINT AS char_start, e::BIGINT AS char_end, sha256(t[s + 1:e]) AS sha FROM c
""")
def x1_chunks(spark, sf):
    made = chunks.chunk(D.text_segments(I.documents(spark, sf)))
    return made.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("ord", "char_start", "char_end")), F.sha2("text", 256).alias("sha"))


@query(f"""
    WITH RECURSIVE {DOCS}, long AS (SELECT min(doc_id) AS doc_id, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM docs GROUP BY source), n AS (SELECT doc_id, {NORM_CHUNK} AS t FROM long WHERE trim(regexp_replace(text, '{WS}+', ' ', 'g')) <> ''),
    c(doc_id, t, len, s, e, ord) AS (
        SELECT doc_id, t, length(t), 0, e, 0 FROM (SELECT doc_id, t, CASE WHEN length(t) <= 1200 THEN length(t) ELSE (SELECT 0) END AS e0, 0 AS s FROM n) x, LATERAL (SELECT CASE WHEN x.e0 > 0 THEN x.e0 ELSE
            CASE WHEN length(regexp_extract(t[1081:1201], '(?s)^(.*[.!?]){WS}', 1)) > 0 THEN 1080 + length(regexp_extract(t[1081:1201], '(?s)^(.*[.!?]){WS}', 1))
                 WHEN length(regexp_extract(t[1081:1200], '(?s)^(.*{WS})', 1)) > 0 THEN 1080 + length(regexp_extract(t[1081:1200], '(?s)^(.*{WS})', 1)) ELSE 1200 END END AS e)
        UNION ALL
        SELECT doc_id, t, len, b, CASE WHEN b + 1200 >= len THEN len
                WHEN length(regexp_extract(t[b + 1081:b + 1201], '(?s)^(.*[.!?]){WS}', 1)) > 0 THEN b + 1080 + length(regexp_extract(t[b + 1081:b + 1201], '(?s)^(.*[.!?]){WS}', 1))
                WHEN length(regexp_extract(t[b + 1081:b + 1200], '(?s)^(.*{WS})', 1)) > 0 THEN b + 1080 + length(regexp_extract(t[b + 1081:b + 1200], '(?s)^(.*{WS})', 1)) ELSE b + 1200 END, ord + 1
        FROM (SELECT *, CASE WHEN e - 200 > s THEN e - 200 ELSE e END AS b FROM c WHERE e < len)
    )
    SELECT doc_id AS segment, ord::BIGINT AS ord, s::BIGINT AS char_start, e::BIGINT AS char_end, sha256(t[s + 1:e]) AS sha FROM c
""")
def x1_long_chunks(spark, sf):
    """Each source's documents as one long segment, whose blocks are put together and cut by tasks of their own."""
    made = long_chunks.chunk_joined(I.documents(spark, sf).select("source", "doc_id", "text"))
    return made.select("segment", "ord", "char_start", "char_end", F.sha2("text", 256).alias("sha"))


@query(f"SELECT doc_id, sha256({I.norm_match_sql('text')}) AS sha FROM documents")
def f5_norm_match(spark, sf):
    return T.with_norm(I.documents(spark, sf).select("doc_id", "text"), "text", "norm").select("doc_id", F.sha2("norm", 256).alias("sha"))


@query(f"WITH {DOCS}, t AS (SELECT doc_id, {TOKENS % ('text', 3)} AS k FROM docs) SELECT doc_id, len(k) AS n, sha256(array_to_string(k, ' ')) AS sha FROM t")
def f6_tokens(spark, sf):
    rows = I.documents(spark, sf).select("doc_id", T.tokens("text").alias("k"))
    return rows.select("doc_id", F.size("k").cast("long").alias("n"), F.sha2(F.array_join("k", " "), 256).alias("sha"))


@query(f"SELECT item_id, array_to_string({_keywords_sql('text')}, ' ') AS words FROM benchmark")
def f7_keywords(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(T.keywords("text"), " ").alias("words"))


@query("SELECT DISTINCT source, lang FROM documents")
def a4_distinct(spark, sf):
    return table(spark, sf, "documents").select("source", "lang").distinct()


@query(f"WITH {DOCS}, s AS (SELECT doc_id, {_sentences_sql('text')} AS s FROM docs) SELECT doc_id, len(s) AS n, sha256(array_to_string(s, chr(10))) AS sha FROM s")
def f8_sentences(spark, sf):
    rows = I.documents(spark, sf).select("doc_id", T.sentences("text").alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.sha2(F.array_join("s", "\n"), 256).alias("sha"))


@query(f"""
    WITH h AS ({I.HITS}), k AS (SELECT item_id, {_keywords_sql('text')} AS words FROM benchmark)
    SELECT h.item_id, h.rank AS doc_id, len(list_filter(words, lambda w: contains(lower(h.text), w))) AS n FROM h JOIN k USING (item_id)
""")
def f9_kw_match(spark, sf):
    words = table(spark, sf, "benchmark").select("item_id", T.keywords("text").alias("words"))
    return I.hits(spark, sf).join(words, "item_id").select("item_id", F.col("rank").alias("doc_id"), F.size(T.contained(F.col("words"), F.lower("text"))).cast("long").alias("n"))


@query(rf"WITH {DOCS} SELECT doc_id, regexp_matches(text, '(?i)\b({T.INTENT})\b') AS intent, regexp_matches(text, '(?i)\b({T.OPERATIONAL})\b') AS operational FROM docs")
def f10_intent(spark, sf):
    return I.documents(spark, sf).select("doc_id", T.is_intent("text").alias("intent"), T.is_operational("text").alias("operational"))


@query(f"WITH {DOCS} SELECT doc_id, CASE WHEN length(text) > 300 THEN regexp_replace(text[1:300], '{WS}+$', '') || '…' ELSE text END AS quote FROM docs")
def f11_truncate(spark, sf):
    return I.documents(spark, sf).select("doc_id", T.truncated("text").alias("quote"))


@query(f"""
    WITH {I.PROFILE}, b AS (
        SELECT outcome_id, array_to_string(list_filter([CASE review_status WHEN 'unreviewed' THEN '⚠ UNREVIEWED' WHEN 'stale' THEN '⚠ STALE REVIEW' END, CASE WHEN human_coverage IS NOT NULL THEN 'reviewer override: ' || ai_coverage || ' → ' || human_coverage END,
            CASE WHEN downgraded THEN 'verifier downgraded (unverifiable quote removed)' END], lambda x: x IS NOT NULL), '; ') AS b FROM p
    ) SELECT outcome_id, CASE WHEN b = '' THEN '' ELSE ' _(' || b || ')_' END AS badge FROM b
""")
def f12_badge(spark, sf):
    return I.profile(spark, sf).select("outcome_id", report.badge(F.col("review_status"), F.col("ai_coverage"), F.col("human_coverage"), F.col("downgraded")).alias("badge"))


CSV = "CASE WHEN regexp_matches({g}, '[\",\\r\\n]') THEN '\"' || replace({g}, '\"', '\"\"') || '\"' ELSE {g} END"


def _csv_sql(x: str) -> str:
    text = f"coalesce(({x})::VARCHAR, '')"
    return CSV.format(g=f"(CASE WHEN regexp_matches({text}, '^[=+\\-@\\t\\r]') THEN '''' || {text} ELSE {text} END)")


@query(f"WITH {DOCS} SELECT doc_id, {_csv_sql('text')} AS field, {_csv_sql(chr(39) + '-' + chr(39) + ' || doc_id')} AS guarded FROM docs")
def c1_csv_escape(spark, sf):
    return I.documents(spark, sf).select("doc_id", T.csv_field("text").alias("field"), T.csv_field(F.concat(F.lit("-"), F.col("doc_id").cast("string"))).alias("guarded"))


# --- numbers, hashes, vectors


@query("SELECT l_orderkey, l_linenumber, greatest(10, least(40, trunc(l_quantity)))::INTEGER AS v, greatest(0.02, least(0.05, l_discount))::DOUBLE AS d FROM lineitem")
def m4_clamp(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", N.clamp_int(F.col("l_quantity"), 10, 40).alias("v"), N.clamp(F.col("l_discount").cast("double"), 0.02, 0.05).alias("d"))


@query(f"""
    WITH t AS (SELECT DISTINCT unnest({TOKENS % ('text', 3)}) AS token FROM benchmark)
    SELECT token, list_reduce(list_transform(string_split(token, ''), lambda c: ascii(c)::BIGINT), lambda h, x: (xor(h, x) * 16777619) & 4294967295, 2166136261::BIGINT) AS hash FROM t
""")
def m7_fnv(spark, sf):
    found = table(spark, sf, "benchmark").select(F.explode(T.tokens("text")).alias("token")).distinct()
    return found.select("token", H.fnv1a(F.col("token")).alias("hash"))


@query(f"""
    WITH t AS (SELECT item_id, unnest({TOKENS % ('text', 3)}) AS token FROM benchmark),
    h AS (SELECT item_id, list_reduce(list_transform(string_split(token, ''), lambda c: ascii(c)::BIGINT), lambda h, x: (xor(h, x) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM t)
    SELECT item_id, h % 512 AS idx, sum(CASE WHEN (h >> 9) & 1 = 1 THEN 1 ELSE -1 END)::BIGINT AS weight FROM h GROUP BY ALL HAVING weight <> 0
""")
def u1_hash_vector(spark, sf):
    hashed = table(spark, sf, "benchmark").select("item_id", F.explode(T.tokens("text")).alias("t")).withColumn("h", H.fnv1a(F.col("t")))
    sign = F.when(F.shiftright("h", 9).bitwiseAND(1) == 1, 1).otherwise(-1)
    return hashed.groupBy("item_id", (F.col("h") % 512).alias("idx")).agg(F.sum(sign).cast("long").alias("weight")).where("weight <> 0")


#: Signed counts per bucket of texts x (id, text), and their unit vectors: idx, and v as a 32-bit float.
def _hashed(x: str, name: str) -> str:
    return f"""
    {name}t AS (SELECT id, unnest({TOKENS % ('text', 3)}) AS token FROM {x}),
    {name}h AS (SELECT token, list_reduce(list_transform(string_split(token, ''), lambda c: ascii(c)::BIGINT), lambda h, x: (xor(h, x) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM (SELECT DISTINCT token FROM {name}t)),
    {name}w AS (SELECT id, h % 512 AS idx, sum(CASE WHEN (h >> 9) & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS w FROM {name}t JOIN {name}h USING (token) GROUP BY ALL HAVING w <> 0),
    {name} AS (SELECT id, idx, (w / sqrt(sum(w * w) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS v FROM {name}w)"""


@query(f"WITH x AS (SELECT item_id AS id, text FROM benchmark), {_hashed('x', 'u')} SELECT id AS item_id, idx, round(v * 1000000)::BIGINT AS millionths FROM u")
def u1_hash_embedder(spark, sf):
    """The unit vectors that the embedder itself gives, but for their zeros."""
    made = vectors.embed(table(spark, sf, "benchmark").select("item_id", "text"), "text").select("item_id", F.posexplode("vector").alias("idx", "v")).where("v <> 0")
    return made.select("item_id", F.col("idx").cast("long").alias("idx"), F.round(F.col("v").cast("double") * 1000000).cast("long").alias("millionths"))


@query("""
    SELECT vec_id, len(embedding) AS dims, abs(list_sum(list_transform(u, lambda x: x * x)) - 1) < 1e-6 AS is_unit, array_to_string(list_transform(u, lambda x: round(x::FLOAT::DOUBLE * 1000000)::BIGINT), ',') AS millionths
    FROM (SELECT vec_id, embedding, list_transform(embedding, lambda x: (x::DOUBLE * (label + 1))::FLOAT::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: (y::DOUBLE * (label + 1))::FLOAT::DOUBLE * (y::DOUBLE * (label + 1))::FLOAT::DOUBLE)))) AS u FROM embeddings)
""")
def m1_l2norm(spark, sf):
    scaled = F.transform("embedding", lambda x: (x * (F.col("label") + 1)).cast("float"))
    rows = table(spark, sf, "embeddings").select("vec_id", N.l2_normalised(scaled).alias("u"))
    return rows.select("vec_id", F.size("u").cast("long").alias("dims"), (F.abs(N.squares(F.col("u")) - 1) < 1e-6).alias("is_unit"), F.array_join(F.transform("u", lambda x: F.round(x.cast("double") * 1000000).cast("long")), ",").alias("millionths"))


_SCORES = """
    u AS (SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))::FLOAT) AS q, embedding AS e FROM embeddings),
    s AS (SELECT a.vec_id AS qid, b.vec_id, round(list_sum(list_transform(list_zip(a.q, b.e), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 9) AS score FROM u a, u b WHERE a.vec_id % 20 = 0)
"""


def _embeddings(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return rows, rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")


@query(f"WITH {_SCORES} SELECT qid, count(*) AS n, count(*) FILTER (score >= 0.25) AS near FROM s GROUP BY qid")
def j1_similarity(spark, sf):
    rows, asked = _embeddings(spark, sf)
    return vectors.count_near(rows, asked, 0.25, row_id="vec_id")


@query(f"WITH {_SCORES} SELECT qid, vec_id, round(score * 1000000)::BIGINT AS millionths FROM s")
def j1_scores(spark, sf):
    """Every query's score with every row."""
    rows, asked = _embeddings(spark, sf)
    found = vectors.scores(rows, asked, row_id="vec_id")
    return found.select("qid", "vec_id", F.round(F.col("score") * 1000000).cast("long").alias("millionths"))


@query(f"WITH {_SCORES} SELECT qid, rank, vec_id FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 6")
def w1_topk(spark, sf):
    rows, asked = _embeddings(spark, sf)
    return vectors.top_k(rows, asked, 6, row_id="vec_id").select("qid", F.col("rank").cast("long").alias("rank"), "vec_id")


@query(f"WITH {_SCORES} SELECT qid, rank, vec_id FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 6")
def w1_topk_pruned(spark, sf):
    """The same by inverted lists with block maxima."""
    rows, asked = _embeddings(spark, sf)
    index = written(pruned.build(rows, "vec_id"))
    return pruned.search(index, asked, 6, row_id="vec_id").select("qid", F.col("rank").cast("long").alias("rank"), "vec_id")


@query("""SELECT doc_id, sha256('{"quality":' || quality || ',"toxic":' || toxic || '}')[1:12] AS hash FROM labels""")
def h1_short_hash(spark, sf):
    return table(spark, sf, "labels").select("doc_id", H.short_hash(H.canonical(F.struct("quality", "toxic"))).alias("hash"))


_INDEX_ID = """
    WITH l AS (
        SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, sha256('{"char_end":' || length(coalesce(text, '')) || ',"char_start":0,"id":"' || doc_id || '","page":null,"source_file":' || to_json(source) || ',"text":' || to_json(coalesce(text, '')) || '}') AS h FROM documents
    ), g AS (SELECT pos // 4096 AS g, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM l GROUP BY 1)
    SELECT sha256('{"chunk_params":{"overlap":200,"size":1200},"embedder_id":"mock"}' || string_agg(h, '' ORDER BY g))[1:12] AS index_id FROM g
"""


def _index_id(spark, sf):
    docs = I.documents(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_file"), F.lit(None).cast("int").alias("page"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), "text")
    return chunks.index_id(with_position(docs, "pos", F.col("doc_id")), "mock", 1200, 200)


@query(f"""SELECT sha256('{{"chunkOverlap":200,"chunkSize":1200,"critique":false,"embeddingModel":"mock","indexId":"' || index_id || '","llmModel":"lexical","topK":6}}')[1:12] AS engine_sig FROM ({_INDEX_ID})""")
def h2_engine_sig(spark, sf):
    """The signature that assessments over an index of all documents carry."""
    found = _index_id(spark, sf).first()
    return spark.createDataFrame([(H.engine_signature("mock", "lexical", 6, 1200, 200, False, found.index_id),)], "engine_sig string")


@query(f"SELECT outcome_id, hash FROM ({I.ASSESSMENTS})")
def h3_assessment_hash(spark, sf):
    return I.assessments(spark, sf).select("outcome_id", "hash")


@query(_INDEX_ID)
def h4_index_id(spark, sf):
    return _index_id(spark, sf)


@query("""
    WITH a AS (
        SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, text FROM documents
    ), b AS (
        SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, CASE WHEN lang = 'de' AND source IN ('src1', 'src2') THEN coalesce(text, '') || '!' ELSE text END AS text FROM documents WHERE doc_id <= (SELECT max(doc_id) FROM documents) - 30
    ), d AS (
        SELECT coalesce(a.pos, b.pos) AS pos FROM a FULL JOIN b ON a.pos = b.pos
        WHERE (a.pos IS NULL) OR (b.pos IS NULL) OR coalesce(a.text, '') <> coalesce(b.text, '')
    )
    SELECT pos // 8 * 8 AS first, pos // 8 * 8 + 7 AS last, count(*) AS changed FROM d GROUP BY pos // 8
""")
def h4_changed_ranges(spark, sf):
    """Where an index of all documents and one with some changed and the last ones gone differ, by their trees."""
    docs = I.documents(spark, sf).select("doc_id", "lang", "source", "text")
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    changed = F.when((F.col("lang") == "de") & F.col("source").isin("src1", "src2"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    one, other = (merkle.tree(with_position(x, "pos", F.col("doc_id")), F.sha2("text", 256), 8) for x in (docs, docs.where(F.col("doc_id") <= last - 30).withColumn("text", changed)))
    return merkle.ranges(one, other, 8)


# --- replies


@query(f"WITH {I.REPLIES} SELECT doc_id, o IS NOT NULL AS found FROM obj")
def n1_extract_json(spark, sf):
    return I.replies(spark, sf).select("doc_id", contract.json_object(F.col("raw")).isNotNull().alias("found"))


@query(f"WITH {I.REPLIES} SELECT doc_id, json_extract_string(o, '$.subcategory_id') AS subcategory_id, json_extract_string(o, '$.coverage') AS coverage, json_extract_string(o, '$.confidence') AS confidence, json_extract_string(o, '$.evidence[0].quote') AS quote, json_extract_string(o, '$.extra[0]') AS extra FROM obj")
def n1_extracted(spark, sf):
    """What the object within each reply holds, before anything is coerced."""
    o = I.replies(spark, sf).select("doc_id", contract.json_object(F.col("raw")).alias("o"))
    return o.select("doc_id", *(F.try_variant_get("o", f"$.{path}", "string").alias(name) for name, path in (("subcategory_id", "subcategory_id"), ("coverage", "coverage"), ("confidence", "confidence"), ("quote", "evidence[0].quote"), ("extra", "extra[0]"))))


@query(f"""
    WITH {I.REPLIES}, e AS (
        SELECT doc_id, list_filter(list_transform(json_extract(o, '$.evidence[*]'), lambda e: concat(json_extract_string(e, '$.source_file'), ' | ', json_extract_string(e, '$.quote'))), lambda x: trim(split_part(x, ' | ', 1)) <> '' AND trim(split_part(x, ' | ', 2)) <> '') AS items FROM obj WHERE o IS NOT NULL
    ) SELECT doc_id, array_to_string(items, ',') AS items FROM e
""")
def n2_evidence(spark, sf):
    """The evidence items that are left of each reply."""
    rows = contract.validated(I.replies(spark, sf)).where("value IS NOT NULL")
    return rows.select("doc_id", F.array_join(F.transform("value.evidence", lambda e: F.concat_ws(" | ", e["source_file"], e["quote"])), ",").alias("items"))


@query(f"WITH {I.REPLIES} SELECT doc_id, coverage, confidence, n_evidence, needs_review FROM val")
def n2_coerce(spark, sf):
    rows = contract.validated(I.replies(spark, sf))
    return rows.select("doc_id", "value.coverage", "value.confidence", F.when(F.col("value").isNotNull(), F.size("value.evidence")).cast("long").alias("n_evidence"), "value.needs_review")


@query(f"""
    WITH {I.REPLIES}, e AS (
        SELECT doc_id, CASE WHEN NOT is_object THEN 1 ELSE (coalesce(coverage, '') NOT IN ('none', 'partial', 'substantial', 'full'))::INT + (confidence IS NULL)::INT + (coalesce(rationale, '') = '')::INT + (needs_review IS NULL)::INT END::BIGINT AS n FROM val
    ) SELECT doc_id, n = 0 AS ok, n AS n_errors FROM e
""")
def n3_validate(spark, sf):
    return contract.validated(I.replies(spark, sf)).select("doc_id", "ok", F.size("errors").cast("long").alias("n_errors"))


# --- evidence


@query(f"WITH {I.CLAIMS} SELECT item_id, pos, hit_source, page, chunk_id, verified, attribution_corrected FROM verified")
def j5_quote_verify(spark, sf):
    found = verify.verify_quotes(I.claims(spark, sf), I.hits(spark, sf), "item_id")
    return found.select("item_id", "pos", "hit_source", F.col("page").cast("long").alias("page"), "chunk_id", "verified", "attribution_corrected")


@query(f"""
    WITH h AS (SELECT doc_id, {I.norm_match_sql('text')} AS norm FROM documents),
    q AS (
        SELECT 'item ' || item_id AS quote_id, {I.norm_match_sql('text')} AS needle FROM benchmark
        UNION ALL SELECT 'doc ' || doc_id, {I.norm_match_sql("coalesce(text, '')[length(text) // 3 + 1:length(text) // 3 + 60]")} FROM documents
    ), ok AS (
        SELECT * FROM q WHERE length(needle) >= 20 AND len(regexp_extract_all(needle, '[a-z]{{3,}}')) >= 3
    ), f AS (
        SELECT ok.quote_id, min(h.doc_id) AS first_doc FROM ok JOIN h ON contains(h.norm, ok.needle) GROUP BY ok.quote_id
    )
    SELECT q.quote_id, f.first_doc, f.first_doc IS NOT NULL AS verified FROM q LEFT JOIN f USING (quote_id)
""")
def j5_one_outcome(spark, sf):
    """Every document is a hit of one outcome, whose quotes are all items' texts and a stretch of every document."""
    docs = I.documents(spark, sf)
    third = F.floor(F.length("text") / 3).cast("int") + 1
    asked = table(spark, sf, "benchmark").select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("pos"), F.coalesce("text", F.lit("")).alias("quote")).unionByName(docs.select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("pos"), F.substring("text", third, F.lit(60)).alias("quote")))
    hits = docs.select(F.lit("o").alias("outcome_id"), F.col("doc_id").alias("rank"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("source_file"), F.lit(None).cast("int").alias("page"), "text")
    found = verify.verify_quotes(asked.select(F.lit("o").alias("outcome_id"), "pos", F.lit("x").alias("source_file"), "quote"), hits)
    return found.select(F.col("pos").alias("quote_id"), F.col("chunk_id").cast("long").alias("first_doc"), "verified")


@query(f"WITH c AS (SELECT doc_id, {I.norm_match_sql('text')} AS n FROM documents) SELECT doc_id, length(n) >= 20 AND len(regexp_extract_all(n, '[a-z]{{3,}}')) >= 3 AS substantive FROM c")
def p5_substantive(spark, sf):
    return T.with_norm(I.documents(spark, sf).select("doc_id", "text"), "text", "norm").select("doc_id", T.substantive("norm").alias("substantive"))


_DOWNGRADED = f"""
    {I.CLAIMS}, x AS (SELECT item_id, count(*) AS checked, count(*) FILTER (verified) AS kept FROM verified GROUP BY item_id),
    u AS (
        SELECT item_id, CASE WHEN c.coverage <> 'none' AND kept = 0 THEN 'none' ELSE c.coverage END AS coverage, CASE WHEN c.coverage <> 'none' AND kept = 0 THEN 0 ELSE c.confidence END AS confidence,
               needs_review OR checked > kept AS needs_review, checked, kept, c.coverage <> 'none' AND kept = 0 AS downgraded,
               CASE WHEN c.coverage <> 'none' AND kept = 0 THEN '{verify.DOWNGRADED}' WHEN checked > kept THEN 'dropped_' || (checked - kept) || '_unverifiable_quote' || CASE WHEN checked - kept = 1 THEN '' ELSE 's' END END AS verifier_action
        FROM ({I.CLAIMED}) c JOIN x USING (item_id)
    )
"""


def _downgraded(spark, sf):
    return verify.downgrade(I.claimed(spark, sf), verify.verify_quotes(I.claims(spark, sf), I.hits(spark, sf), "item_id"), "item_id")


@query(f"WITH {_DOWNGRADED} SELECT item_id, coverage, confidence, needs_review, checked AS quotes_checked, kept AS quotes_verified, downgraded, verifier_action, CASE WHEN coverage = 'none' THEN 0 ELSE kept END AS n_evidence FROM u")
def u5_verify_downgrade(spark, sf):
    rows = _downgraded(spark, sf)
    return rows.select("item_id", "coverage", "confidence", "needs_review", "quotes_checked", "quotes_verified", "downgraded", "verifier_action", F.size("evidence").cast("long").alias("n_evidence"))


@query(f"WITH {_DOWNGRADED} SELECT count(*) FILTER (coverage = 'none') AS n_none, count(*) FILTER (coverage = 'partial') AS n_partial, count(*) FILTER (coverage = 'substantial') AS n_substantial, count(*) FILTER (coverage = 'full') AS n_full FROM u")
def a2_coverage_tally(spark, sf):
    return _downgraded(spark, sf).agg(*report.tally())


def _judge_inputs(spark, sf):
    """Items and documents with words that the judge looks for."""
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("outcome"))
    return items, I.hits(spark, sf)


_JUDGE = rf"""
    h AS ({I.HITS}), k AS (SELECT item_id, {_keywords_sql('text')} AS words FROM benchmark),
    m AS (SELECT h.item_id, h.rank, h.source_file, h.text, list_filter(k.words, lambda w: contains(lower(h.text), w)) AS found FROM h JOIN k USING (item_id)),
    b AS (SELECT item_id, arg_max({{'f': source_file, 't': text, 'w': found}}, (len(found)::BIGINT << 40) - rank) AS b FROM m GROUP BY item_id),
    r AS (SELECT k.item_id, len(k.words) AS n_keywords, coalesce(len(b.b.w), 0) AS matched, coalesce(len(b.b.w), 0)::DOUBLE / greatest(1, len(k.words)) AS ratio, b.b AS b FROM k LEFT JOIN b USING (item_id)),
    s AS (SELECT *, matched < 3 OR ratio < 0.25 AS nothing, CASE WHEN NOT (matched < 3 OR ratio < 0.25) THEN {_sentences_sql('b.t')} END AS ss FROM r),
    q AS (SELECT *, list_transform(ss, lambda x: len(list_filter(b.w, lambda w: contains(lower(x), w)))) AS counts FROM s),
    z AS (SELECT *, CASE WHEN NOT nothing THEN coalesce(ss[list_position(counts, list_max(counts))], b.t) END AS quote FROM q),
    y AS (SELECT *, regexp_matches(quote, '(?i)\b({T.OPERATIONAL})\b') AS does, regexp_matches(quote, '(?i)\b({T.INTENT})\b') AS means FROM z),
    x AS (SELECT *, CASE WHEN nothing THEN 'none' WHEN means AND NOT does THEN 'partial' WHEN ratio >= 0.7 AND does THEN 'full' WHEN ratio >= 0.45 AND does THEN 'substantial' ELSE 'partial' END AS coverage FROM y),
    v AS (SELECT *, CASE coverage WHEN 'none' THEN 0.3::DOUBLE WHEN 'partial' THEN greatest(0.4::DOUBLE, least(0.62::DOUBLE, 0.45::DOUBLE + ratio * 0.2::DOUBLE)) WHEN 'substantial' THEN greatest(0.6::DOUBLE, least(0.82::DOUBLE, 0.6::DOUBLE + ratio * 0.2::DOUBLE)) ELSE 0.85::DOUBLE END AS raw FROM x),
    judged AS (SELECT item_id, n_keywords, matched, coverage, round(format('{{:.25f}}', raw)::DECIMAL(38, 25), 2)::DOUBLE AS confidence, quote, CASE WHEN NOT nothing THEN b.f END AS source_file, nothing OR coverage = 'partial' OR raw < 0.6 AS needs_review FROM v)
"""


@query(f"WITH {_JUDGE} SELECT item_id, n_keywords, matched, coverage, confidence, quote, source_file, needs_review FROM judged")
def u2_lexical_judge(spark, sf):
    rows = judge.lexical(*_judge_inputs(spark, sf), key="item_id").drop("rationale")
    return rows.withColumns({c: F.col(c).cast("long") for c in ("n_keywords", "matched")})


_ASSESSED = f"""
    {_JUDGE}, g AS (
        SELECT j.*, quote IS NOT NULL AND length(nq) >= 20 AND len(regexp_extract_all(nq, '[a-z]{{3,}}')) >= 3 AND EXISTS (SELECT 1 FROM h WHERE h.item_id = j.item_id AND contains({I.norm_match_sql('h.text')}, nq)) AS ok, j.item_id IN (SELECT item_id FROM h) AS any_hit
        FROM (SELECT *, {I.norm_match_sql('quote')} AS nq FROM judged) j
    ), w AS (
        SELECT item_id, NOT any_hit AS fallback, CASE WHEN any_hit AND (coverage = 'none' OR ok) THEN coverage ELSE 'none' END AS coverage,
               CASE WHEN NOT any_hit THEN 0 WHEN coverage <> 'none' AND NOT ok THEN 0 ELSE confidence END AS confidence, any_hit AND coverage <> 'none' AND NOT ok AS downgraded,
               NOT any_hit OR needs_review OR (quote IS NOT NULL AND NOT ok) OR confidence < 0.6 AS needs_review
        FROM g
    )
"""


@query(f"WITH {_ASSESSED} SELECT item_id, coverage, confidence, needs_review, downgraded, fallback FROM w")
def u4_assess(spark, sf):
    return assess.assess(*_judge_inputs(spark, sf), key="item_id").select("item_id", "coverage", "confidence", "needs_review", "downgraded", "fallback")


def _sceptic(outcomes, hits, key, first=None):
    """Judges as the lexical judge; as a critic it answers a third of the outcomes with nothing valid, lowers a third
    of those that are covered well, and confirms the rest."""
    judged = judge.lexical_verdicts(outcomes, hits, key, first)
    if first is None:
        return judged
    lowered = (F.col(key) % 3 == 1) & F.col("coverage").isin("substantial", "full")
    return judged.withColumns({
        "coverage": F.when(lowered, "partial").otherwise(F.col("coverage")), "confidence": F.when(lowered, 0.5).otherwise(F.col("confidence")), "fallback_reason": F.when(F.col(key) % 3 == 0, "no object"),
    })


@query(f"""
    WITH {_ASSESSED}, l AS (SELECT *, item_id % 3 = 1 AND coverage IN ('substantial', 'full') AS lowered FROM w)
    SELECT item_id, CASE WHEN lowered THEN 'partial' ELSE coverage END AS coverage, CASE WHEN lowered THEN 0.5 ELSE confidence END AS confidence, needs_review OR lowered OR item_id % 3 = 0 AS needs_review,
           CASE WHEN NOT fallback THEN lowered END AS critique_applied
    FROM l
""")
def u6_critique(spark, sf):
    return assess.assess(*_judge_inputs(spark, sf), _sceptic, critique=True, key="item_id").select("item_id", "coverage", "confidence", "needs_review", "critique_applied")


@query(f"""
    WITH h AS ({I.HITS}), s AS (SELECT *, (length(text) % 9973) / 9973.0::DOUBLE AS score FROM h)
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY rank) - 1)::INTEGER AS pos, chunk_id, source_file, page, round(format('{{:.25f}}', score)::DECIMAL(38, 25), 4)::DOUBLE AS score FROM s
""")
def u10_retrieved(spark, sf):
    scored = I.hits(spark, sf).withColumn("score", F.length("text") % 9973 / 9973)
    items = table(spark, sf, "benchmark").select("item_id")
    return assess.enriched(items, items, scored, "item_id").select("item_id", F.posexplode("retrieved").alias("pos", "r")).select("item_id", "pos", "r.*")


@query(f"WITH a AS ({I.ASSESSMENTS}) SELECT count(*) FILTER (needs_review) AS flagged FROM a")
def p9_flagged(spark, sf):
    return assess.flagged(I.assessments(spark, sf))


@query(f"SELECT item_id, 'none' AS coverage, 0::DOUBLE AS confidence, true AS needs_review, '{assess.NO_EVIDENCE}' AS fallback_reason FROM benchmark")
def u7_fallback(spark, sf):
    return assess.fallback(table(spark, sf, "benchmark"), assess.NO_EVIDENCE, "item_id").select("item_id", "coverage", "confidence", "needs_review", "fallback_reason")


@query("SELECT doc_id, toxic = 1 OR quality * 0.5::DOUBLE + toxic * 0.25::DOUBLE < 0.6::DOUBLE AS needs_review FROM labels")
def p6_threshold(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 1).alias("needs_review"), (F.col("quality") * 0.5 + F.col("toxic") * 0.25).alias("confidence"))
    return assess.flag_low(rows).select("doc_id", "needs_review")


_PROMPT = prompts.ASK.replace("'", "''")


@query(f"""
    WITH h AS ({I.HITS}), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS n FROM h),
    e AS (SELECT item_id, string_agg('[' || n || '] ' || source_file || CASE WHEN page IS NULL THEN '' ELSE ', p.' || page END || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS evidence FROM r WHERE n <= 6 GROUP BY item_id)
    SELECT b.item_id, sha256('Outcome ' || b.item_id || ': ' || b.text || chr(10) || chr(10) || 'Excerpts:' || chr(10) || coalesce(e.evidence, '{prompts.NOTHING}') || chr(10) || chr(10) || '{_PROMPT}') AS sha FROM benchmark b LEFT JOIN e USING (item_id)
""")
def f15_prompt_task(spark, sf):
    """The whole task that a model judge gets for each item, from the library."""
    hits = I.hits(spark, sf).withColumn("n", F.row_number().over(_by_rank())).where("n <= 6")
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("outcome"))
    return prompts.task(items, hits, "item_id").select("item_id", F.sha2("prompt", 256).alias("sha"))


def f15_prompt_evidence(spark, sf):
    """Numbered, labelled blocks of an item's evidence, in rank order."""
    block = F.concat(F.lit("["), F.row_number().over(_by_rank()).cast("string"), F.lit("] "), T.location("source_file", "page"), F.lit("\n"), F.col("text"))
    rows = I.hits(spark, sf).withColumn("n", F.row_number().over(_by_rank())).where("n <= 6").withColumn("block", block)
    made = rows.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n\n").alias("prompt"))
    items = table(spark, sf, "benchmark").select("item_id")
    return items.join(made, "item_id", "left").select("item_id", F.sha2(F.coalesce("prompt", F.lit("(no evidence)")), 256).alias("sha"))


def _by_rank():
    from pyspark.sql import Window

    return Window.partitionBy("item_id").orderBy("rank")


query(f"""
    WITH h AS ({I.HITS}), n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS n FROM h),
    b AS (SELECT item_id, string_agg('[' || n || '] ' || source_file || CASE WHEN coalesce(page, 0) <> 0 THEN ', p.' || page ELSE '' END || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS prompt FROM n WHERE n <= 6 GROUP BY item_id)
    SELECT item_id, sha256(coalesce(prompt, '(no evidence)')) AS sha FROM benchmark LEFT JOIN b USING (item_id)
""")(f15_prompt_evidence)


# --- cache


def _stored(spark, sf):
    sig = F.when(F.col("toxic") == 0, "now").otherwise("before")
    return table(spark, sf, "labels").select("doc_id", sig.alias("engine_sig"), F.lit("stored").alias("state"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def j6_resume(spark, sf):
    return assess.unfinished(table(spark, sf, "documents").select("doc_id"), _stored(spark, sf), "now", "doc_id")


@query("""
    SELECT doc_id, engine_sig, state FROM (SELECT doc_id, CASE WHEN toxic = 0 THEN 'now' ELSE 'before' END AS engine_sig, 'stored' AS state FROM labels) WHERE engine_sig = 'now'
    UNION ALL SELECT doc_id, 'now', 'new' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)
""")
def j7_upsert(spark, sf):
    new = j6_resume(spark, sf).select("doc_id", F.lit("now").alias("engine_sig"), F.lit("new").alias("state"))
    return assess.upsert(_stored(spark, sf), new, "doc_id")


# --- review and report


@query(f"WITH {I.PROFILE} SELECT outcome_id, review_status FROM j")
def j4_review_status(spark, sf):
    return I.joined(spark, sf).select("outcome_id", "review_status")


@query(f"WITH {I.PROFILE} SELECT outcome_id, review_status FROM j WHERE review_status = 'stale' OR (review_status = 'unreviewed' AND needs_review)")
def p7_review_queue(spark, sf):
    return review.queue(I.joined(spark, sf)).select("outcome_id", "review_status")


@query(f"WITH {I.PROFILE} SELECT outcome_id, CASE WHEN review_status = 'reviewed' AND decision = 'override' THEN final_coverage ELSE coverage END AS effective_coverage FROM j")
def u8_effective(spark, sf):
    return I.joined(spark, sf).select("outcome_id", "effective_coverage")


@query(f"WITH {I.PROFILE} SELECT outcome_id, 'accept' AS decision, coverage AS final_coverage, 'me' AS reviewed_by, hash AS reviewed_against FROM j WHERE review_status = 'stale' OR (review_status = 'unreviewed' AND needs_review)")
def u9_accept_all(spark, sf):
    return review.accept_all(I.joined(spark, sf), "me").select("outcome_id", "decision", "final_coverage", "reviewed_by", "reviewed_against")


@query(f"WITH {I.PROFILE} SELECT count(*) FILTER (review_status = 'reviewed' AND decision <> 'override') AS reviewed, count(*) FILTER (review_status = 'reviewed' AND decision = 'override') AS overridden, 0::BIGINT AS skipped, count(*) FILTER (review_status <> 'reviewed') AS remaining FROM j")
def a7_review_stats(spark, sf):
    return review.stats(I.joined(spark, sf))


@query(f"WITH {I.PROFILE} SELECT outcome_id, function, coverage, confidence, review_status, ai_coverage, human_coverage, needs_review FROM p")
def j3_profile(spark, sf):
    return I.profile(spark, sf).select("outcome_id", "function", "coverage", "confidence", "review_status", "ai_coverage", "human_coverage", "needs_review")


_TALLY = ", ".join(f"count(*) FILTER (coverage = '{x}') AS n_{x}" for x in N.LEVELS)


@query(f"""
    WITH {I.PROFILE} SELECT count(*) AS total, {_TALLY}, count(*) FILTER (coverage IN ('none', 'partial')) AS gaps, count(*) FILTER (review_status = 'reviewed') AS reviewed, count(*) FILTER (review_status = 'unreviewed') AS unreviewed,
        count(*) FILTER (review_status = 'stale') AS stale, count(human_coverage) AS overridden, count(*) FILTER (downgraded) AS downgraded_by_verifier FROM p
""")
def a1_summary(spark, sf):
    return report.summary(I.profile(spark, sf))


@query(f"""
    WITH {I.PROFILE} SELECT CASE grouping(function, category) WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS level, function, category, count(*) AS total, {_TALLY}, count(*) FILTER (coverage IN ('none', 'partial')) AS gaps,
        count(*) FILTER (review_status = 'reviewed') AS reviewed, count(*) FILTER (review_status = 'unreviewed') AS unreviewed, count(*) FILTER (review_status = 'stale') AS stale, count(human_coverage) AS overridden,
        count(*) FILTER (downgraded) AS downgraded_by_verifier, floor(count(*) FILTER (coverage IN ('substantial', 'full'))::DOUBLE / count(*) * 100 + 0.5::DOUBLE)::INTEGER AS pct
    FROM p GROUP BY GROUPING SETS ((), (function), (function, category))
""")
def a1_totals(spark, sf):
    """All of a report's counts, over everything, by function and by category, from one pass over the profile."""
    return report.totals(I.profile(spark, sf))


@query(f"WITH {I.PROFILE} SELECT function, count(*) AS total, {_TALLY}, floor(count(*) FILTER (coverage IN ('substantial', 'full'))::DOUBLE / count(*) * 100 + 0.5::DOUBLE)::INTEGER AS pct FROM p GROUP BY function")
def a3_by_function(spark, sf):
    return report.by_function(I.profile(spark, sf))


@query(f"WITH {I.PROFILE} SELECT outcome_id, coverage IN ('none', 'partial') AS gap FROM p")
def p3_gaps(spark, sf):
    return I.profile(spark, sf).select("outcome_id", N.is_gap(F.col("coverage")).alias("gap"))


@query(f"WITH {I.PROFILE} SELECT outcome_id, (list_position(['none', 'partial', 'substantial', 'full'], coverage) - 1)::INTEGER AS level FROM p")
def p4_coverage_rank(spark, sf):
    return I.profile(spark, sf).select("outcome_id", N.level(F.col("coverage")).alias("level"))


_FN_RANK = f"coalesce(list_position([{', '.join(repr(x) for x in report.FUNCTIONS)}], function) - 1, 99)"


@query(f"WITH {I.PROFILE} SELECT function, row_number() OVER (ORDER BY {_FN_RANK}, function) - 1 AS pos FROM (SELECT DISTINCT function FROM p)")
def t2_function_order(spark, sf):
    return report.function_order(I.profile(spark, sf)).select("function", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {I.PROFILE} SELECT outcome_id, function, row_number() OVER (PARTITION BY function ORDER BY coverage <> 'none', outcome_id) - 1 AS pos FROM p WHERE coverage IN ('none', 'partial')")
def t3_gaps_order(spark, sf):
    return report.gaps_order(I.profile(spark, sf)).select("outcome_id", "function", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {I.PROFILE} SELECT outcome_id, function, row_number() OVER (PARTITION BY function ORDER BY outcome_id) - 1 AS pos FROM p WHERE coverage NOT IN ('none', 'partial')")
def t4_covered_order(spark, sf):
    return report.covered_order(I.profile(spark, sf)).select("outcome_id", "function", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {I.PROFILE} SELECT outcome_id, review_status FROM p WHERE review_status <> 'reviewed' ORDER BY outcome_id LIMIT 10")
def p8_strict_gate(spark, sf):
    return report.unresolved(I.profile(spark, sf)).select("outcome_id", "review_status")


_MAP = f"""
    {I.PROFILE}, m AS (
        SELECT outcome_id, function, category, p.coverage, p.confidence, review_status, e.source_file, e.page, e.quote, rationale, e.source_file IS NOT NULL AS has_one
        FROM p LEFT JOIN (
            SELECT a.outcome_id AS id, a.source AS source_file, CASE WHEN a.lang <> 'en' THEN 1 END AS page, unnest(CASE WHEN a.coverage = 'none' THEN [] WHEN a.n % 2 = 0 THEN [a.q1] ELSE [a.q1, a.q2] END) AS quote FROM a
        ) e ON e.id = p.outcome_id
    ), ev AS (
        SELECT outcome_id::VARCHAR AS subcategory_id, function, category, coverage, confidence, review_status, coalesce(source_file, '') AS source_file, coalesce(page::VARCHAR, '') AS page, CASE WHEN has_one THEN '0.5' ELSE '' END AS similarity,
               coalesce(quote, '') AS quote, CASE WHEN has_one THEN 'yes' ELSE '' END AS quote_verified, rationale FROM m
    )
"""


@query(f"WITH {_MAP} SELECT * FROM ev")
def s13_evidence_map(spark, sf):
    return report.evidence_map(I.profile(spark, sf))


_LINE_COLUMNS = ["subcategory_id", "function", "category", "coverage", "review_status", "source_file", "page", "similarity", "quote", "quote_verified", "rationale"]


@query(f"WITH {_MAP} SELECT concat_ws(',', {', '.join(_csv_sql(c) for c in _LINE_COLUMNS)}) AS line FROM ev")
def s11_csv_lines(spark, sf):
    return report.evidence_map(I.profile(spark, sf)).select(T.csv_line(*_LINE_COLUMNS).alias("line"))


# --- end to end


def _chunked(spark, sf):
    """All documents' chunks, cut once and stored, as they are embedded first and shown later."""
    return written(chunks.chunk(D.text_segments(I.documents(spark, sf))).withColumn("chunk_id", F.concat_ws("#", "doc_id", "ord")))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Per benchmark item its six most similar chunks, and whether its text is verbatim in one of them."""
    made = _chunked(spark, sf)
    index = vectors.embed(made, "text").select("chunk_id", "vector")
    items = table(spark, sf, "benchmark")
    asked = vectors.embed(items.select(F.col("item_id").alias("qid"), "text"), "text").select("qid", "vector")
    best = vectors.top_k(index, asked, 6, row_id="chunk_id").withColumnRenamed("qid", "item_id")
    hits = best.join(made.select("chunk_id", F.col("doc_id").cast("string").alias("source_file"), "page", "text"), "chunk_id")
    claims = items.select("item_id", F.lit(0).alias("pos"), F.lit("").alias("source_file"), F.col("text").alias("quote"))
    checked = verify.verify_quotes(claims, hits, "item_id", bounded=True)
    claim = items.select("item_id", F.lit("full").alias("coverage"), F.lit(0.9).alias("confidence"), F.lit("claimed verbatim").alias("rationale"), F.lit(False).alias("needs_review"))
    return verify.downgrade(claim, checked, "item_id").select("item_id", "coverage", "confidence", "verifier_action", F.transform("evidence", lambda e: e["chunk_id"]).alias("chunks"))


@query()
def e2e_support(spark, sf):
    return flagship(spark, sf)


@query(f"""
    WITH RECURSIVE {DOCS}, n AS (SELECT doc_id, {NORM_CHUNK} AS t FROM docs WHERE trim(regexp_replace(text, '{WS}+', ' ', 'g')) <> ''),
    c(doc_id, t, len, s, e, ord) AS (
        SELECT doc_id, t, length(t), 0, e, 0 FROM (SELECT doc_id, t, CASE WHEN length(t) <= 1200 THEN length(t) ELSE (SELECT 0) END AS e0, 0 AS s FROM n) x, LATERAL (SELECT CASE WHEN x.e0 > 0 THEN x.e0 ELSE
            CASE WHEN length(regexp_extract(t[1081:1201], '(?s)^(.*[.!?]){WS}', 1)) > 0 THEN 1080 + length(regexp_extract(t[1081:1201], '(?s)^(.*[.!?]){WS}', 1))
                 WHEN length(regexp_extract(t[1081:1200], '(?s)^(.*{WS})', 1)) > 0 THEN 1080 + length(regexp_extract(t[1081:1200], '(?s)^(.*{WS})', 1)) ELSE 1200 END END AS e)
        UNION ALL
        SELECT doc_id, t, len, b, CASE WHEN b + 1200 >= len THEN len
                WHEN length(regexp_extract(t[b + 1081:b + 1201], '(?s)^(.*[.!?]){WS}', 1)) > 0 THEN b + 1080 + length(regexp_extract(t[b + 1081:b + 1201], '(?s)^(.*[.!?]){WS}', 1))
                WHEN length(regexp_extract(t[b + 1081:b + 1200], '(?s)^(.*{WS})', 1)) > 0 THEN b + 1080 + length(regexp_extract(t[b + 1081:b + 1200], '(?s)^(.*{WS})', 1)) ELSE b + 1200 END, ord + 1
        FROM (SELECT *, CASE WHEN e - 200 > s THEN e - 200 ELSE e END AS b FROM c WHERE e < len)
    ),
    x AS (SELECT doc_id || '#' || ord AS id, t[s + 1:e] AS text FROM c), {_hashed('x', 'v')},
    y AS (SELECT item_id AS id, text FROM benchmark), {_hashed('y', 'u')},
    q AS (SELECT id, idx, (v / sqrt(sum(v * v) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS v FROM u),
    p AS (SELECT q.id AS item_id, v.id AS chunk_id, round(sum(q.v * v.v), 9) AS score FROM q JOIN v USING (idx) GROUP BY ALL),
    k AS (SELECT item_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM p QUALIFY rank <= 6),
    b AS (SELECT item_id, {I.norm_match_sql('text')} AS needle FROM benchmark),
    f AS (
        SELECT k.item_id, arg_min(k.chunk_id, k.rank) AS chunk_id FROM k JOIN x ON x.id = k.chunk_id JOIN b ON b.item_id = k.item_id
        WHERE length(b.needle) >= 20 AND len(regexp_extract_all(b.needle, '[a-z]{{3,}}')) >= 3 AND contains({I.norm_match_sql('x.text')}, b.needle) GROUP BY k.item_id
    ), t AS (SELECT item_id, string_agg(chunk_id, ',' ORDER BY rank) AS retrieved FROM k GROUP BY item_id)
    SELECT b.item_id, CASE WHEN f.chunk_id IS NULL THEN 'none' ELSE 'full' END AS coverage, CASE WHEN f.chunk_id IS NULL THEN '{verify.DOWNGRADED}' END AS verifier_action, f.chunk_id AS chunk, t.retrieved
    FROM b LEFT JOIN f USING (item_id) LEFT JOIN t USING (item_id)
""")
def e2e_verdicts(spark, sf):
    """The same with the retrieved chunks, over the index of inverted lists."""
    made = _chunked(spark, sf)
    index = written(pruned.build(vectors.embed(made, "text").select("chunk_id", "vector"), "chunk_id"))
    items = table(spark, sf, "benchmark")
    asked = vectors.embed(items.select(F.col("item_id").alias("qid"), "text"), "text").select("qid", "vector")
    best = written(pruned.search(index, asked, 6, row_id="chunk_id").withColumnRenamed("qid", "item_id"))
    hits = best.join(made.select("chunk_id", F.col("doc_id").cast("string").alias("source_file"), "page", "text"), "chunk_id")
    claims = items.select("item_id", F.lit(0).alias("pos"), F.lit("").alias("source_file"), F.col("text").alias("quote"))
    claim = items.select("item_id", F.lit("full").alias("coverage"), F.lit(0.9).alias("confidence"), F.lit("claimed verbatim").alias("rationale"), F.lit(False).alias("needs_review"))
    judged = verify.downgrade(claim, verify.verify_quotes(claims, hits, "item_id", bounded=True), "item_id")
    retrieved = best.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]), ",").alias("retrieved"))
    return judged.join(retrieved, "item_id", "left").select("item_id", "coverage", "verifier_action", F.try_element_at("evidence", F.lit(1))["chunk_id"].alias("chunk"), "retrieved")


@query()
def j1_pruned_work(spark, sf):
    """Of each item, how many chunks there are and how many of their scores the pruned top-k made."""
    made = _chunked(spark, sf)
    index = written(pruned.build(vectors.embed(made, "text").select("chunk_id", "vector"), "chunk_id"))
    asked = vectors.embed(table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text"), "text").select("qid", "vector")
    return pruned.work(index, asked, 6, row_id="chunk_id")
