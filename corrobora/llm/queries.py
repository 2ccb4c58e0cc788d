"""The registered query of each operator: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.llm import secrets
from corrobora.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corrobora.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corrobora.llm.katz import katz_scores

    return katz_scores(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corrobora.llm.byte_bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corrobora.llm.line_dedup import line_verdicts

    return line_verdicts(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corrobora.llm.token_files import token_file_digests

    return token_file_digests(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corrobora.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corrobora.llm.secrets import digests

    return digests(table(spark, sf_dir, "documents"))


def op8_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corrobora.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corrobora.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corrobora.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corrobora.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corrobora.llm.hard_negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corrobora.llm.url_filter import RULES, judge_urls

    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")], RULES)
    return judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_katz_backoff, op3_byte_bpe, op4_line_dedup, op5_token_files, op6_ngram_jaccard, op7_secret_scan, op8_quality_cnn, op9_html_text, op10_decontaminate, op11_importance, op12_hard_negatives, op13_url_filter)}

ORACLES = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op2_katz_backoff": r"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id,
                   xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                       lambda h, c: list_reduce(range(8), lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END), xor(h, c)), 4294967295::BIGINT), 4294967295) % 5 = 1 AS held_out,
                   list_append(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' end') AS w
            FROM documents
        ), t AS (
            SELECT rid, held_out, unnest(w) AS w, unnest(list_prepend(' start', w[:-2])) AS h, unnest(list_concat([' start', ' start'], w[:-3])[:len(w)]) AS g FROM d
        ), c AS (SELECT w, count(*) AS r FROM t WHERE NOT held_out GROUP BY w),
        p AS (SELECT h, w, count(*) AS r FROM t WHERE NOT held_out GROUP BY h, w),
        q AS (SELECT g, h, w, count(*) AS r FROM t WHERE NOT held_out GROUP BY g, h, w),
        n AS (
            SELECT k, list_transform(range(1, 7), lambda i: len(list_filter(x, lambda y: y = i))::DOUBLE) AS n
            FROM (SELECT 1 AS k, list(r) AS x FROM c UNION ALL SELECT 2, list(r) FROM p UNION ALL SELECT 3, list(r) FROM q)
        ), m AS (
            SELECT k, n, 6 * n[6] / n[1] AS m, list_transform(range(1, 6), lambda i: (i + 1) * n[i + 1] / n[i] / i) AS raw FROM n
        ), d0 AS (
            SELECT k, CASE WHEN list_min(n[1:5]) > 0 AND m < 1 AND list_min(list_transform(raw, lambda x: (x - m) / (1 - m))) > 0 AND list_max(list_transform(raw, lambda x: (x - m) / (1 - m))) < 1
                           THEN list_transform(raw, lambda x: (x - m) / (1 - m)) ELSE list_transform(range(1, 6), lambda i: (i - 0.5::DOUBLE) / i) END AS d FROM m
        ), s AS (SELECT sum(r) AS big_n, count(*) AS big_v, sum(CASE WHEN r <= 5 THEN d[r] * r ELSE r - 0.1::DOUBLE END) AS kept FROM c, d0 WHERE k = 1),
        u AS (SELECT w, r, CASE WHEN r <= 5 THEN d[r] * r ELSE r - 0.1::DOUBLE END / big_n AS p FROM c, d0, s WHERE k = 1),
        p1 AS (SELECT h, w, r, CASE WHEN r <= 5 THEN d[r] * r ELSE r - 0.1::DOUBLE END AS kept, sum(r) OVER (PARTITION BY h) AS total FROM p, d0 WHERE k = 2),
        q1 AS (SELECT g, h, w, r, CASE WHEN r <= 5 THEN d[r] * r ELSE r - 0.1::DOUBLE END AS kept, sum(r) OVER (PARTITION BY g, h) AS total FROM q, d0 WHERE k = 3),
        a2 AS (SELECT h, (sum(p1.r - p1.kept) / sum(p1.r)) / (1 - sum(u.p)) AS alpha FROM p1 JOIN u USING (w) GROUP BY h),
        a3 AS (SELECT q1.g, q1.h, (sum(q1.r - q1.kept) / sum(q1.r)) / (1 - sum(p1.kept / p1.total)) AS alpha FROM q1 JOIN p1 ON p1.h = q1.h AND p1.w = q1.w GROUP BY q1.g, q1.h),
        l AS (
            SELECT t.rid, u.r AS c, log10((coalesce(u.r, 0) + 0.5::DOUBLE) / (s.big_n + 0.5::DOUBLE * (s.big_v + 1))) AS base,
                   CASE WHEN q1.r IS NOT NULL THEN log10(q1.kept / q1.total) WHEN p1.r IS NOT NULL THEN log10(coalesce(a3.alpha, 1) * p1.kept / p1.total)
                        ELSE log10(coalesce(a3.alpha, 1) * coalesce(a2.alpha, 1) * coalesce(u.p, (s.big_n - s.kept) / s.big_n)) END AS score
            FROM t CROSS JOIN s LEFT JOIN u ON u.w = t.w LEFT JOIN p1 ON p1.h = t.h AND p1.w = t.w LEFT JOIN a2 ON a2.h = t.h
                 LEFT JOIN q1 ON q1.g = t.g AND q1.h = t.h AND q1.w = t.w LEFT JOIN a3 ON a3.g = t.g AND a3.h = t.h
        )
        SELECT d.doc_id, d.held_out, count(*) AS n_tokens, count(l.c) AS n_known, (SELECT big_n FROM s)::BIGINT AS train_tokens, round(fsum(l.base), 6) AS base_score, round(fsum(l.score), 6) AS score
        FROM d JOIN l USING (rid) GROUP BY d.rid, d.doc_id, d.held_out
    """,
    "op6_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
            FROM w
        ), e AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
        ), p AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
            GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
        ), l AS (
            SELECT x, y FROM p UNION ALL SELECT y, x FROM p
        ), r(x, y) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y
        )
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, (SELECT min(r.y) FROM r WHERE r.x = s.doc_id) AS component_id FROM s
    """,
    "op4_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no
            FROM documents
        ), w AS (
            SELECT doc_id, line_no, list_filter(string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM l
        ), d AS (
            SELECT w, min({'doc_id': doc_id, 'line_no': line_no}) AS first FROM w WHERE len(w) > 0 GROUP BY w
        ), v AS (
            SELECT first, w AS rest, -1 AS p FROM d WHERE len(w) >= 8
            UNION ALL
            SELECT first, list_concat(w[:i - 1], w[i + 1:]) AS rest, i AS p
            FROM (SELECT first, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) >= 8)
        ), n AS (
            SELECT x.first AS x, min(y.first) AS y FROM v x JOIN v y ON x.rest = y.rest AND (x.p = y.p OR x.p = -1 OR y.p = -1)
            WHERE y.first < x.first GROUP BY x.first
        ), k AS (
            SELECT d.w, CASE WHEN n.y < d.first THEN n.y ELSE d.first END AS keep FROM d LEFT JOIN n ON n.x = d.first
        )
        SELECT w.doc_id, w.line_no::BIGINT AS line_no, len(w.w)::BIGINT AS n_words,
               coalesce(k.keep.doc_id, w.doc_id) AS keep_doc, coalesce(k.keep.line_no, w.line_no)::BIGINT AS keep_line,
               k.keep IS NULL OR (k.keep.doc_id = w.doc_id AND k.keep.line_no = w.line_no) AS kept
        FROM w LEFT JOIN k ON k.w = w.w AND len(w.w) > 0
    """,
    "op7_secret_scan": secrets.oracle(),
    "op11_importance": r"""
        WITH x AS (
            SELECT row_number() OVER () AS rid, doc_id, true AS corpus, coalesce(text, '') AS text FROM documents
            UNION ALL SELECT NULL, NULL, false, coalesce(text, '') FROM benchmark
        ), w AS (
            SELECT rid, doc_id, corpus, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda t: t <> '') AS w FROM x
        ), t AS (
            SELECT rid, corpus, unnest(w) AS word FROM w
        ), v AS (
            SELECT word, hex(encode(word)) AS hx FROM (SELECT DISTINCT word FROM t)
        ), b AS (
            SELECT word, list_transform(range(0, length(hx) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', substr(hx, 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(hx, 2 * i + 2, 1)) - 1) AS c FROM v
        ), k AS (
            SELECT word, xor(list_reduce(c, lambda h, y: list_reduce(range(8), lambda a, z: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END), xor(h, y)), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM b
        ), n AS (
            SELECT bucket, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t FROM t JOIN k USING (word) GROUP BY bucket
        ), g AS (
            SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM n
        ), d AS (
            SELECT t.rid, sum(gain)::BIGINT AS total, count(*) AS n FROM t JOIN k USING (word) JOIN g USING (bucket) WHERE corpus GROUP BY t.rid
        ), s AS (
            SELECT w.rid, w.doc_id, coalesce(d.n, 0)::BIGINT AS n_features, coalesce((d.total - ((d.total % d.n) + d.n) % d.n) // d.n, 0)::BIGINT AS weight,
                   list_reduce(list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substr(sha256('2024:' || coalesce(w.doc_id::VARCHAR, '')), i, 1)) - 1), lambda a, c: 16 * a + c)::DOUBLE AS h
            FROM w LEFT JOIN d USING (rid) WHERE corpus
        ), f AS (
            SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, n_features >= 20 AS may FROM s
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) FILTER (may) OVER () AS many FROM f
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 10 * many // 100 THEN place END AS rank FROM r
    """,
    "op12_hard_negatives": r"""
        WITH r AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s
            FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), p AS (
            SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5
        )
        SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER w)::INT AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
        FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND 100 * n.s <= 100 * p.s
        WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) QUALIFY row_number() OVER w <= 5
    """,
    "op13_url_filter": r"""
        WITH rules(host, path, verdict, depth) AS (
            VALUES ('net', '/', 'block', 1), ('example.net', '/en/', 'allow', 2), ('example.com', '/de/', 'block', 2), ('org', '/fr/', 'allow', 1)
        ), u AS (
            SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url FROM pages
        ), p AS (
            SELECT rid, page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM u
        ), f AS (
            SELECT p.rid, max_by({'rule': r.host || r.path, 'verdict': r.verdict}, 100000 * r.depth + length(r.path)) AS best
            FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.rid
        )
        SELECT p.page_id, p.host, p.path, f.best.rule AS rule, coalesce(f.best.verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (rid)
    """,
}
