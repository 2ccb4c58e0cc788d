"""Verification, contract, retrieval, review and report semantics."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from corrobora import cli, config
from corrobora.functions.numbers import to_fixed
from corrobora.operators import assess, contract, ordering, report, review, vectors, verify
from corrobora.sources import catalogue, documents

HITS = "outcome_id string, rank int, chunk_id string, source_file string, page int, text string"
CLAIM = "outcome_id string, pos int, source_file string, quote string"
JUDGED = "outcome_id string, coverage string, confidence double, rationale string, needs_review boolean"


def checked(spark, coverage, quotes, hits):
    judged = spark.createDataFrame([("o", coverage, 0.82, "why", False)], JUDGED)
    claims = spark.createDataFrame([("o", k, f, q) for k, (f, q) in enumerate(quotes)], CLAIM)
    found = verify.verify_quotes(claims, spark.createDataFrame([("o", k, f"c{k}", f, p, t) for k, (f, p, t) in enumerate(hits)], HITS))
    return verify.downgrade(judged, found).first()


TEXT = "Backups are taken  every night and Restored quarterly for tests."


def test_fabricated_quote_is_downgraded(spark):
    r = checked(spark, "substantial", [("a", "A quote that appears nowhere in the text")], [("a", None, TEXT)])
    assert (r.coverage, r.confidence, r.needs_review, r.evidence, r.verifier_action) == ("none", 0.0, True, [], verify.DOWNGRADED)
    assert r.rationale.startswith(verify.PREFIX)


def test_case_and_spacing_do_not_matter(spark):
    r = checked(spark, "full", [("a", "backups are taken every NIGHT")], [("a", 3, TEXT)])
    assert (r.coverage, r.verifier_action, r.evidence[0].page, r.evidence[0].chunk_id) == ("full", None, 3, "c0")


def test_wrong_file_is_corrected(spark):
    r = checked(spark, "full", [("b", "taken every night and restored")], [("a", None, TEXT)])
    assert (r.evidence[0].source_file, r.evidence[0].attribution_corrected) == ("a", True)


def test_quotes_do_not_span_chunks_and_must_be_substantive(spark):
    assert checked(spark, "full", [("a", "first part of it ends here second part")], [("a", 1, "first part of it ends here"), ("a", 2, "second part")]).coverage == "none"
    assert checked(spark, "full", [("a", "the"), ("a", "."), ("a", "is")], [("a", 1, "the . is")]).verifier_action == verify.DOWNGRADED


def test_some_dropped_and_none_without_evidence(spark):
    r = checked(spark, "partial", [("a", "backups are taken every night"), ("a", "never said any of this at all")], [("a", None, TEXT)])
    assert (r.coverage, r.needs_review, r.verifier_action, r.quotes_checked, r.quotes_verified) == ("partial", True, "dropped_1_unverifiable_quote", 2, 1)
    r = checked(spark, "none", [("a", "backups are taken every night")], [("a", None, TEXT)])
    assert (r.coverage, r.evidence, r.verifier_action) == ("none", [], None)


def reply(spark, raw):
    return contract.validated(spark.createDataFrame([(raw,)], "raw string")).first()


def test_contract(spark):
    good = '{"subcategory_id":"S","coverage":"Partial","confidence":"0.8","evidence":[],"rationale":"r","needs_review":"true","more":1}'
    r = reply(spark, f"```json\n{good}\n```")
    assert r.ok and (r.value.coverage, r.value.confidence, r.value.needs_review) == ("partial", 0.8, True)
    assert reply(spark, f"Sure: {good} bye").ok
    r = reply(spark, good.replace('"0.8"', "5").replace("[]", '[{"source_file":"a"},3,{"source_file":" ","quote":"q"}]'))
    assert r.ok and r.value.confidence == 1.0 and r.value.evidence == []
    assert not reply(spark, good.replace("Partial", "maybe")).ok
    assert not reply(spark, good.replace('"rationale":"r",', "")).ok
    assert not reply(spark, good.replace('"0.8"', '"high"')).ok
    assert reply(spark, "no object here").errors == ["(root) must be object"]
    assert not reply(spark, None).ok


def test_top_k(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("d", None)], "id string, vector array<float>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0])], "qid int, vector array<float>")
    got = sorted((r.qid, r["rank"], r.id) for r in vectors.top_k(rows, asked, 2).collect())
    assert got == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 2, "b")]
    assert vectors.top_k(rows, asked, 0).count() == 0
    assert vectors.top_k(rows.limit(0), asked, 2).count() == 0


def test_query_blocks_give_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(40)], "id long, vector array<float>")
    asked = rows.withColumnRenamed("id", "qid")
    want = sorted(map(tuple, vectors.top_k(rows, asked, 3).collect()))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, vectors.top_k(rows, asked, 3).collect())) == want


def test_positions(spark):
    df = spark.createDataFrame([(k * 37 % 101,) for k in range(101)], "v long")
    got = sorted((r.pos, r.v) for r in ordering.with_position(df, "pos", df.v).collect())
    assert got == [(k, k) for k in range(101)]
    clash = spark.createDataFrame([(3, "a", 1), (1, "b", 2)], "v long, __p string, __k0 int")
    assert sorted((r.pos, r.v, r["__p"]) for r in ordering.with_position(clash, "pos", F.col("v")).collect()) == [(0, 1, "b"), (1, 3, "a")]
    assert ordering.with_position(df.limit(0), "pos", F.col("v")).count() == 0


def test_positions_of_many_files_are_whole(spark, tmp_path):
    rows = spark.range(500_000, numPartitions=7).select(F.xxhash64("id").alias("v"), F.repeat(F.lit("payload "), 3).alias("text"), F.col("id"))
    rows.write.parquet(str(tmp_path / "t"))
    placed = ordering.with_position(spark.read.parquet(str(tmp_path / "t")), "pos", F.col("v"))
    got = placed.agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.sum("id").alias("s")).first()
    assert (got.n, got.d, got.lo, got.hi, got.s) == (500_000, 500_000, 0, 499_999, 499_999 * 250_000)
    back = placed.join(placed.select((F.col("pos") - 1).alias("pos"), F.col("v").alias("next")), "pos").where("next < v").count()
    assert back == 0


def test_rounding_goes_by_the_exact_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    ratios = [(m / n, base + m / n * 0.2) for n in range(1, 41) for m in range(n + 1) for base in (0.45, 0.6)]
    got = spark.createDataFrame(ratios, "r double, x double").select("x", to_fixed(F.col("x"), 2).alias("y"), to_fixed(F.col("r"), 4).alias("z"), "r").collect()
    exact = lambda v, step: float(Decimal(v).quantize(Decimal(step), ROUND_HALF_UP))
    assert [(r.x, r.y) for r in got if r.y != exact(r.x, "0.01") or r.z != exact(r.r, "0.0001")] == []
    assert [r.y for r in spark.createDataFrame([(0.725,), (0.605,), (0.575,), (0.625,)], "x double").select(to_fixed(F.col("x")).alias("y")).collect()] == [0.72, 0.6, 0.57, 0.63]


def test_ties_do_not_depend_on_batches(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in ("B", "a", "C", "b", "A")], "id string, vector array<float>").repartition(3)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, vector array<float>")
    for k in range(1, 6):
        assert [r.id for r in vectors.top_k(rows, asked, k).orderBy("rank").collect()] == ["a", "A", "b", "B", "C"][:k]
    with pytest.raises(Exception, match="another embedder"):
        vectors.top_k(rows, spark.createDataFrame([(1, [1.0])], "qid int, vector array<float>"), 1).collect()


def test_fallback_for_outcomes_without_hits(spark):
    outcomes = spark.createDataFrame([("x", "backup restoration testing quarterly night"), ("y", "nothing")], "outcome_id string, outcome string")
    hits = spark.createDataFrame([("x", 1, "c", "f", None, "We review backup and restoration testing every quarterly night.")], HITS)
    got = {r.outcome_id: r for r in assess.assess(outcomes, hits).collect()}
    assert (got["y"].fallback, got["y"].coverage, got["y"].fallback_reason) == (True, "none", assess.NO_EVIDENCE)
    assert (got["x"].fallback, got["x"].coverage, got["x"].quotes_verified) == (False, "full", 1)


def test_review_and_queue(spark):
    rows = spark.createDataFrame([("a", "none", True, "h1"), ("b", "partial", False, "h2"), ("c", "full", False, "h3"), ("d", "none", False, "h4")], "outcome_id string, coverage string, needs_review boolean, hash string")
    decisions = spark.createDataFrame([("b", "override", "full", "h2"), ("c", "override", "none", "old")], "outcome_id string, decision string, final_coverage string, reviewed_against string")
    got = review.joined(rows, decisions)
    assert {r.outcome_id: (r.review_status, r.effective_coverage) for r in got.collect()} == {"a": ("unreviewed", "none"), "b": ("reviewed", "full"), "c": ("stale", "full"), "d": ("unreviewed", "none")}
    assert sorted(r.outcome_id for r in review.queue(got).collect()) == ["a", "c"]
    assert review.stats(got).first().remaining == 3


def test_given_decisions(spark):
    rows = spark.createDataFrame([("a", "none", "h1"), ("b", "partial", "h2")], "outcome_id string, coverage string, hash string")
    given = spark.createDataFrame([("a", "Override ", "full", "n"), ("b", "note", None, "why"), ("c", "accept", None, None), ("d", "skip", None, None)], "outcome_id string, decision string, final_coverage string, note string")
    got = {r.outcome_id: (r.decision, r.final_coverage, r.note, r.reviewed_against) for r in review.decide(rows, given).collect()}
    assert got == {"a": ("override", "full", "n", "h1"), "b": ("accept", "partial", "why", "h2"), "c": ("accept", "none", None, "cc98bcab3632")}
    for bad in (("a", "override", "best", None), ("a", "maybe", None, None), ("a", None, None, None)):
        with pytest.raises(Exception, match="no decision"):
            review.decide(rows, spark.createDataFrame([bad], given.schema)).collect()
    with pytest.raises(Exception, match="several decisions"):
        review.decide(rows, given.unionByName(given)).collect()


def test_strict_gate(spark):
    entries = spark.createDataFrame([(f"o{k:02}", "unreviewed") for k in range(12)], "outcome_id string, review_status string")
    with pytest.raises(report.UnresolvedError, match="12 unresolved: o00, .*o09…"):
        report.strict_gate(entries)
    report.strict_gate(entries.limit(0))


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def pdf(*pages):
    out = b"%PDF-1.4\n"
    for k, text in enumerate(pages):
        data = zlib.compress(f"BT ({text}) Tj ET".encode())
        out += f"{2 * k + 1} 0 obj << /Type /Page /Contents {2 * k + 2} 0 R >> endobj\n{2 * k + 2} 0 obj << /Filter /FlateDecode /Length {len(data)} >> stream\n".encode() + data + b"\nendstream endobj\n"
    return out


def test_pdf_structure():
    """Pages in tree order within an object stream, a font with a Unicode map, kerning, and no text but shown text."""
    packed = [b"<< /Type /Catalog /Pages 3 0 R >>", b"<< /Type /Pages /Kids [5 0 R 4 0 R] /Count 2 /Resources << /Font << /F1 6 0 R >> >> >>", b"<< /Type /Page /Parent 3 0 R /Contents [8 0 R] >>", b"<< /Type /Page /Parent 3 0 R /Contents 9 0 R >>", b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>"]
    numbers, at, head, body = [2, 3, 4, 5, 6], 0, "", b""
    for n, o in zip(numbers, packed, strict=True):
        head += f"{n} {len(body)} "
        body += o + b" "
    stream = lambda n, data, more="": f"{n} 0 obj << /Length {len(data)} {more}>> stream\n".encode() + data + b"\nendstream endobj\n"
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <00660069> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    first = b"BT /F1 12 Tf [<0001> -50 <0010> -300 <00110012>] TJ <0002> Tj ET"
    # What goes on where the last piece ended is one word.
    second = b"(not shown) pop BT (odd \\(hex\\)) Tj <484> Tj ET"
    whole = b"%PDF-1.5\n" + stream(1, zlib.compress(head.encode() + body), f"/Type /ObjStm /N 5 /First {len(head)} /Filter /FlateDecode ") + stream(7, cmap) + stream(8, second) + stream(9, first)
    assert documents.read_pdf(whole) == ([("Aa bcfi", 1), ("odd (hex)H@", 2)], [])
    with pytest.raises(ValueError, match="missing"):
        documents.read_pdf(whole.replace(b"9 0 obj", b"99 0 obj"))


def test_readers_and_report(spark):
    files = [("d/a.md", "﻿# T".encode()), ("d/b.DOCX", docx("Body")), ("d/c.pdf", pdf("One \\(x\\)", "", "Three")), ("d/d.pdf", b"no"), ("d/e.txt", b" \n"), ("d/f.csv", b"x")]
    parsed = documents.parse(spark.createDataFrame(files, "path string, content binary"))
    got = {r.file: r for r in parsed.collect()}
    assert got["a.md"].segments[0].text == "# T"
    assert got["b.DOCX"].segments[0].text.strip() == "Body"
    assert [(s.page, s.text) for s in got["c.pdf"].segments] == [(1, "One (x)"), (3, "Three")]
    assert {r.status: r.n for r in documents.report(parsed).collect()} == {"parsed": 3, "failed": 2, "skipped": 1}
    paths = spark.createDataFrame([(p,) for p in ("b/2.txt", "a/1.MD", ".git/3.txt", "x/.hid/4.txt", "node_modules/5.txt", "6.exe", ".txt")], "path string")
    assert [(r.pos, r.path) for r in documents.discover(paths).orderBy("pos").collect()] == [(0, "a/1.MD"), (1, "b/2.txt")]


CATALOGUE = '{"frameworkVersion":"1","sample":false,"functions":[{"id":"GV","name":"GOVERN"}],"subcategories":[{"function":"GOVERN","category":"C","id":"GV.A-1","outcome":"Backups are taken and restoration tested"},{"function":"X","category":"C","id":"QQ.B-2","outcome":"Absent zebra things happen"}]}'


def test_catalogue(spark, tmp_path):
    (tmp_path / "c.json").write_text(CATALOGUE)
    rows = {r.id: r for r in catalogue.load(spark, str(tmp_path / "c.json")).collect()}
    assert (rows["GV.A-1"].function_name, rows["GV.A-1"].category_id, rows["QQ.B-2"].function_name) == ("GOVERN", "GV.A", "QQ")
    (tmp_path / "d.json").write_text(CATALOGUE.replace("QQ.B-2", "GV.A-1"))
    with pytest.raises(catalogue.CatalogueError, match="duplicate"):
        catalogue.load(spark, str(tmp_path / "d.json"))
    (tmp_path / "e.json").write_text("{ not json")
    for name in ("e.json", "missing.json"):
        with pytest.raises(catalogue.CatalogueError):
            catalogue.load(spark, str(tmp_path / name))


def test_config():
    got, warnings = config.load(None, {"retrieval": {"topK": 999}, "chunk": {"size": 500, "overlap": 600}, "nonsense": 1})
    assert got["retrieval"]["topK"] == 6 and got["chunk"] == {"size": 500, "overlap": 499} and "nonsense" not in got
    assert len(warnings) == 3
    assert config.load(None, {"local": True, "llm": {"provider": "other"}})[0]["llm"]["provider"] == "lexical"


def test_all_stages(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("We review how backups are taken and restoration is tested. Every week.")
    (tmp_path / "c.json").write_text(CATALOGUE)
    made, _ = config.load(None, {"docsPath": str(tmp_path / "docs"), "cataloguePath": str(tmp_path / "c.json"), "workDir": str(tmp_path / "out"), "fixedNow": "2020-01-01T00:00:00Z", "acceptAll": True})
    run = cli.Run(spark, made)
    assert run.ingest() == {"parsed": 1}
    assert run.analyze() == {"assessed": 2, "reused": 0, "fallback": 0, "flagged": 1}
    assert run.analyze() == {"assessed": 0, "reused": 2, "fallback": 0, "flagged": 1}
    kept = run._read("assessments").where("outcome_id = 'GV.A-1'").first()
    assert [(h.chunk_id, h.source_file, round(h.score, 4) == h.score) for h in kept.retrieved] == [(kept.retrieved[0].chunk_id, "a.txt", True)] and kept.category == "C"
    (tmp_path / "d.csv").write_text("outcome_id,decision,final_coverage,note\nGV.A-1,override,full,seen\nQQ.B-2,skip,,\n")
    run.config["acceptAll"], run.config["decisionsPath"] = False, str(tmp_path / "d.csv")
    assert run.review() == {"reviewed": 0, "overridden": 1, "skipped": 1, "remaining": 1}
    run.config["acceptAll"], run.config["decisionsPath"] = True, None
    assert run.review()["reviewed"] >= 1
    assert run.report()["total"] == 2
    text = (tmp_path / "out" / "reports" / "gap-analysis.md").read_text()
    assert "GV.A-1" in text and "| GOVERN | 1 |" in text
    assert (tmp_path / "out" / "reports" / "evidence-map.csv").read_bytes().startswith("﻿subcategory_id,".encode())


def test_arrivals(spark, tmp_path):
    from corrobora.streaming.ingest import chunk_arrivals

    (tmp_path / "in").mkdir()
    for name in ("a.txt", "b.txt"):
        (tmp_path / "in" / name).write_text(f"text of {name}")
        chunk_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["text of a.txt", "text of b.txt"]
