"""Documents that tasks write together, against the same ones written by plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corrobora import sinks
from corrobora.operators import report

EVIDENCE = "array<struct<source_file:string,page:int,score:double,quote:string,verified:boolean>>"
ENTRY = f"outcome_id string, function string, category string, outcome string, coverage string, ai_coverage string, human_coverage string, confidence double, needs_review boolean, downgraded boolean, review_status string, rationale string, evidence {EVIDENCE}"


def made(seed, n):
    rng, out = random.Random(seed), []
    for k in range(n):
        level = rng.choice(["none", "partial", "substantial", "full"])
        quotes = [(f"f{j}.pdf", rng.choice([None, j + 1]), 0.25 * j, rng.choice(['plain "quoted" text', "=formula, with comma", "two\nlines", "ü" * 400]), rng.random() < 0.8) for j in range(rng.choice([0, 0, 1, 3]))]
        human = rng.choice([None, None, "full"])
        out.append((f"ID-{k:03d}", rng.choice(["DETECT", "GOVERN", "zeta", "Alpha"]), f"c{k % 3}", f"Outcome {k}", human or level, level, human, 0.5, True, rng.random() < 0.2, rng.choice(["reviewed", "unreviewed", "stale"]), rng.choice(["because", None, "-1 + 2"]), quotes))
    rng.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, ENTRY).repartition(3)


def plain_markdown(rows, most=300):
    rows = [dict(zip([c.split()[0] for c in ENTRY.split(", ")], r, strict=False)) for r in sorted(rows)]
    known = ["GOVERN", "IDENTIFY", "PROTECT", "DETECT", "RESPOND", "RECOVER"]
    order = sorted({r["function"] for r in rows}, key=lambda f: (known.index(f) if f in known else 99, f.lower()))
    levels = ["none", "partial", "substantial", "full"]
    n = lambda own, **kw: sum(all(r[k] == v for k, v in kw.items()) for r in own)
    gaps = [r for r in rows if r["coverage"] in levels[:2]]
    out = ["# Current profile and gap analysis", ""]
    if n(rows, review_status="unreviewed") or n(rows, review_status="stale"):
        out += [f"> **DRAFT.** {n(rows, review_status='unreviewed')} unreviewed and {n(rows, review_status='stale')} stale items remain.", ""]
    out += ["## Overview", "", f"- Outcomes: {len(rows)}, gaps: **{len(gaps)}**", "- Coverage: " + ", ".join(f"{x} {n(rows, coverage=x)}" for x in levels)]
    out += ["- Review: " + ", ".join(f"{x} {n(rows, review_status=x)}" for x in ("reviewed", "unreviewed", "stale")) + f", overrides {sum(r['human_coverage'] is not None for r in rows)}", f"- Downgraded by the verifier: {n(rows, downgraded=True)}", ""]
    out += ["## Coverage by function", "", "| Function | Total | None | Partial | Substantial | Full | % addressed |", "| --- | ---: | ---: | ---: | ---: | ---: | ---: |"]
    for f in order:
        own = [r for r in rows if r["function"] == f]
        out += [f"| {f} | {len(own)} | " + " | ".join(str(n(own, coverage=x)) for x in levels) + f" | {int(100 * sum(r['coverage'] in levels[2:] for r in own) / len(own) + 0.5)}% |"]
    for title, own, empty in (("Gaps and partial coverage", gaps, "_No gaps._"), ("Substantially or fully covered", [r for r in rows if r not in gaps], "_Nothing is covered yet._")):
        out += ["", f"## {title}", ""]
        for f in order:
            items = sorted((r for r in own if r["function"] == f), key=lambda r: (r["coverage"] == "partial", r["outcome_id"]))
            out += [f"### {f}", ""] if items else []
            for r in items:
                parts = [{"unreviewed": "⚠ UNREVIEWED", "stale": "⚠ STALE REVIEW"}.get(r["review_status"]), r["human_coverage"] and f"reviewer override: {r['ai_coverage']} → {r['human_coverage']}", r["downgraded"] and "verifier downgraded (unverifiable quote removed)"]
                badge = "; ".join(p for p in parts if p)
                out += [f"- **{r['outcome_id']}** — _{r['coverage']}_" + (f" _({badge})_" if badge else ""), f"  - Outcome: {r['outcome']}", f"  - Rationale: {r['rationale']}"]
                for file, page, _, quote, _ in r["evidence"]:
                    cut = quote if len(quote) <= most else quote[:most].rstrip() + "…"
                    out.append(f"  - Evidence ({file}{f', p.{page}' if page else ''}): \"{cut}\"")
        out += [] if own else [empty]
    return "\n".join([*out, ""])


def plain_csv(rows):
    def cell(v):
        v = "" if v is None else str(v)
        v = "'" + v if v[:1] in ("=", "+", "-", "@", "\t", "\r") else v
        return '"' + v.replace('"', '""') + '"' if any(c in v for c in '",\r\n') else v

    lines = [",".join(report.EVIDENCE_COLUMNS)]
    for r in sorted(rows):
        for q in r[12] or [None]:
            lines.append(",".join(map(cell, [r[0], r[1], r[2], r[4], r[7], r[10], *([q[0], q[1], q[2], q[3], "yes" if q[4] else "no"] if q else [""] * 5), r[11]])))
    return "﻿" + "".join(f"{x}\r\n" for x in lines)


@pytest.mark.parametrize(("seed", "n"), [(1, 60), (2, 1), (3, 0), (4, 7)])
def test_the_three_documents(spark, tmp_path, seed, n):
    rows = made(seed, n)
    entries = frame(spark, rows)
    out = tmp_path / "reports"
    sinks.write_document(report.markdown_lines(entries), str(out / "g.md"), *report.markdown_order())
    assert (out / "g.md").read_text(encoding="utf-8") == plain_markdown(rows)
    sinks.write_document(report.evidence_lines(entries), str(out / "e.csv"), F.col("section"), F.col("subcategory_id"), F.col("at"))
    assert (out / "e.csv").read_bytes().decode() == plain_csv(rows)
    sinks.write_document(report.profile_lines(entries, "now"), str(out / "p.json"), F.col("section"), F.col("at"))
    text = (out / "p.json").read_text(encoding="utf-8")
    got = json.loads(text)
    assert text == json.dumps(got, indent=2, ensure_ascii=False) + "\n"
    assert [r["outcome_id"] for r in got["subcategories"]] == sorted(r[0] for r in rows) and got["summary"]["total"] == n
    assert [[q["quote"] for q in r["evidence"]] for r in got["subcategories"]] == [[q[3] for q in r[12]] for r in sorted(rows)]
    # The parts are gone, and only the documents are left.
    assert sorted(p.name for p in out.iterdir() if not p.name.startswith(".")) == ["e.csv", "g.md", "p.json"]


def test_order_and_length(spark, tmp_path):
    path = tmp_path / "d" / "x.txt"
    lines = spark.range(20_000, numPartitions=7).select(((F.col("id") * 7919) % 20_011).alias("k"), F.concat(F.lit("zeile ü "), F.col("id").cast("string")).alias("text"))
    n = sinks.write_document(lines, str(path), F.col("k"))
    want = "".join(f"zeile ü {i}\n" for i in sorted(range(20_000), key=lambda i: i * 7919 % 20_011))
    assert path.read_text(encoding="utf-8") == want and n == len(want.encode())
    assert sinks.write_document(lines.limit(0), str(path), F.col("k")) == 0 and path.read_bytes() == b""
    assert sinks.write_document(spark.createDataFrame([(1, None), (2, "b")], "k int, text string"), str(path), F.col("k")) == 3 and path.read_bytes() == b"\nb\n"


def test_stores_that_are_not_mounted(spark, tmp_path):
    """The parts joined through the store's own streams, which a local one stands for here."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(str(tmp_path)).getFileSystem(spark._jsc.hadoopConfiguration())
    for k in range(3):
        (tmp_path / f"part-{k}").write_bytes(b"%d\n" % k * 1000)
    made = jvm.org.apache.hadoop.fs.Path(str(tmp_path / "whole"))
    fs.create(made, True).close()
    sinks._join(spark, fs, made, [str(tmp_path / f"part-{k}") for k in range(3)])
    assert (tmp_path / "whole").read_bytes() == b"".join(b"%d\n" % k * 1000 for k in range(3))


def test_totals_are_one_pass(spark):
    rows = made(5, 80)
    entries = frame(spark, rows)
    got = {(r.level, r.function, r.category): r for r in report.totals(entries).collect()}
    assert got[0, None, None].total == 80 and {k[1]: r.total for k, r in got.items() if k[0] == 1} == {f: sum(r[1] == f for r in rows) for f in {r[1] for r in rows}}
    assert {k[1:]: r.gaps for k, r in got.items() if k[0] == 2} == {(f, c): sum((r[1], r[2]) == (f, c) and r[4] in ("none", "partial") for r in rows) for f, c in {(r[1], r[2]) for r in rows}}
    assert report.summary(entries).first().asDict() == {c: got[0, None, None][c] for c in report.SUMMARY}
    assert {r.function: r.pct for r in report.by_function(entries).collect()} == {k[1]: r.pct for k, r in got.items() if k[0] == 1}
    plan = report.totals(entries)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
