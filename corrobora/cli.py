"""Command line: ingest documents, analyze them against a catalogue, review, report, or run all of it.

Each stage reads and writes keyed tables with versions in the working folder, so a stage can be repeated by itself, and
one that breaks off leaves the last version of each table as it was.
"""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora import __version__
from corrobora import config as settings
from corrobora.functions import hashing as H
from corrobora.operators import assess, chunks, remote, report, review, vectors
from corrobora.operators.ordering import with_position
from corrobora.session import session
from corrobora.sinks import write_document
from corrobora.sources import catalogue, documents, manifest, workbook
from corrobora.store import Store
from corrobora.tables import written

#: Characters of a segment that one task cuts.
LONG = 4 << 20
#: The working folder's tables: their keys, and their numbers of buckets.
KEYED = {"manifest": (["path"], 16), "chunks": (["path"], 64), "index": (["index_id"], 1), "assessments": (["outcome_id"], 16), "decisions": (["outcome_id"], 16), "profile": (["outcome_id"], 16)}
DECISIONS = "outcome_id string, decision string, final_coverage string, note string, reviewed_by string, reviewed_at string, reviewed_against string"


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """(outcome_id, decision, final_coverage, note) of a reviewers' file: CSV with a header, JSON or Parquet."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    elif kind in ("json", "jsonl"):
        rows = spark.read.option("multiLine", kind == "json").json(path)
    else:
        rows = spark.read.parquet(path)
    if missing := {"outcome_id", "decision"} - set(rows.columns):
        raise ValueError(f"{path}: no column {', '.join(sorted(missing))}")
    return rows.select("outcome_id", *(F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("decision", "final_coverage", "note")))


class Run:
    """One working folder with its settings."""

    def __init__(self, spark: SparkSession, config: dict):
        self.spark, self.config, self.at = spark, config, config["workDir"].rstrip("/")
        self.now = config["fixedNow"] or datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")

    def _store(self, name: str) -> Store:
        return Store(self.spark, f"{self.at}/{name}", *KEYED[name])

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        """All of a table anew, as its next version."""
        self._store(name).replace(df)
        return self._read(name)

    def _has(self, name: str) -> bool:
        return self._store(name).exists()

    def _read(self, name: str) -> DataFrame:
        if not self._has(name):
            raise FileNotFoundError(f"{name} is missing in {self.at}: run the stage that makes it first")
        return self._store(name).read()

    def _upsert(self, df: DataFrame, name: str) -> DataFrame:
        """Rows in place of those of the same key; only their buckets are written anew."""
        self._store(name).upsert(df)
        return self._read(name)

    def _embedder(self) -> tuple[str, str | Callable]:
        """The embedder's identity, which the index keeps, and the embedder."""
        c = self.config["embeddings"]
        model = remote.model_of("embeddings", c)
        return model if model == c["provider"] else f"{c['provider']}:{model}", remote.embedder_of(c, f"{self.at}/answers")

    def ingest(self) -> dict:
        """Reads the files that are new or changed since the last time, and forgets those that are gone.

        A document's chunks are replaced together. Other settings than the last time's, or ``force``, read all anew. What
        the index then is does not depend on how it came about.
        """
        c = self.config
        identity, embedder = self._embedder()
        made_with = {"embedder": identity, "size": c["chunk"]["size"], "overlap": c["chunk"]["overlap"]}
        anew = c["force"] or not self._has("index") or any(getattr(self._read("index").first(), k) != v for k, v in made_with.items())
        found = manifest.files(self.spark, c["docsPath"])
        known = self.spark.createDataFrame([], manifest.MANIFEST) if anew or not self._has("manifest") else self._read("manifest")
        changes = written(manifest.diff(found, known, c["trustTimes"]))
        todo = changes.where(F.col("change").isin(manifest.NEW, manifest.CHANGED))
        parsed = written(documents.parse(found.join(todo.select("path"), "path", "left_semi")))
        files = with_position(parsed.where("status = 'parsed'"), "doc_id", F.col("path"))
        segments = files.select("doc_id", F.posexplode("segments").alias("seg", "s")).select("doc_id", "seg", "s.page", "s.text")
        # Very long segments are cut by many tasks; that takes jobs of its own, so only where there are some.
        long = None if segments.where(F.length("text") > LONG).isEmpty() else LONG
        made = chunks.chunk(segments, c["chunk"]["size"], c["chunk"]["overlap"], long).join(files.select("doc_id", "path", F.col("file").alias("source_file")), "doc_id").drop("doc_id")
        made = made.withColumn("id", chunks.chunk_id(F.col("path"), F.col("source_file"), F.col("page"), F.col("ord")))
        made = written(vectors.embed(made, "text", embedder, batch=c["embeddings"]["batchSize"]))
        stored, entries = self._store("chunks"), manifest.entries(todo, parsed)
        if anew:
            stored.replace(made)
            self._store("manifest").replace(entries)
        else:
            # A changed file that gives no chunk any more loses those it had; files are told last, so that a run that
            # breaks off between the tables is taken up again.
            stored.delete(changes.where(F.col("change").isin(manifest.GONE, manifest.CHANGED)).join(made.select("path").distinct(), "path", "left_anti").select("path"))
            stored.upsert(made)
            self._store("manifest").upsert(entries.unionByName(manifest.tombstones(changes, known, self.now)))
        if stored.read().isEmpty():
            raise ValueError("no document gave any text")
        placed = self._chunks()
        index = chunks.index_id(placed, identity, c["chunk"]["size"], c["chunk"]["overlap"])
        dim = F.lit(placed.select(F.size("vector").alias("n")).first().n)
        self._write(index.withColumns({**{k: F.lit(v) for k, v in made_with.items()}, "dim": dim, "created_at": F.lit(self.now)}), "index")
        counts = {r.status: r.n for r in documents.report(self._read("manifest").where("gone_at IS NULL")).collect()}
        kinds = {r.change: r["count"] for r in changes.groupBy("change").count().collect()}
        return counts | ({} if anew else {k: kinds.get(k, 0) for k in (manifest.NEW, manifest.CHANGED, manifest.GONE, manifest.SAME)})

    def _chunks(self) -> DataFrame:
        """The index's chunks with their places: files by name, then path, in the locale's order, and their chunks in turn."""
        return with_position(self._read("chunks"), "pos", F.collate("source_file", "UNICODE"), F.collate("path", "UNICODE"), F.col("path"), F.col("ord"))

    def analyze(self) -> dict:
        """Judges what is not judged yet under these settings; returns how many, how many were there, and the flagged."""
        c = self.config
        index = self._read("index").first()
        identity, embedder = self._embedder()
        if index.embedder != identity:
            raise ValueError(f"the index was made with {index.embedder}, the settings name {identity}")
        judge, warnings = remote.judge_of(c["llm"], f"{self.at}/answers")
        for w in warnings:
            print(f"warning: {w}")
        sig = H.engine_signature(remote.model_of("embeddings", c["embeddings"]), remote.model_of("llm", c["llm"]), c["retrieval"]["topK"], c["chunk"]["size"], c["chunk"]["overlap"], c["analysis"]["critique"], index.index_id)
        outcomes = catalogue.load(self.spark, c["cataloguePath"]).withColumnRenamed("id", "outcome_id")
        stored = self._read("assessments") if self._has("assessments") else None
        todo = assess.unfinished(outcomes, stored, sig, force=c["force"]) if stored is not None else outcomes
        rows = self._read("chunks")
        asked = written(vectors.embed(todo.select(F.col("outcome_id").alias("qid"), F.col("outcome").alias("text")), "text", embedder, batch=c["embeddings"]["batchSize"]).select("qid", "vector"))
        if asked.where(F.size("vector") != index.dim).count():
            raise ValueError(f"outcomes have other vectors than the index, which has {index.dim} dimensions")
        best = written(vectors.top_k(rows.select("id", "vector"), asked, c["retrieval"]["topK"], row_id="id").withColumnRenamed("qid", "outcome_id"))
        hits = best.withColumnRenamed("id", "chunk_id").join(rows.select(F.col("id").alias("chunk_id"), "source_file", "page", "text"), "chunk_id")
        new = assess.assess(todo.select("outcome_id", "outcome"), hits, judge, c["analysis"]["confidenceThreshold"], c["analysis"]["critique"])
        new = assess.enriched(new, outcomes, hits).withColumns({"engine_sig": F.lit(sig), "assessed_at": F.lit(self.now), "hash": H.assessment_hash(F.col("coverage"), F.coalesce("evidence", F.array().cast(new.schema["evidence"].dataType)))})
        new = written(new)
        # An outcome whose request failed was not judged: it stays to be asked again, the others are kept.
        unanswered = F.coalesce(F.col("fallback_reason").startswith(remote.UNANSWERED), F.lit(False))
        done = new.where(~unanswered)
        kept = self._upsert(done, "assessments")
        failed = new.where(unanswered)
        if n := failed.count():
            raise remote.ServiceError(f"{n} of {new.count()} outcomes were not judged: {failed.first().fallback_reason}")
        total = outcomes.count()
        made = done.count()
        return {"assessed": made, "reused": total - made, "fallback": done.where("fallback").count(), "flagged": assess.flagged(kept).first().flagged}

    def review(self) -> dict:
        """Takes decisions from a file, or accepts the queue; decisions made elsewhere are rows of the same table."""
        c = self.config
        decided = self._read("decisions") if self._has("decisions") else self.spark.createDataFrame([], DECISIONS)
        assessed = self._read("assessments")
        rows, skipped = review.joined(assessed, decided), 0
        if c["decisionsPath"]:
            given = decisions(self.spark, c["decisionsPath"])
            skipped = given.where("lower(trim(decision)) = 'skip'").count()
            decided = self._upsert(review.decide(rows, given, c["identity"], self.now), "decisions")
            rows = review.joined(assessed, decided)
        if c["acceptAll"]:
            new = review.accept_all(rows, c["identity"], self.now, c["review"]["showAll"])
            decided = self._upsert(new, "decisions")
            rows = review.joined(assessed, decided)
        return review.stats(rows).first().asDict() | {"skipped": skipped}

    def report(self) -> dict:
        """Profile JSON, gaps-first Markdown and the evidence map, all from one profile."""
        outcomes = catalogue.load(self.spark, self.config["cataloguePath"]).withColumnRenamed("id", "outcome_id").withColumn("function", F.col("function_name"))
        decided = self._read("decisions") if self._has("decisions") else self.spark.createDataFrame([], DECISIONS)
        entries = self._write(report.profile(outcomes, self._read("assessments"), decided), "profile")
        if self.config["analysis"]["strict"]:
            report.strict_gate(entries)
        out = f"{self.at}/reports"
        write_document(report.profile_lines(entries, self.now), f"{out}/profile.json", F.col("section"), F.col("at"))
        write_document(report.markdown_lines(entries, most=self.config["report"]["evidenceQuoteMaxChars"]), f"{out}/gap-analysis.md", *report.markdown_order())
        write_document(report.evidence_lines(entries), f"{out}/evidence-map.csv", F.col("section"), F.col("subcategory_id"), F.col("at"))
        return report.summary(entries).first().asDict()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corrobora", description=__doc__)
    parser.add_argument("command", choices=["init", "catalogue", "ingest", "analyze", "review", "report", "all", "run"])
    parser.add_argument("--config", default="corrobora.config.json")
    parser.add_argument("--out", "--work-dir")
    parser.add_argument("--now", "--fixed-now")
    for flag in ("docs", "catalogue", "embed-provider", "embed-model", "llm-provider", "llm-model", "identity", "decisions", "env", "log-level"):
        parser.add_argument(f"--{flag}")
    for flag in ("top-k", "chunk-size", "chunk-overlap", "batch-size", "max-tokens", "senders", "quote-chars"):
        parser.add_argument(f"--{flag}", type=int)
    for flag in ("threshold", "temperature", "per-minute"):
        parser.add_argument(f"--{flag}", type=float)
    parser.add_argument("--critique", action=argparse.BooleanOptionalAction)
    parser.add_argument("--show-all", "--all", action="store_true", default=None)
    parser.add_argument("--workbook", help="the spreadsheet of which the command catalogue makes the catalogue file")
    parser.add_argument("--rehash", dest="trust_times", action="store_false", default=None, help="open all files, whatever their times say")
    for flag in ("strict", "accept-all", "force", "local"):
        parser.add_argument(f"--{flag}", action="store_true", default=None)
    for flag, level in (("verbose", "debug"), ("quiet", "quiet")):
        parser.add_argument(f"--{flag}", action="store_const", const=level, dest="log_level")
    parser.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    a = parser.parse_args(args)
    if a.command == "init":
        if not Path(a.config).exists():
            Path(a.config).write_text(json.dumps(settings.DEFAULTS, indent=2) + "\n")
        return
    flags = {
        "docsPath": a.docs, "cataloguePath": a.catalogue, "workDir": a.out, "identity": a.identity, "fixedNow": a.now, "acceptAll": a.accept_all, "force": a.force, "trustTimes": a.trust_times, "local": a.local, "decisionsPath": a.decisions, "envPath": a.env, "logLevel": a.log_level,
        "chunk": {"size": a.chunk_size, "overlap": a.chunk_overlap}, "embeddings": {"provider": a.embed_provider, "model": a.embed_model, "batchSize": a.batch_size},
        "llm": {"provider": a.llm_provider, "model": a.llm_model, "temperature": a.temperature, "maxTokens": a.max_tokens, "senders": a.senders, "perMinute": a.per_minute}, "report": {"evidenceQuoteMaxChars": a.quote_chars},
        "retrieval": {"topK": a.top_k}, "analysis": {"confidenceThreshold": a.threshold, "critique": a.critique, "strict": a.strict}, "review": {"showAll": a.show_all},
    }
    config, warnings = settings.load(a.config, flags)
    settings.load_env(config["envPath"], os.environ)
    quiet = config["logLevel"] in ("error", "quiet")
    for w in warnings if not quiet else []:
        print(f"warning: {w}")
    if a.command == "catalogue":
        print("catalogue", workbook.build(session(), a.workbook, config["cataloguePath"]))
        return
    run = Run(session(), config)
    for stage in ["ingest", "analyze", "review", "report"] if a.command in ("all", "run") else [a.command]:
        done = getattr(run, stage)()
        if not quiet and config["logLevel"] != "warn":
            print(stage, done)


if __name__ == "__main__":
    main()
