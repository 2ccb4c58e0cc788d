"""Content hashes: short SHA-256 over canonical JSON, and the 32-bit FNV-1a of short ASCII strings."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(json_text: Column) -> Column:
    """The first twelve hex digits of SHA-256 over canonical JSON text."""
    return F.substring(F.sha2(json_text, 256), 1, 12)


def json_string(c: Column) -> Column:
    """A JSON string literal, or null as ``null``; non-ASCII text is kept and control characters are lower-case \\u escapes."""
    wrapped = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(wrapped, 6, F.length(wrapped) - 6)


def canonical(value: Column) -> Column:
    """JSON without spaces; the caller declares struct fields in key order. Nulls are written."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def assessment_hash(coverage: Column, evidence: Column) -> Column:
    """The staleness hash: coverage and each (source_file, quote) in order, nothing else."""
    items = F.transform(evidence, lambda e: F.struct(e["quote"].alias("quote"), e["source_file"].alias("source_file")))
    items = F.coalesce(items, F.array().cast("array<struct<quote:string,source_file:string>>"))
    return short_hash(canonical(F.struct(coverage.alias("coverage"), items.alias("evidence"))))


def engine_signature(embedding_model: str, llm_model: str, top_k: int, chunk_size: int, chunk_overlap: int, critique: bool, index_id: str) -> str:
    """What a cached assessment depends on, as a short hash; computed once per run on the driver."""
    fields = {"embeddingModel": embedding_model, "llmModel": llm_model, "topK": top_k, "chunkSize": chunk_size, "chunkOverlap": chunk_overlap, "critique": critique, "indexId": index_id}
    return hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:12]


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the characters of an ASCII string."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: F.length(x) > 0), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def fnv1a_of(word: str) -> int:
    h = 2166136261
    for x in word.encode():
        h = (h ^ x) * 16777619 & 0xFFFFFFFF
    return h
