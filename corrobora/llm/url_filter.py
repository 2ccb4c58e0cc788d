"""Allow and block lists for URLs: a trie over reversed host labels and path segments, longest match wins.

An entry (host, path) fits its host and all subdomains where the URL's path starts with the entry's. Among the
entries that fit, the one with the most host labels wins, then the one with the longest path; of an entry that is
both allowed and blocked, the block counts. A URL that no entry fits gets the default verdict.

Entries of at most TRIE_BYTES are made into a trie that every task gets by broadcast and walks once a URL, down the
host's labels from the last and then down the path's segments. A larger table of entries stays distributed and is met
by equi-joins on host suffixes and path prefixes (``judge_by_join``); both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.llm.common import many_to_one
from corrobora.tables import fresh, written

#: Entries of more bytes of hosts and paths than this are joined, not broadcast.
TRIE_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = "host string, path string, verdict string"


@dataclass(slots=True)
class Node:
    """What may follow: whole labels or segments, path tries of a host, and what a last segment may start with."""

    below: dict[str, Node] = field(default_factory=dict)
    paths: Node | None = None
    #: By length, longest first: the begun segments that end an entry here, each with the entry and its verdict.
    begun: dict[int, dict[str, tuple[str, str]]] = field(default_factory=dict)


def build(rules: Iterable[tuple[str, str, str]]) -> Node:
    """The trie of (host, path, verdict) entries; of one entry with both verdicts, ``block`` stays."""
    top = Node()
    for host, path, verdict in rules:
        node = top
        for label in reversed(host.split(".")) if host else ():
            node = node.below.setdefault(label, Node())
        node.paths = at = node.paths or Node()
        *whole, last = path.split("/")
        for segment in whole:
            at = at.below.setdefault(segment, Node())
        ends = at.begun.setdefault(len(last), {})
        if ends.get(last, ("", ""))[1] != "block":
            ends[last] = (host + path, verdict)
        at.begun = dict(sorted(at.begun.items(), reverse=True))
    return top


def longest_path(top: Node, path: str) -> tuple[str, str] | None:
    """The entry whose path is the longest one that ``path`` starts with."""
    node, found, at = top, None, 0
    while True:
        end = path.find("/", at)
        segment = path[at:] if end < 0 else path[at:end]
        for n, ends in node.begun.items():
            if n <= len(segment) and (hit := ends.get(segment[:n])):
                found = hit
                break
        if end < 0 or (node := node.below.get(segment)) is None:
            return found
        at = end + 1


def longest(top: Node, host: str, path: str) -> tuple[str, str] | None:
    """The winning entry: the deepest host that has one for this path."""
    node = top
    found = longest_path(node.paths, path) if node.paths else None
    end = len(host)
    while end >= 0 and host:
        start = host.rfind(".", 0, end) + 1
        node = node.below.get(host[start:end])
        if node is None:
            break
        found = (node.paths and longest_path(node.paths, path)) or found
        end = start - 1
    return found


def host_of(url: Column) -> Column:
    """What is between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z lowered; else empty."""
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _clean(rules: DataFrame) -> DataFrame:
    """Entries with a verdict, nulls as empty, hosts lowered as in URLs, each (host, path) once; block comes first."""
    kept = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where(F.col("verdict").isin("allow", "block"))
    return kept.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``pages`` with host, path, rule (host and path of the winning entry, null if none) and verdict.

    Every row is judged by itself, so repeated rows stay; columns of ``pages`` with these names are replaced. A null
    URL or one without ``://`` has an empty host and path, which only an entry with an empty host can fit. Entries
    without a verdict of ``allow`` or ``block`` count for nothing; none at all give the default everywhere.
    """
    entries = written(_clean(rules))
    size = entries.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 16)).first()[0] or 0
    if size > trie_bytes:
        return judge_by_join(pages, entries, url, default)
    held = pages.sparkSession.sparkContext.broadcast([tuple(r) for r in entries.collect()])

    @F.pandas_udf("rule string, verdict string")
    def walk(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        top = build(held.value)
        for hosts, paths in parts:
            found = [longest(top, h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    w, *_ = fresh([*pages.columns, "host", "path", "rule", "verdict"], "__walk")
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    made = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    return made.withColumn(w, walk("host", "path")).select(*kept, "host", "path", f"{w}.rule", f"{w}.verdict")


def judge_by_join(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``judge_urls`` for any number of entries, by joins.

    A host's suffixes meet the hosts of entries, each with the distinct lengths of its entries' paths, and the prefixes
    of those lengths meet the entries. Both joins are with a side in which every key stands once, so that a key that
    a third of all URLs have gets its row by broadcast. Distinct (host, path) pairs are looked up, and joined back.
    """
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    entries = written(_clean(rules))
    made = written(pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")))
    asked = made.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.when(F.col("host") == "", F.array(F.struct(F.lit("").alias("suffix"), F.lit(0).alias("depth")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(labels)), lambda k: F.struct(F.array_join(F.slice(labels, k + 1, F.size(labels)), ".").alias("suffix"), (F.size(labels) - k).alias("depth")))
    )
    spread = written(asked.select("host", "path", F.explode(suffixes).alias("s")).select("host", "path", "s.suffix", "s.depth"))
    lengths = entries.groupBy(F.col("host").alias("suffix")).agg(F.collect_set(F.length("path")).alias("lengths"))
    prefixes = many_to_one(spread, lengths, ["suffix"]).select("host", "path", "suffix", "depth", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    keyed = written(prefixes.select("host", "path", "suffix", "depth", "n", F.expr("left(path, n)").alias("prefix")))
    met = many_to_one(keyed, entries.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), F.col("verdict")), ["suffix", "prefix"])
    best = met.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("suffix", "prefix").alias("rule"), "verdict"), F.struct("depth", "n")).alias("best"))
    found = many_to_one(made, best, ["host", "path"]).select(*kept, "host", "path", "best.rule", "best.verdict")
    rest = made.join(best.select("host", "path"), ["host", "path"], "left_anti")
    return found.unionByName(rest.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
