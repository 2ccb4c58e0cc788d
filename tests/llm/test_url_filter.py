"""URL filters: the trie against a plain loop over all entries, the join against the trie, and odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corrobora.llm import url_filter as U


def plain(rules, host, path):
    """Every entry is tried; the most labels win, then the longest path, then block."""
    fits = [(len(h.split(".")) if h else 0, len(p), v == "block", h + p, v) for h, p, v in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else None


def drawn(n, seed):
    rnd = random.Random(seed)
    host = lambda: ".".join(rnd.choice(["a", "b", "net", "org", ""]) for _ in range(rnd.randint(1, 4)))
    path = lambda: rnd.choice(["", "/"]) + "/".join(rnd.choice(["x", "xy", "en", ""]) for _ in range(rnd.randint(0, 4)))
    return [(rnd.choice([host(), host(), ""]) if rnd.random() < 0.1 else host(), path(), rnd.choice(["allow", "block"])) for _ in range(n)]


def test_trie_is_the_plain_loop():
    for seed in range(60):
        rules = drawn(seed % 12, seed)
        top = U.build(rules)
        for host, path, _ in drawn(60, seed + 1000):
            assert U.longest(top, host, path) == plain(rules, host, path), (rules, host, path)


def test_urls_are_taken_apart(spark):
    urls = ["http://A.Example.NET/En/1?x#y", "no scheme", None, "", "x://h", "x://h?q=/a", "a://b://c/d", "x:///p", "x://h\n/p\n", "https://h:80/a#/b"]
    want = [("a.example.net", "/En/1"), ("", ""), ("", ""), ("", ""), ("h", ""), ("h", ""), ("b:", "//c/d"), ("", "/p"), ("h\n", "/p\n"), ("h:80", "/a")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path) for r in df.select("page_id", U.host_of(F.col("url")).alias("host"), U.path_of(F.col("url")).alias("path")).collect()}
    assert [got[i] for i in range(len(urls))] == want


@pytest.mark.parametrize("seed", [1, 2])
def test_join_is_the_trie(spark, seed):
    rules = [*drawn(40, seed), ("net", "/", "block"), ("net", "/", "allow"), (None, "/only", "allow"), ("UP.net", "/x", "allow"), ("a", "/x", "other")]
    rows = [(i, f"http://{h}{p}") for i, (h, p, _) in enumerate(drawn(300, seed + 5))] + [(None, None), (7, "x://up.NET/xy"), (7, "x://up.NET/xy")]
    # Extra columns with the operator's own names; one host has most of the rows.
    pages = spark.createDataFrame([(*r, "old", 1) for r in rows + [(900 + i, "http://b.net/en/x") for i in range(900)]], "page_id long, url string, verdict string, __walk int")
    table = spark.createDataFrame(rules, U.RULES)
    walked = U.judge_urls(pages, table)
    joined = U.judge_urls(pages, table, trie_bytes=0)
    key = lambda df: sorted(map(str, df.select("page_id", "url", "__walk", "host", "path", "rule", "verdict").collect()))
    assert key(walked) == key(joined) and walked.count() == len(rows) + 900
    clean = [(h or "", p, v) for h, p, v in rules if v != "other"]
    for r in walked.collect():
        assert (r.rule, r.verdict) == (plain([(h.lower(), p, v) for h, p, v in clean], r.host, r.path) or (None, "allow"))


def test_no_rows_no_rules_and_long_urls(spark):
    none = spark.createDataFrame([], U.RULES)
    long = "http://" + "a." * 200_000 + "net/" + "b/" * 500_000
    pages = spark.createDataFrame([(1, long), (2, "http://x.net/")], "page_id long, url string")
    assert [r.verdict for r in U.judge_urls(pages, none).collect()] == ["allow", "allow"]
    assert U.judge_urls(pages.limit(0), none).count() == 0
    rules = spark.createDataFrame([("net", "/", "block")], U.RULES)
    assert [(r.rule, r.verdict) for r in U.judge_urls(pages, rules).collect()] == [("net/", "block")] * 2
    assert [r.verdict for r in U.judge_urls(pages, none, default="block").collect()] == ["block"] * 2
    assert re.fullmatch(r"(a\.)+net", U.judge_urls(pages, rules).first().host)
