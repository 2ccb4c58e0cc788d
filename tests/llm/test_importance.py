"""Importance resampling against plain counting, and odd rows."""

import hashlib
import math
import random
import re
import zlib

import pytest

from corrobora.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def runs(text, most):
    w = WORD.findall(lowered(text))
    return [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)], len(w)


def plain(docs, target, percent, buckets, most, least):
    """Every row's n_features, weight and score, and the sorted drawn ones."""
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = {}, {}
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in runs(text, most)[0]:
                counts[place(f)] = counts.get(place(f), 0) + 1
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t.get(b, 0) + 1) * (big_s + buckets) / ((s.get(b, 0) + 1) * (big_t + buckets))))
    out = []
    for k, text in docs:
        found, n = runs(text, most)
        weight = sum(gain(place(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append((k, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    may = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    drawn = may[: percent * len(may) // 100]
    rows = [(*r[:4], i + 1) for i, r in enumerate(drawn)] + [(*r[:4], None) for r in may[len(drawn) :]] + [(*r[:4], None) for r in out if r[4] < least]
    return sorted(map(str, rows))


def got(spark, docs, target, **kw):
    # Extra columns with the operator's own names.
    table = spark.createDataFrame([(k, x, 1, 2, "b") for k, x in docs], "doc_id long, text string, rank int, part int, block string")
    df = I.resample(table.repartition(3), spark.createDataFrame([(x,) for x in target], "text string"), **kw)
    return sorted(str(tuple(r)) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize(("buckets", "most", "percent"), [(10_000, 1, 10), (3000, 2, 50), (7, 3, 100), (2000, 1, 0)])
def test_it_is_plain_counting(spark, buckets, most, percent):
    rnd = random.Random(buckets)
    words = ["the"] * 200 + [f"w{i}" for i in range(300)] + ["Élan", "ÀB", "x9", "naïve", "Z"]
    text = lambda: rnd.choice([" ", ", ", "-", "_"]).join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 19, 20, 21, 60])))
    docs = [(i, text()) for i in range(150)] + [(None, text()), (None, None), (5, None), (-1, ""), (7, "a " * 40), (7, "a " * 40), (2**63 - 1, "\x00b\x7f"), (-(2**63), "Same same")]
    target = [text() for _ in range(12)] + [None, ""]
    assert got(spark, docs, target, buckets=buckets, most=most, percent=percent) == plain(docs, target, percent, buckets, most, 20)


def test_long_texts_in_blocks(spark, monkeypatch):
    long = " ".join(f"v{i % 977}" for i in range(400_000))
    docs = [(1, long), (2, "q" * 3_000_000), (3, long + " end"), *((i, f"v{i} the end " * 10) for i in range(4, 40))]
    assert got(spark, docs, ["the end", "v1 v2"], most=2) == plain(docs, ["the end", "v1 v2"], 10, 10_000, 2, 20)


def test_pieces_cut_no_word(monkeypatch):
    monkeypatch.setattr(I, "PIECE", 7)
    monkeypatch.setattr(I, "KNOWN", 3)
    rnd = random.Random(3)
    for _ in range(200):
        text = "".join(rnd.choice("ab1é ,-") for _ in range(rnd.randint(0, 60)))
        for most in (1, 2, 4):
            found, n = I.features(text.encode(), I.Buckets(1 << 31), most)
            want, words = runs(text, most)
            assert (sorted(found.tolist()), n) == (sorted(zlib.crc32(f.encode()) % (1 << 31) for f in want), words)


def test_empty_tables(spark):
    assert got(spark, [], ["a b"]) == [] == plain([], ["a b"], 10, 10_000, 1, 20)
    docs = [(1, "a b c " * 9), (2, "")]
    assert got(spark, docs, [], percent=100) == plain(docs, [], 100, 10_000, 1, 20)
