"""Quotes looked up by seeds against plain containment."""

import random

import pytest

from corrobora.operators import quotes, verify

TEXT = "id long, group string, text string"


def test_every_long_enough_stretch_shares_its_seeds():
    rng = random.Random(1)
    for n in (0, 19, 20, 21, 300, 5000):
        text = "".join(rng.choice("ab é🙂") for _ in range(n))
        own = set(quotes.seeds(text).tolist())
        assert bool(own) == (n >= quotes.SHORTEST)
        for _ in range(50):
            a = rng.randrange(max(1, n - 19))
            part = text[a : a + rng.randint(20, 60)]
            if len(part) >= quotes.SHORTEST:
                assert set(quotes.seeds(part).tolist()) <= own and len(quotes.seeds(part))


def test_pieces_of_long_texts(monkeypatch):
    text = "".join(random.Random(2).choice("abcd ") for _ in range(3000))
    whole = quotes.seeds(text).tolist()
    monkeypatch.setattr(quotes, "PIECE", 64)
    assert quotes.seeds(text).tolist() == whole


def test_it_is_containment(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "of", "the"]
    texts = [(k, f"g{k % 3}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for k in range(120)]
    texts += [(500 + k, "g0", texts[0][2] + " same boilerplate at the end of each") for k in range(60)] + [(990, None, texts[1][2]), (991, "g1", None), (992, "g1", "")]
    asked = []
    for k in range(200):
        t = rng.choice(texts)[2] or ""
        a = rng.randrange(len(t) + 1)
        asked.append((k, f"g{rng.randrange(4)}", t[a : a + rng.choice([5, 20, 21, 90, 400])] if k % 5 else "never said in any of these texts"))
    asked += [(300, "g0", "boilerplate at the end of each"), (301, None, "boilerplate at the end of each"), (302, "g0", "boilerplate at the end of each"), (303, "g0", None)]
    got = sorted(map(tuple, quotes.containing(spark.createDataFrame(asked, TEXT), spark.createDataFrame(texts, TEXT)).collect()))
    assert got == sorted((q, t) for q, g, x in asked for t, h, y in texts if g is not None and g == h and x and y and len(x) >= quotes.SHORTEST and x in y)
    empty = spark.createDataFrame([], TEXT)
    assert quotes.containing(empty, spark.createDataFrame(texts, TEXT)).count() == quotes.containing(spark.createDataFrame(asked, TEXT), empty).count() == 0


@pytest.mark.parametrize("pairs", [0, 30, 1 << 16])
def test_seeds_change_no_verdict(spark, monkeypatch, pairs):
    monkeypatch.setattr(verify, "PAIRS", pairs)
    rng = random.Random(4)
    word = lambda: rng.choice(["backup", "restore", "nightly", "tested", "quarter", "of", "“the”", "Ünder"])
    hits = [(f"o{k % 4}", k, f"c{k}", f"f{k % 5}", k % 3 or None, " ".join(word() for _ in range(30))) for k in range(60)]
    hits += [("o0", 100 + k, f"x{k}", "copy", None, hits[0][5]) for k in range(20)]
    claims = []
    for k in range(40):
        t = rng.choice([h for h in hits if h[0] == f"o{k % 5}"] or hits)[5]
        a = rng.randrange(len(t) // 2)
        claims.append((f"o{k % 5}", k // 5, f"f{k % 5}", t[a : a + 70].upper() if k % 3 else "a quote that stands nowhere at all"))
    schema = "outcome_id string, rank int, chunk_id string, source_file string, page int, text string"
    args = spark.createDataFrame(claims, "outcome_id string, pos int, source_file string, quote string"), spark.createDataFrame(hits, schema)
    want = sorted(map(str, verify.verify_quotes(*args, bounded=True).collect()))
    assert sorted(map(str, verify.verify_quotes(*args).collect())) == want and sum("verified=True" in r for r in want) > 5


def test_one_outcome_has_all_hits(spark):
    """200,000 hits of one outcome that all share a sentence: no task gets them all."""
    text = "concat('Backups are taken every night and tested. Row number ', id, ' of the long table says ', md5(string(id)))"
    hits = spark.range(200_000, numPartitions=8).selectExpr("'o' AS outcome_id", "int(id) AS rank", "string(id) AS chunk_id", "'f' AS source_file", "int(null) AS page", f"{text} AS text")
    claims = spark.createDataFrame([("o", 0, "f", "are taken every night and tested"), ("o", 1, "f", "Row number 123456 of the long table says"), ("o", 2, "f", "Row number 200001 of the long table says")], "outcome_id string, pos int, source_file string, quote string")
    got = {r.pos: r.chunk_id for r in verify.verify_quotes(claims, hits).collect()}
    assert got == {0: "0", 1: "123456", 2: None}
