"""Decontamination against plain dynamic programming."""

import random

import pytest

from corrobora.llm.decontaminate import align, build, contamination, decontaminate, matches, normalise, points


def plain(passage: str, text: str) -> int:
    """Fewest edits between the passage and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(passage, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng: random.Random, text: str, edits: int) -> str:
    chars = list(text)
    for _ in range(edits):
        k = rng.randrange(len(chars))
        rng.choice([lambda: chars.insert(k, rng.choice("abc ")), lambda: chars.pop(k), lambda: chars.__setitem__(k, rng.choice("xyz"))])()
    return "".join(chars)


def test_align_is_the_plain_distance():
    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        t = "".join(rng.choice("ab") for _ in range(rng.randint(0, 20)))
        edits, end = align(points(p), points(t), -len(p), len(t))
        assert edits == plain(p, t)
        assert 0 <= end <= len(t)


@pytest.mark.parametrize("seed", range(6))
def test_all_occurrences_within_the_budget_are_found(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 7)))
    items = [(k, normalise(" ".join(word() for _ in range(rng.randint(1, 40))))) for k in range(12)]
    held = build(items, 8, 8)
    for _ in range(25):
        text = " ".join(word() for _ in range(rng.randint(0, 60)))
        for k in rng.sample(range(12), 2):
            text += " " + edited(rng, items[k][1], rng.randint(0, 4)) + " " + word()
        text = normalise(text)
        want = {k: d for k, t in items if (d := plain(t, text)) <= len(t) * 8 // 100}
        got = matches(text, held)
        assert {i: e for i, _, _, e in got} == want
        for i, a, b, e in got:
            assert plain(items[i][1], text[a:b]) == e


def test_edge_cases(spark):
    items = spark.createDataFrame([(1, "A passage of some length, told once."), (2, ""), (3, None)], "item_id long, text string")
    long = "filler words here " * 90_000
    docs = spark.createDataFrame(
        [(1, "x " + "a  PASSAGE of\nsome length, told once. y", 7), (1, "clean", 8), (None, None, 9), (3, "", 1), (4, long + "a passage of some lenGTh, told once." + long, 2)],
        "doc_id long, text string, item_id long",
    )
    got = sorted(((r.doc_id, r.contaminated, r["items"]) for r in contamination(docs, items).collect()), key=str)
    assert got == sorted([(1, True, [1]), (1, False, []), (None, False, []), (3, False, []), (4, True, [1])], key=str)
    assert contamination(docs.limit(0), items).count() == 0
    assert {r.contaminated for r in contamination(docs, items.limit(0)).collect()} == {False}
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.item_id for r in kept.collect()) == [1, 9]


def test_index_blocks_give_the_same(spark, monkeypatch):
    from corrobora.llm import decontaminate as module

    items = spark.createDataFrame([(k, f"passage number {k} with words of its own {k * 7919}") for k in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"before passage number {k} with words of its own {k * 7919} after") for k in range(9)], "doc_id long, text string")
    want = sorted((r.doc_id, r["items"]) for r in contamination(docs, items).collect())
    monkeypatch.setattr(module, "INDEX_CHARS", 100)
    assert sorted((r.doc_id, r["items"]) for r in contamination(docs, items).collect()) == want
    assert all(k in i for k, i in want)
