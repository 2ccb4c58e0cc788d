"""The Jaccard join against all pairs."""

import random

import pytest

from corrobora.llm import jaccard_join as module
from corrobora.llm.components import components
from corrobora.llm.jaccard_join import apart, drop_near_copies, jaccard_components, sketch
from corrobora.llm.wordhash import shingle_sets, word_hashes

KIND = "doc_id long, text string, component_id string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(k, shingles(t)) for k, t, _ in rows if k is not None]
    label = {k: k for k, _ in sets}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return sorted((k, len(s), root(k)) for k, s in sets)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "c", "dd", "e" * 9, "ff", "gg", "hh"]) + str(rng.randint(0, 60))
    passage = " ".join(word() for _ in range(12))
    base = [[word() for _ in range(rng.randint(0, 60))] for _ in range(25)]
    rows = []
    for k in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            if words:
                words[rng.randrange(len(words))] = word()
        if rng.random() < 0.3:
            words += passage.split()
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(words), "z"))
    return rows + [(500, None, None), (501, "  ", None), (502, "one two", None), (503, "ONE  two", None), (None, "one two", None)]


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed, monkeypatch):
    monkeypatch.setattr(module, "HEAVY_AT", 8)
    monkeypatch.setattr(module, "LONG_LIST", 20)
    rows = corpus(seed)
    got = jaccard_components(spark.createDataFrame(rows, KIND)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute(rows)
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(1, 502)]


@pytest.mark.parametrize("rounds", [0, 3])
def test_a_large_group_of_near_copies(spark, rounds, monkeypatch):
    monkeypatch.setattr(module, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(module, "HUB_PAIRS", 8)
    if rounds:  # hubs' rows are dealt out instead of broadcast
        monkeypatch.setattr(module, "HUB_BYTES", 0)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(words), ""))
    got = jaccard_components(spark.createDataFrame(rows, KIND))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def test_sketches_never_overstate():
    rng = random.Random(2)
    for _ in range(300):
        x = {rng.randint(0, 400) for _ in range(rng.randint(1, 200))}
        y = {rng.choice(sorted(x)) if rng.random() < 0.7 else rng.randint(0, 400) for _ in range(rng.randint(1, 200))}
        s, t = (shingle_sets([f"n{v}".encode() for v in sorted(z)], 1) for z in (x, y))
        s, t = ({int(v[0]) for v in z} for z in (s, t))
        import numpy as np

        assert apart(sketch(np.array(sorted(s), np.uint64)), sketch(np.array(sorted(t), np.uint64))) <= len(s ^ t)


def test_word_hashes_cut_long_texts_at_words():
    text = ("word%d " * 60_000 % tuple(range(60_000))).encode()
    h, at = word_hashes([text, b"", b"word7 WORD7"])
    assert at.tolist() == [0, 60_000, 60_000, 60_002]
    assert len(set(h[:60_000].tolist())) == 60_000
    assert h[7] == h[60_000] == h[60_001]


def test_chain_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 200) if k % 50] + [(7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {k: (k - 1) // 50 * 50 + 1 for k in range(1, 201)}
    assert components(edges.limit(0)).count() == 0


def test_structured_texts_are_told_apart(spark):
    """Thue-Morse words, whose polynomials modulo 2^64 are equal at every base."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(0, word), (1, word.translate(str.maketrans("ab", "ba"))), (2, " ".join(word)), (3, " ".join(word) + " x")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_components(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 2}


@pytest.mark.parametrize("pair", [("?&6rtcebaaaa385a", "{,!o.jd.$qb_@_@~"), ("aaaaaaaa", "aaaaaaa\x01"), ("\x00", "\x00\x00")])
def test_words_that_weak_hashes_merge(spark, pair):
    docs = spark.createDataFrame([(k, " ".join([w] * 6)) for k, w in enumerate(pair)] + [(2, f"{pair[0]} a b c d"), (3, f"{pair[1]} a b c d")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_components(docs).collect()} == {k: k for k in range(4)}


def test_word_hashes_are_one_to_one():
    rng = random.Random(4)
    words = {bytes(rng.choice(b"ab\x00{}\xff") for _ in range(rng.randint(1, 9))) for _ in range(20_000)}
    h, at = word_hashes([b" ".join(words)])
    assert len(set(h.tolist())) == len(words) == at[-1]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", ""), (1, "a b c d e f", ""), (2, "A b  c d e f", "")], KIND)
    assert sorted(map(tuple, jaccard_components(docs).collect())) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert jaccard_components(docs.limit(0)).count() == 0
    left = drop_near_copies(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1}
    with pytest.raises(ValueError):
        jaccard_components(docs, percent=0)
