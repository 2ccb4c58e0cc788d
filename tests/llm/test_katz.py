"""The Katz model against a plain one, and its normalisation."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corrobora.llm import katz, ragged
from corrobora.llm.katz import CUT, HIGH, Katz, katz_scores


def held(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 1


def tokens(text):
    return [*(w.decode() for w in (text or "").encode().lower().split()), "</s>"]


class Plain:
    def __init__(self, rows, order=3):
        self.order, self.c, self.after = order, Counter(), defaultdict(Counter)
        for doc_id, text in rows:
            if not held(doc_id):
                words = tokens(text)
                self.c.update(words)
                for h, w in self.contexts(words):
                    for k in range(1, order):
                        self.after[h[-k:]][w] += 1
        self.n = sum(self.c.values())
        self.d1 = self.ratios(self.c.values())
        self.d = {k: self.ratios([r for h, x in self.after.items() if len(h) == k - 1 for r in x.values()]) for k in range(2, order + 1)}
        self.unknown = 1 - sum(self.kept(self.d1, r) for r in self.c.values()) / self.n if self.n else 1.0

    def contexts(self, words):
        for i, w in enumerate(words):
            h = tuple(words[max(0, i - self.order + 1) : i])
            yield ("<s>",) * (self.order - 1 - len(h)) + h, w

    @staticmethod
    def ratios(counts):
        n = Counter(counts)
        plain = {r: (r - 0.5) / r for r in range(1, CUT + 1)}
        if any(n[r] == 0 for r in range(1, CUT + 1)):
            return plain
        m = (CUT + 1) * n[CUT + 1] / n[1]
        if m >= 1:
            return plain
        d = {r: ((r + 1) * n[r + 1] / n[r] / r - m) / (1 - m) for r in range(1, CUT + 1)}
        return d if all(0 < x < 1 for x in d.values()) else plain

    @staticmethod
    def kept(d, r):
        return d[r] * r if r <= CUT else r - HIGH

    def p1(self, w):
        return self.kept(self.d1, self.c[w]) / self.n if self.c[w] else self.unknown

    def p(self, w, h):
        if not h:
            return self.p1(w)
        seen = self.after.get(h)
        if not seen:
            return self.p(w, h[1:])
        d, total = self.d[len(h) + 1], sum(seen.values())
        if seen.get(w):
            return self.kept(d, seen[w]) / total
        left = 1 - sum(self.kept(d, r) for r in seen.values()) / total
        return left / (1 - sum(self.p(x, h[1:]) for x in seen)) * self.p(w, h[1:])

    def row(self, doc_id, text):
        words = tokens(text)
        base = sum(math.log10((self.c[w] + 0.5) / (self.n + 0.5 * (len(self.c) + 1))) for w in words)
        score = sum(math.log10(self.p(w, h)) for h, w in self.contexts(words))
        return doc_id, held(doc_id), len(words), sum(self.c[w] > 0 for w in words), self.n, base, score


def corpus(seed, size, words):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    weights = [1 / (k + 1) for k in range(words)]
    return [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 40)))) for k in range(size)]


@pytest.mark.parametrize("seed,size,words,order", [(1, 120, 60, 3), (2, 30, 400, 3), (3, 4, 5, 3), (4, 120, 8, 4), (5, 60, 60, 2), (6, 40, 9, 1)])
def test_scores_are_the_plain_models(spark, seed, size, words, order):
    rows = [*corpus(seed, size, words), (900, "Unseen words here"), (901, None), (902, "w0 " * 3000)]
    plain = Plain(rows, order)
    got = sorted(tuple(r) for r in katz_scores(spark.createDataFrame(rows, "doc_id long, text string"), order=order).collect())
    for a, b in zip(got, (plain.row(*r) for r in sorted(rows)), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-7, abs=2e-6)


def test_every_context_sums_to_one():
    plain = Plain(corpus(5, 200, 50))
    for h in [("<s>", "<s>"), ("<s>", "w0"), ("w0", "w1"), ("w3", "w40"), ("w1", "never"), ("never", "w1")]:
        assert sum(plain.p(w, h) for w in [*plain.c, "unknown word"]) == pytest.approx(1, abs=1e-9)


def test_hot_contexts_give_the_same(spark):
    rows = [(k, "the a " * 40 + f"the b{k} the c{k % 7}") for k in range(60)]
    plain = Plain(rows)
    model = Katz(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [len(ids) >= 2 for ids, _ in model.hot] == [True, True]
    got = sorted(tuple(r) for r in model.scores().collect())
    for a, r in zip(got, rows, strict=True):
        assert a[5:] == pytest.approx(plain.row(*r)[5:], rel=1e-7, abs=2e-6)


def test_structured_words_are_told_apart(spark):
    """Thue-Morse words, whose polynomials modulo 2^64 are equal at every base."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(2, f"{word} x {other}"), (3, f"{other} x"), (4, word)]
    plain = Plain(rows)
    got = sorted(tuple(r) for r in katz_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    for a, r in zip(got, rows, strict=True):
        assert a[5:] == pytest.approx(plain.row(*r)[5:], rel=1e-7, abs=2e-6)


def test_numbering_and_ordering():
    rng = np.random.default_rng(3)
    for n, top in ((0, 5), (1, 5), (500, 9), (500, 1 << 61)):
        x, y = rng.integers(0, top, n), rng.integers(0, top, n)
        keys, first, code = ragged.numbered(x)
        assert keys.tolist() == sorted(set(x.tolist())) and x[first].tolist() == keys.tolist() and keys[code].tolist() == x.tolist()
        order = ragged.ordered(x, y)
        assert [(x[i], y[i]) for i in order] == sorted(zip(x.tolist(), y.tolist(), strict=True))


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    passes, ask = [], katz._ask_words
    monkeypatch.setattr(katz, "_ask_words", lambda *a: passes.append(a) or ask(*a))
    Katz(spark.createDataFrame(corpus(1, 20, 30), "doc_id long, text string"))
    assert len(passes) == 1


def test_blobs_hold_the_bytes_that_numbers_need():
    rng = np.random.default_rng(4)
    for top in (1, 2, 255, 256, 1 << 16, 1 << 40, (1 << 63) - 1):
        for n in (0, 1, 1000):
            values = rng.integers(0, top, n, endpoint=True)
            assert katz.unpack(katz.pack(values)).tolist() == values.tolist()
        blob = katz.pack(np.r_[values, top])
        assert blob[0] == -(-top.bit_length() // 8) and len(blob) < 1002 * blob[0] + 30


def test_sorted_keys_and_their_places():
    """With room for the place beside the key, just so, without it, and with negative keys."""
    rng = np.random.default_rng(5)
    for n, low, high in ((0, 0, 1), (1, 0, 1), (700, 0, 40), (700, 0, (1 << 53) - 1), (700, 0, 1 << 53), (700, -9, 9)):
        keys = rng.integers(low, high, n, endpoint=True)
        keys[-1:] = high
        found, order = ragged.rising(keys)
        assert order.tolist() == np.argsort(keys, kind="stable").tolist() and found.tolist() == sorted(keys.tolist())
        assert np.cumsum(ragged.steps(found)).tolist() == found.tolist()


@pytest.mark.parametrize("pair", [("?&6rtcebaaaa385a", "{,!o.jd.$qb_@_@~"), ("aaaaaaaa", "aaaaaaa\x01"), ("\x00", "\x00\x00")])
def test_words_that_weak_hashes_merge(spark, pair):
    """A held-out text with the word that training texts do not have."""
    only_held, seen = next(k for k in range(99) if held(k)), next(k for k in range(99) if not held(k))
    rows = sorted([(seen, f"{pair[0]} {pair[0]} x"), (only_held, f"{pair[1]} x")])
    plain = Plain(rows)
    got = sorted(tuple(r) for r in katz_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert next(r for r in got if r[0] == only_held)[3] == 2
    for a, r in zip(got, rows, strict=True):
        assert a[5:] == pytest.approx(plain.row(*r)[5:], rel=1e-7, abs=2e-6)


def test_edge_cases(spark):
    kind = "doc_id long, text string, score string"
    assert katz_scores(spark.createDataFrame([], kind)).count() == 0
    only_held = next(k for k in range(99) if held(k))
    got = katz_scores(spark.createDataFrame([(only_held, "a b", "x")], kind)).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.score, got.base_score) == (3, 0, 0, 0.0, 0.0)
    twice = katz_scores(spark.createDataFrame([(2, "a b", "x"), (2, "a b", "x"), (None, "c", None)], kind).coalesce(1)).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in twice) == [(-1, 2), (2, 3), (2, 3)]
