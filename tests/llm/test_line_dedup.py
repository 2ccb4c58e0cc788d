"""Line deduplication against all pairs of lines."""

import random

import pytest

from corrobora.llm import line_dedup as module
from corrobora.llm.line_dedup import alike, dedup_lines, line_verdicts, within

KIND = "doc_id long, text string, line_no string"


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def brute(rows):
    lines = sorted(((-1 if k is None else k), no, line.encode().lower().split()) for k, t, _ in rows for no, line in enumerate((t or "").split("\n")))
    out = []
    for k, no, w in lines:
        like = [(a, b) for a, b, v in lines if w and (v == w or (len(v) >= 8 and len(w) >= 8 and abs(len(v) - len(w)) < 2 and distance(v, w) <= 1))]
        keep = min([*like, (k, no)])
        out.append((k, no, len(w), *keep, keep == (k, no)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_verdicts(spark, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 16))] for _ in range(30)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                act = rng.random()
                if act < 0.4 and w:
                    w[rng.randrange(len(w))] = "new"
                elif act < 0.7 and w:
                    w.pop(rng.randrange(len(w)))
                else:
                    w.insert(rng.randint(0, len(w)), rng.choice(["more", "w1", "w2"]))
            lines.append(rng.choice([" ", "  "]).join(w).upper() if rng.random() < 0.2 else " ".join(w))
        rows.append((k, "\n".join(lines), "z"))
    rows += [(None, "a line of its own " * 3, None), (99, None, None), (98, "x\n\n" + "word " * 5000, None)]
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.line_no, r.n_words, (-1 if r.keep_doc is None else r.keep_doc), r.keep_line, r.kept) for r in line_verdicts(spark.createDataFrame(rows, KIND)).collect())
    assert got == brute(rows)


def test_alike_is_the_distance():
    rng = random.Random(4)
    for _ in range(2000):
        x, y = ([rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 6))] for _ in range(2))
        assert alike(x, y) == (distance(x, y) <= 1)


def test_texts(spark):
    long = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, f"{long}\nown", "p"), (2, f"{long} ten\nsecond\n\nown", "q"), (3, None, None)], KIND)
    out = dedup_lines(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: f"{long}\nown", 2: "second\n", 3: None}
    assert line_verdicts(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_verdicts(docs, min_words=3)


def test_rows_that_share_an_identifier_lose_their_own_lines(spark):
    docs = spark.createDataFrame([(0, "copy line\nX", "p"), (1, "keep me\nB", "q"), (1, "copy line\nC", "r"), (None, "copy line\nN", "s")], "doc_id long, text string, __gone string")
    out = dedup_lines(docs)
    assert out.columns == docs.columns
    assert sorted((r["__gone"], r.text) for r in out.collect()) == [("p", "X"), ("q", "keep me\nB"), ("r", "C"), ("s", "copy line\nN")]
    long = "one two three four five six seven eight nine"
    near = spark.createDataFrame([(0, long), (1, f"{long} ten"), (1, "quite another line of some eight or nine words")], "doc_id long, text string")
    assert sorted(r.text for r in dedup_lines(near).collect()) == ["", long, "quite another line of some eight or nine words"]


def test_structured_words_and_lines_are_told_apart(spark):
    """Thue-Morse sequences, whose polynomials modulo 2^64 are equal at every base."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(0, word), (1, other), (2, " ".join(word)), (3, " ".join(other)), (4, " ".join(other) + " c")], "doc_id long, text string")
    got = {r.doc_id: r.keep_doc for r in line_verdicts(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3}


@pytest.mark.parametrize("pair", [("?&6rtcebaaaa385a", "{,!o.jd.$qb_@_@~"), ("aaaaaaaa", "aaaaaaa\x01"), ("\x00", "\x00\x00")])
def test_words_that_weak_hashes_merge(spark, pair):
    docs = spark.createDataFrame([(k, " ".join([w] * 9)) for k, w in enumerate(pair)] + [(2, f"{pair[0]} a"), (3, f"{pair[1]} a")], "doc_id long, text string")
    assert {r.doc_id: r.keep_doc for r in line_verdicts(docs).collect()} == {k: k for k in range(4)}


def test_within_is_the_distance():
    rng = random.Random(6)
    for _ in range(3000):
        x, y = ([rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 9))] for _ in range(2))
        k = rng.randint(0, 5)
        assert within(x, y, k) == (distance(x, y) <= k)


def edited(rng, w, edits):
    w = list(w)
    for _ in range(edits):
        act = rng.random()
        at = rng.randrange(len(w))
        if act < 0.5:
            w[at] = f"new{rng.randint(0, 3)}"
        elif act < 0.75:
            w.pop(at)
        else:
            w.insert(at, rng.choice(["more", "w1", "w2"]))
    return w


@pytest.mark.parametrize("percent,short", [(10, 3), (20, None)])
def test_bound_grows_with_length(spark, percent, short):
    """All pairs within the bound are found, groups of many alike lines and repeated words included."""
    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (3, 4, 6, 7, 8, 17, 18, 19, 20, 21, 29, 31, 57, 90)] + [["again"] * 25, ["x", "y"] * 15]
    shared = [rng.choice(vocabulary) for _ in range(15)]
    base += [[rng.choice(vocabulary) for _ in range(10)] + shared for _ in range(4)]
    rows = []
    for k in range(70):
        lines = [" ".join(edited(rng, w, rng.choice([0, 1, 2, 3, 4, 6]) if len(w) > 12 else rng.choice([0, 1, 2]))) for w in rng.sample(base, 4)]
        rows.append((k, "\n".join(lines), None))
    got = sorted((r.doc_id, r.line_no, r.keep_doc, r.keep_line) for r in line_verdicts(spark.createDataFrame(rows, KIND), percent=percent, short=short).collect())
    places = sorted((k, no, line.split()) for k, t, _ in rows for no, line in enumerate(t.split("\n")))
    least, want = short or 8, []
    for k, no, w in places:
        def like(v, w=w):
            bound = max(1, max(len(v), len(w)) * percent // 100)
            return v == w or (min(len(v), len(w)) >= least and abs(len(v) - len(w)) <= bound and distance(v, w) <= bound)
        want.append((k, no, *(min([(a, b) for a, b, v in places if (a, b) < (k, no) and v and w and like(v)], default=(k, no)))))
    # The first place of an equal line stands for it.
    assert got == sorted(want)


@pytest.mark.parametrize("limit,hints", [(1000, 1), (100, 0)])
def test_line_numbers_count_for_the_broadcast(spark, monkeypatch, limit, hints):
    monkeypatch.setattr(module, "BROADCAST_ROWS", limit)
    source = spark.createDataFrame([(k, b"line\n" * 50) for k in range(3)], "doc_id long, text binary")
    places = spark.createDataFrame([((k, no),) for k in range(3) for no in range(50)], "first struct<doc_id:long,line_no:int>")
    found = module._texts(source, places)
    assert found._jdf.queryExecution().analyzed().toString().count("strategy=broadcast") == hints
    assert sorted((r.doc_id, len(r.nos)) for r in found.collect()) == [(0, 50), (1, 50), (2, 50)]
