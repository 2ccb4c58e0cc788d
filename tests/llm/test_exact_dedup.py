"""Exact deduplication against grouping in plain Python, the trie's spilling included."""

import random
from collections import defaultdict

import pytest

from corrobora.llm import exact_dedup as module
from corrobora.llm.exact_dedup import RadixTrie, drop_copies, exact_dedup

KIND = "doc_id long, text string, keep_id string"


@pytest.mark.parametrize("limit", [1 << 30, 4000, 1500])
def test_trie_groups_are_exact(limit):
    rng = random.Random(limit)
    trie, want = RadixTrie(module._largest, limit), defaultdict(list)
    for rep in range(3000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) * rng.choice([1, 1, 7])
        trie.insert(key, 1, rep * 7 % 3001, rep)
        want[key].append(rep)
    got = sorted((count, best, sorted(reps)) for count, best, _, reps in trie.groups())
    assert got == sorted((len(r), max(x * 7 % 3001 for x in r), sorted(r)) for r in want.values())


@pytest.mark.parametrize("shape", ["one long key", "shared opening", "nested", "falling", "long leaves"])
def test_spilling_ends_and_loses_nothing(shape, monkeypatch):
    """Keys above the limit, long common prefixes and deep nests: no recursion, and files of about what there is."""
    rng, limit = random.Random(1), 20_000
    keys = {
        "one long key": [b"x" * 100_000] * 3 + [b"x" * 99_999 + b"y"],
        "shared opening": [b"o" * 3000 + rng.randbytes(30) for _ in range(2000)],
        "nested": [b"a" * k + b"b" for k in range(3000)],
        "falling": [b"a" * (3000 - k) + b"b" for k in range(3000)],
        "long leaves": [bytes([k]) * 15_000 + rng.randbytes(9) for k in range(20) for _ in range(2)],
    }[shape]
    wrote = 0
    add = module.Spilled.add

    def counted(self, key, *more):
        nonlocal wrote
        wrote += len(key)
        add(self, key, *more)

    monkeypatch.setattr(module.Spilled, "add", counted)
    trie, want = RadixTrie(module._largest, limit), defaultdict(int)
    for rep, key in enumerate(keys):
        trie.insert(key, 1, rep, rep)
        want[key] += 1
    assert sorted(end[0] for end in trie.groups()) == sorted(want.values())
    # A chain of nested keys moves down half a limit at a time: as often as its nodes hold the limit.
    times = 8000 * module.NODE_BYTES // limit if shape in ("nested", "falling") else 8
    assert wrote <= times * (sum(map(len, keys)) + limit)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_rows(spark, keep, monkeypatch):
    monkeypatch.setattr(module, "LOCAL_BYTES", 2000)
    rng = random.Random(5)
    rows = [(k, rng.choice(["", "a", "ab", "b" * 50, "é" * 20_000, f"own {k}"]), "x") for k in range(300)] + [(900, None, None), (None, "a", None), (None, "nobody", None)]
    got = exact_dedup(spark.createDataFrame(rows, KIND).repartition(5), keep=keep).collect()
    groups = defaultdict(list)
    for k, t, _ in rows:
        groups[t or ""].append(k)
    assert len(got) == len(rows)
    best = {t: (max if keep == "largest" else min)((k for k in ks if k is not None), default=None) for t, ks in groups.items()}
    want = sorted(((k, best[t or ""], len(groups[t or ""])) for k, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "t", "p", "a", 5), (1, "t", "q", "b", 6), (2, "t", "r", "c", 7)], "doc_id long, text string, __0 string, __sha string, kept int")
    left = drop_copies(docs)
    assert (left.columns, [(r.doc_id, r["__0"], r.kept) for r in left.collect()]) == (docs.columns, [(2, "r", 7)])
    again = drop_copies(docs.where("doc_id = 1"))
    assert (again.columns, again.count()) == (docs.columns, 1)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "t", "p"), (1, "t", "q"), (1, "u", "r"), (2, "u", "s")]
    docs = spark.createDataFrame(rows, KIND)
    assert sum(r.kept for r in exact_dedup(docs).collect()) == 2
    left = drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, "t"), (2, "u")]
    assert exact_dedup(docs.limit(0)).count() == 0 == drop_copies(docs.limit(0)).count()
    with pytest.raises(ValueError):
        exact_dedup(docs, keep="first")
