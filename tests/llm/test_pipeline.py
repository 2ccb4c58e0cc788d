"""The pipeline against brute force on a small table."""

import hashlib
import random

import pytest
from test_byte_bpe import reference_ids

import corpus_pipeline
from corrobora.llm.decontaminate import build, matches, normalise

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    clean = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    texts = [clean(rng.randint(20, 120)) for _ in range(60)]
    items = [(k, clean(25)) for k in range(4)]
    texts += texts[:6] + [t.replace(" a", " zz", 1) + " tail" for t in texts[6:12]]
    texts += [clean(10) + " " + items[k][1] + " " + clean(10) for k in range(4)]
    junk = [" | ".join(word() for _ in range(60)) for _ in range(30)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate([*texts, *junk])]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(k, int(k < len(texts)), 0) for k in range(len(rows)) if k % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, items, len(texts)


def test_run_is_the_brute_force_chain(spark, tables):
    folder, rows, items, clean = tables
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()}
    assert kept == set(range(clean))
    left = {k: t for k, t, *_ in rows if k in kept}
    left = {k: t for k, t in left.items() if k == max(j for j, s in left.items() if s == t)}
    sets = {k: shingles(t) for k, t in left.items()}
    group = {k: k for k in left}
    for _ in left:
        for a in left:
            for b in left:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    left = {k: t for k, t in left.items() if group[k] == k}
    held = build(items, 8, 8)
    left = {k: t for k, t in left.items() if not matches(normalise(t), held)}
    want = set()
    for k, t in left.items():
        ids = reference_ids(t)
        want.add((k, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, folder).collect()} == want
    assert 40 < len(want) < clean


def test_stages_keep_the_columns(spark, tables):
    folder, *_ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
