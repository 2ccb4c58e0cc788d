"""Quotes of a corpus with few syllables: candidates are few, and no text travels by pair."""

import random

from corrobora.operators import quotes


def test_candidates_grow_with_quotes_and_texts_alone(spark, monkeypatch):
    rng, syllables = random.Random(7), "then ther tion ing. erth ough and. able ness ouse ring less ment ward ship ever".split()
    text = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    texts = [(k, "g", text(3000)) for k in range(400)]
    asked = [(k, g, t[5000:5060]) for k, g, t in texts]
    met = []
    plain = quotes.many_to_one

    def counted(many, one, on, **more):
        met.append((many.count(), many.columns))
        return plain(many, one, on, **more)

    monkeypatch.setattr(quotes, "many_to_one", counted)
    schema = "id long, group string, text string"
    got = quotes.containing(spark.createDataFrame(asked, schema), spark.createDataFrame(texts, schema))
    assert sorted(map(tuple, got.collect())) == [(k, k) for k in range(400)]
    assert not any("hay" in columns for _, columns in met)
    assert met[1][0] < 500


def test_a_large_group_of_copies_makes_no_pairs_of_all(spark, monkeypatch):
    words = [f"word{k * k % 9973}" for k in range(60)]
    texts = [(k, "g", f"number {k} " + " ".join(words), 1000 - k) for k in range(400)] + [(900, "g", "edited " + " ".join(words[:30] + ["edit", *words[31:]]), 7)]
    whole = " ".join(words)
    asked = [(k, "g", whole[k : k + 60]) for k in range(200)] + [(900, "g", texts[-1][2][150:260])]
    met = []
    plain = quotes.many_to_one

    def counted(many, one, on, **more):
        met.append((on, many.count()))
        return plain(many, one, on, **more)

    monkeypatch.setattr(quotes, "many_to_one", counted)
    made = quotes.containing(spark.createDataFrame(asked, "id long, group string, text string"), spark.createDataFrame(texts, "id long, group string, text string, rank int"), first=True)
    rank = {t[0]: t[3] for t in texts}
    got = {}
    for q, t in map(tuple, made.collect()):
        got[q] = min(got.get(q, 10**6), rank[t])
    assert got == {q: min(r for _, _, text, r in texts if x in text) for q, _, x in asked}
    assert sum(n for on, n in met if on == ["quote"]) < 30_000
