"""Of the seeds of texts only those that quotes may have are shuffled."""

from pyspark.sql import functions as F

from corrobora.operators import quotes


def test_the_filter_leaves_out_most_seeds_and_no_wanted_one(spark):
    texts = spark.range(300).select("id", F.concat_ws(" ", *(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{k}")), 256) for k in range(8))).alias("text"))
    asked = texts.where("id % 10 = 0").select("id", F.substring("text", 100, 60).alias("text"))
    wanted = quotes.with_seeds(asked).select("seed").distinct()
    every, kept = quotes.with_seeds(texts), quotes.with_seeds(texts, quotes.filter_of(wanted))
    assert kept.count() < every.count() / 10
    assert every.join(wanted, "seed").select("id", "seed").exceptAll(kept).count() == 0


def test_many_quotes_find_the_same_through_the_filter(spark, monkeypatch):
    texts = spark.range(60).select("id", F.lit("g").alias("group"), F.concat_ws(" ", *(F.sha2(F.concat((F.col("id") % 40).cast("string"), F.lit(f"/{k}")), 256) for k in range(4))).alias("text"))
    asked = texts.select("id", "group", F.substring("text", 50, 60).alias("text"))
    want = sorted(map(tuple, quotes.containing(asked, texts).collect()))
    monkeypatch.setattr(quotes, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, quotes.containing(asked, texts).collect())) == want and len(want) == 20 * 4 + 20

