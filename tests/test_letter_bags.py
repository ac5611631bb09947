"""What shared letters rule out against the likeness itself."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from coinloom.functions.narration import bags_may_be_alike, jaro_winkler_of, letter_bag, may_be_alike

LEAST = 0.92


def pairs(n):
    rng, words = random.Random(3), ["city metro", "river books", "aaaaaaa", "nova fuel station", "green grocer 12", "ünïcode ßtraße", "", "x", "日本語 text"]
    out = []
    for _ in range(n):
        a = " ".join(rng.sample(words, rng.randint(1, 3)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            if b:
                k = rng.randrange(len(b))
                b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "zz", "é", "7"])
        if rng.random() < 0.3:
            rng.shuffle(b)
        out.append((a, "".join(b)))
    return out


def test_no_alike_pair_is_ruled_out_and_few_others_stay(spark):
    """10,000 distinct narrations of one amount: nearly all of their pairs are ruled out in the JVM."""
    own = pairs(1500)
    df = spark.createDataFrame(own, "a string, b string").withColumns({"x": letter_bag(F.col("a")), "y": letter_bag(F.col("b"))})
    kept = df.select("a", "b", bags_may_be_alike(F.col("a"), F.col("b"), F.col("x"), F.col("y"), LEAST).alias("may")).collect()
    alike = [(r["a"], r["b"], r["may"]) for r in kept if jaro_winkler_of(r["a"], r["b"]) >= LEAST]
    assert len(alike) > 300 and all(may for _, _, may in alike)
    assert sum(not r["may"] for r in kept) > 200
    rng = random.Random(5)
    texts = sorted({"shop " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(8, 20))) for _ in range(10_000)})
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("g", letter_bag(F.col("t")))
    some = rows.where(F.pmod(F.xxhash64("t"), F.lit(50)) == 0).select(F.col("t").alias("u"), F.col("g").alias("h"))
    both = rows.crossJoin(some).where("t <> u")
    n = both.count()
    left = both.where(may_be_alike(F.col("t"), F.col("u"), LEAST) & bags_may_be_alike(F.col("t"), F.col("u"), F.col("g"), F.col("h"), LEAST)).count()
    assert left < 0.02 * n
