"""The weighted similarity join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import recall, similarity

FIELDS = ("title", "category", "summary", "triggers", "topics", "rule", "body")


def cards(spark, n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(14)] + ["deploy-page", "页面部署", "fix"]
    say = lambda a, b: " ".join(rng.choices(words, k=rng.randint(a, b)))
    rows = []
    for k in range(n):
        base = (f"c{k:03d}", say(0, 5), rng.choice(["", "w1 w2", "ops", None]), say(0, 9), [say(1, 2) for _ in range(rng.randint(0, 3))], [say(1, 1) for _ in range(rng.randint(0, 2))], say(0, 4), "")
        rows.append(base)
        if rng.random() < 0.3:  # a near copy
            rows.append((f"d{k:03d}", base[1], base[2], base[3] + " w3", base[4][:2], base[5], base[6], say(0, 1)))
    return spark.createDataFrame(rows, "card_id string, title string, category string, summary string, triggers array<string>, topics array<string>, rule string, body string")


def profiles(df):
    return df.select(F.col("card_id").alias("k"), F.lit("").alias("place"), similarity.profile({c: F.col(c) for c in FIELDS}).alias("card"))


@pytest.mark.parametrize(("seed", "least"), [(1, 64.0), (2, 52.0), (3, 20.0), (4, 90.0)])
def test_join_equals_all_pairs(spark, seed, least):
    rows = profiles(cards(spark, 70, seed)).cache()
    x, y = rows.select(F.col("k").alias("a"), F.col("card").alias("x")), rows.select(F.col("k").alias("b"), F.col("card").alias("y"))
    want = {(r.a, r.b, r.score) for r in x.join(y, F.col("a") < F.col("b")).select("a", "b", similarity.profile_similarity(F.col("x"), F.col("y")).alias("score")).where(F.col("score") >= least).collect()}
    assert {(r.a, r.b, r.score) for r in similarity.similar_pairs(rows, least).collect()} == want and want
    assert similarity.candidate_pairs(rows, least).count() < rows.count() * (rows.count() - 1) / 2


def test_a_category_alone_brings_no_pair(spark):
    one = spark.range(400).selectExpr("cast(id AS string) AS card_id", "concat('title', id) AS title", "'shared category' AS category", "concat('sum', id) AS summary", "array(concat('trigger', id)) AS triggers", "array(concat('topic', id)) AS topics", "'' AS rule", "'' AS body")
    for least in (similarity.COLLAPSE, similarity.HINT):
        assert similarity.candidate_pairs(profiles(one), least).count() == 0
    assert recall.near_cards(one).count() == 0


def test_cards_of_two_libraries_with_one_id(spark):
    have = cards(spark, 20, 7).where("card_id not like 'd%'")
    first = have.where("title <> ''").limit(1)
    other = first.withColumn("title", F.lit("something else")).withColumn("summary", F.lit(""))
    twin = first.withColumn("card_id", F.lit("zz"))
    both = have.unionByName(other).unionByName(twin)
    assert (first.first().card_id, "zz") in {(r.a, r.b) for r in similarity.similar_pairs(profiles(both), 64.0).collect()}
