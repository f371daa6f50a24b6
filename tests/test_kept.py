"""A kept corpus equals a rebuild after any changes."""

import random

from pyspark.sql import functions as F

from tessera.operators import corpus, kept, recall

def rows(spark, cards):
    df = spark.createDataFrame([(lib, k, t, s) for (lib, k), (t, s) in sorted(cards.items())], "lib string, card_key string, title string, summary string")
    return corpus.field_rows(df, {"title": F.col("title"), "summary": F.col("summary")}, ["lib", "card_key"])


def same(a, b):
    key = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    assert key(a) == key(b)


def test_random_changes_equal_a_rebuild(spark, tmp_path):
    rng, path, have = random.Random(4), str(tmp_path / "kept"), {}
    say = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "a-b", "页面"]) for _ in range(rng.randint(0, 5)))
    scope, query = ["lib"], spark.createDataFrame([("x", 1, "alpha", 1.0), ("x", 1, "beta", 0.5), ("y", 2, "gamma", 1.0)], "lib string, prompt_id int, token string, weight double")
    for step in range(4):
        new = {(rng.choice("xy"), f"c{rng.randint(0, 12)}"): (say(), say()) for _ in range(8 if step != 2 else 0)}
        gone = rng.sample(sorted(have), min(3, len(have)))
        have = {k: v for k, v in have.items() if k not in gone} | new
        removed = spark.createDataFrame([*gone, ("x", "never there")], "lib string, card_key string")
        kept.apply(spark, path, rows(spark, new) if new else None, removed, scope=scope)
        if step == 1:
            kept.compact(spark, path, scope=scope)
            assert len(kept.generations(spark, path)) == 1
        whole = rows(spark, have)
        posted = corpus.postings(whole, ["lib", "card_key"])
        same(kept.document_frequency(spark, path, scope), corpus.document_frequency(posted, scope, "card_key"))
        same(kept.field_lengths(spark, path, scope).drop("total"), corpus.field_lengths(whole, posted, scope))
        same(kept.postings(spark, path, scope=scope), corpus.with_lengths(posted, ["lib", "card_key"]))
        weights = kept.token_weights(spark, path, scope=scope)
        same(corpus.bm25f(query, None, "card_key", scope=scope, kept=weights), corpus.bm25f(query, whole, "card_key", scope=scope))


def test_batches_count_once_and_broken_ones_not(spark, tmp_path):
    path = str(tmp_path / "kept")
    cards = {("x", "a"): ("alpha", ""), ("x", "b"): ("alpha beta", "")}
    for _ in range(2):  # a stream may run a batch again
        assert kept.apply(spark, path, rows(spark, cards), scope=["lib"], number=0) == 0
    kept.apply(spark, path, rows(spark, {("x", "a"): ("gamma", "")}), scope=["lib"], number=1)
    (tmp_path / "kept" / "g=00000001" / "fields" / "_SUCCESS").unlink()  # as if it had failed on its last table
    assert {r.token: r.df for r in kept.document_frequency(spark, path, ["lib"]).collect()} == {"alpha": 2, "beta": 1}
    kept.apply(spark, path, rows(spark, {("x", "a"): ("gamma", "")}), scope=["lib"], number=1)
    kept.compact(spark, path, scope=["lib"])
    kept.compact(spark, path, scope=["lib"])
    assert kept.apply(spark, path, rows(spark, cards), scope=["lib"], number=1) == 1  # already in the base
    assert {r.token: r.df for r in kept.document_frequency(spark, path, ["lib"]).collect()} == {"alpha": 1, "beta": 1, "gamma": 1}


def test_recall_reads_the_kept_corpus(spark, tmp_path):
    cards = spark.createDataFrame([("one", "deploy page check"), ("two", "cache index lock")], "card_id string, title string")
    prompts = spark.createDataFrame([(1, "deploy page check of the cache")], "prompt_id long, text string")
    path = str(tmp_path / "kept")
    listed = recall._recallable(cards)
    kept.apply(spark, path, corpus.field_rows(listed, recall._card_fields(), ["card_key"]))
    key = lambda df: sorted((r.card_key, r.score, r.raw_score) for r in df.collect())
    assert key(recall.match(prompts, cards, corpus_kept=kept.token_weights(spark, path))) == key(recall.match(prompts, cards))
