"""Language ID with any number of languages."""

import random

from pyspark.sql import functions as F

from tessera.llm import language_id

SCHEMA = "doc_id long, text string, lang string"


def corpus(languages, rng):
    """Eight documents of each language, from its syllables."""
    rows = []
    for lang, syllables in languages.items():
        for _ in range(8):
            rows.append((len(rows), " ".join("".join(rng.choices(syllables, k=3)) for _ in range(60)), lang))
    return rows


def test_more_languages_than_a_word_has_bits(spark):
    rng = random.Random(4)
    made = {f"l{k:03}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(6)] for k in range(130)}
    docs = spark.createDataFrame(corpus(made, rng), SCHEMA)
    model = language_id.fit(docs)
    assert model.languages == sorted(made)
    assert all(r["lang_pred"] == r["lang"] for r in language_id.predict(docs, model).collect())


def test_related_languages_are_kept_and_noise_is_not(spark):
    """Spellings of one language share all n-grams, so each has an eighth; texts of no language fall."""
    rng = random.Random(5)
    docs = corpus({f"en-{k}": ["ba", "ke", "lo", "mi", "nu"] for k in range(8)}, rng)
    noise = [(1000, "".join(rng.choices("qxzwvjyfg", k=400)) + " bake", None)]
    kept = language_id.stage(spark, spark.createDataFrame(docs + noise, SCHEMA), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [r[0] for r in docs]


def test_sample_is_the_first_by_hash(spark):
    docs = spark.range(9000).selectExpr("id AS doc_id", "if(id % 9 = 0, 'b', 'a') AS lang")
    got = {r["doc_id"] for r in language_id.sample_ids(docs, {"a": 8000, "b": 1000}, 1500).collect()}
    first = docs.where("lang = 'a'").orderBy(F.xxhash64("doc_id"), "doc_id").limit(1500).collect()
    assert got == {r["doc_id"] for r in first} | {k for k in range(9000) if k % 9 == 0}


def test_repeated_ids_leave_the_sample_whole(spark):
    """400 ids, each 100 times: a sample of 100 documents takes 100 of them, and sees all their n-grams."""
    docs = spark.range(40000).selectExpr("id % 400 AS doc_id", "concat('w', id % 400) AS text", "'a' AS lang")
    known = docs.where(language_id.learnable(F.col("doc_id")))
    assert language_id.sample_ids(known, {"a": known.select("doc_id").distinct().count()}, 100).count() == 100
    want = {r["doc_id"] for r in known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(100).collect()}
    model = language_id.fit(docs, 100)
    grams = {g for k in want for g in language_id.grams_of(f"w{k}").tolist()}
    assert len(grams) * language_id.HASHES >= int((model.slices != 0).sum()) > len(grams)
