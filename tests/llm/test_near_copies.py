"""Near copies of the pipeline's stage against plain Jaccard of all pairs."""

import random

import pytest

import corpus_pipeline
from tessera.llm import near_copies, simhash


def plain(rows):
    """Smallest ids of the components of pairs whose five-word shingle sets have a Jaccard of 0.8 or more."""

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    ids = sorted(rows)
    sets, parent = {d: shingles(rows[d]) for d in ids}, {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if not either or 5 * both >= 4 * either:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d for d in ids if find(d) == d}


def edited(words, n, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.random()}"
    return out


@pytest.mark.parametrize("shard", [near_copies.SHARD, 6])
def test_stage_equals_jaccard_of_all_pairs(spark, shard):
    rng = random.Random(3)
    rows = {}
    for k in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(5, 200))]
        rows[10 * k] = " ".join(words)
        for c in range(1, 7):  # from plain copies to texts that are just too different
            rows[10 * k + c] = " ".join(edited(words, min(len(words), rng.randint(0, 1 + len(words) // 30)), rng))
    rows |= {900: None, 901: "", 902: " \n", 903: rows[20].upper()}
    docs = spark.createDataFrame([*rows.items()], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.one_of_each(docs, shard).collect()) == sorted(plain(rows))


def test_stage_keeps_rows_that_only_share_an_id(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(50)) for c in "ab")
    rows = [(1, a, "x", "MINE"), (1, b, "y", "MINE"), (1, a, "x", "MINE"), (2, a + " z", None, "MINE"), (None, b, None, "MINE"), (None, "c d", None, "MINE"), (None, "c d", None, "MINE"), (5, None, None, "MINE"), (4, " ", None, "MINE")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, node string")
    kept = near_copies.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, a, "x", "MINE"), (1, b, "y", "MINE"), (None, "c d", None, "MINE"), (4, " ", None, "MINE")], key=repr)
    assert near_copies.stage(spark, docs.limit(0), "").count() == 0


def test_reworded_copies_leave_one(spark):
    """One of a hundred words differs: 0.83 alike, yet more than three bits of a fingerprint apart."""
    words = [f"w{k}" for k in range(100)]
    texts = [" ".join(words), " ".join([*words[:50], "x", *words[51:]]), " ".join([*words[:20], "y", *words[21:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert [r["doc_id"] for r in stage(spark, docs, "").collect()] == [0]
    assert simhash.with_components(docs).select("sim_component").distinct().count() > 1
