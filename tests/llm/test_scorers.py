"""Toxicity, language ID and licence scans."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id, license_scan, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, extra string"
SYLLABLES = {"xa": ["ba", "ke", "lo", "mi", "nu"], "yb": ["tra", "ght", "schu", "pre", "wor"]}


def say(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for k in range(400):
        lang = "xa" if k % 3 else "yb"
        words = say(lang, rng.randint(5, 80), rng).split()
        toxic = k % 4 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(["grimble", "fouzle", "snarkan", "snarkel", "snarko"]))
        rows.append((k, " ".join(words), lang, None, "x"))
        labels.append((k, None, int(toxic)))
    rows += [(1000, None, None, "s", None), (1001, "", "xa", "s", None), (1002, "123 ... !!", "xa", None, None), (None, "ba ke lo", "xa", None, None), (None, None, None, None, None)]
    rows += [(1003, say("xa", 60000, rng), "xa", "s", "long"), (5, rows[5][1], "xa", None, "repeated")]
    labels += [(None, 1, 1), (3, 1, None), (1000, None, 0), (1001, None, 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(3)
    model = toxicity.ToxicityModel(trans=rng.normal(size=(2, 2)), start=0.4)
    lens = np.array([0, 1, 700, 128, 129, 0])
    e = rng.normal(size=int(lens.sum())) * 3
    got = toxicity.forward_backward(e, lens, model)[2]
    a, expected, at = np.exp(model.trans), [], 0
    for n in lens:
        part = e[at : at + n]
        at += n
        f, b = np.zeros((n, 2)), np.ones((n, 2))
        for t in range(n):
            f[t] = (np.array([1, np.exp(model.start)]) if t == 0 else f[t - 1] @ a) * [1, np.exp(part[t])]
            f[t] /= f[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = a @ (b[t + 1] * [1, np.exp(part[t + 1])])
            b[t] /= b[t].sum()
        if n:
            expected.append((f * b)[:, 1] / (f * b).sum(1))
    assert np.abs(got - np.concatenate(expected)).max() < 1e-9


def test_toxicity_learns_words_and_stems(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.withColumn("tox_score", F.lit("clash")), model).collect()
    assert len(rows) == docs.count() and set(docs.columns) <= set(rows[0].asDict())
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] < 400:
            assert r["tox_predicted"] == int(r["doc_id"] % 4 == 0)
            for span in filter(None, r["tox_spans"].split(",")):
                a, b = map(int, span.split("-"))
                assert all(w[:5] in ("grimb", "fouzl", "snark") for w in r["text"].lower()[a:b].split())
        assert 0 <= r["tox_score"] <= 1
    empty = [r for r in rows if not r["text"]]
    assert len(empty) == 3 and len({r["tox_score"] for r in empty}) == 1 and empty[0]["tox_predicted"] == 0


def test_toxicity_without_labels_or_rows(spark, corpus):
    docs, labels = corpus
    none = labels.limit(0)
    assert {r["tox_score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_language_held_out_accuracy_and_edge_rows(corpus):
    docs, _ = corpus
    model = language_id.fit(docs)
    rows = language_id.predict(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if not r["text"] or not re.search(r"[^\W\d_]", r["text"]):
            assert (r["lang_pred"], r["lang_score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == (r["lang"] if r["lang"] else r["lang_pred"]) and 0 <= r["lang_score"] <= 1
    assert language_id.predict(docs.limit(0), language_id.fit(docs.limit(0))).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.LanguageFilters()).collect()} == {"und"}


def test_bit_sliced_lookup_returns_all_languages():
    grams = {"a": np.arange(1, 3000, dtype=np.uint64), "b": np.arange(2000, 5000, dtype=np.uint64), "c": np.array([7], np.uint64)}
    model = language_id.build(["a", "b", "c"], grams)
    masks = model.lookup(np.arange(1, 9000, dtype=np.uint64))
    for k, lang in enumerate("abc"):
        inside = np.isin(np.arange(1, 9000), grams[lang])
        hit = masks >> k & 1 == 1
        assert hit[inside].all()
        assert abs(hit[~inside].mean() - model.false_positive[k]) < 0.02


def _plain_scan(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        found = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan_equals_plain_search(spark):
    rng = random.Random(1)
    parts = [*license_scan.BASE, *license_scan.MORE, "mit", "cc", "by", "license", "MIT-License", "é", "—", "gnu general", "x", "CC BY"]
    texts = [None, "", "...", "cc by cc by mit license", "a" * 100_000 + " mit license"] + [rng.choice([" ", ", ", "\n", "é "]).join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "mit license", 2)], "doc_id long, text string, score int")
    rows = license_scan.scan_licenses(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == _plain_scan(r["text"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("line", "labels", "value"),
    [
        ("MIT", {"mit"}, 1.0),
        ("GPL-2.0-only OR MIT", {"gpl", "mit"}, 1.0),
        ("GPL-2.0-only AND MIT", {"gpl", "mit"}, 0.3),
        ("MIT OR Apache-2.0 AND GPL-3.0", {"mit", "apache", "gpl"}, 1.0),
        ("(MIT OR Apache-2.0) AND GPL-3.0", {"mit", "apache", "gpl"}, 0.3),
        ("GPL-2.0 WITH Classpath-exception-2.0 rest of line", {"gpl"}, 0.4),
        ("Strange-1.0", set(), 0.4),
        ("mitre-custom", set(), 0.4),
        ("apachefoo OR MITx", set(), 0.4),
        ("Apache2", {"apache"}, 0.95),
        ("GPLv3+", {"gpl"}, 0.3),
        ("LGPL-2.1-or-later", {"lgpl"}, 0.5),
        ("BSD-3-Clause\nOR MIT", {"bsd"}, 1.0),
        ("((MIT", {"mit"}, 1.0),
        ("or and", None, None),
    ],
)
def test_licence_expressions(line, labels, value):
    found = license_scan.evaluate(line.split("\n")[0])
    assert found is None if labels is None else (found[0] == labels and found[1] == pytest.approx(value))


def test_training_gradient_equals_differences_of_the_likelihood():
    """Runs of unmarked tokens as matrix powers against a plain token-by-token forward pass."""
    rng = np.random.default_rng(5)
    counts = np.array([0, 3, 1, 0, 40])
    n = int(counts.sum())
    data = toxicity.Marked(counts, rng.integers(0, 30, n) * rng.integers(0, 2, n), np.array([5, 0, 700, 0, 2]), np.zeros((n, 1), np.int32), rng.integers(0, 2, n))
    trans, bias, e = rng.normal(size=(2, 2)), -0.7, rng.normal(size=n)

    def sequences():
        at = 0
        for c, rest in zip(counts, data.ends, strict=True):
            marks, tags = [], []
            for k in range(at, at + c):
                marks += [None] * data.before[k] + [k]
                tags += [0] * data.before[k] + [int(data.tags[k])]
            at += c
            yield marks + [None] * rest, tags + [0] * rest

    def log_z(trans, bias, e):
        total = 0.0
        for marks, _ in sequences():
            v = np.array([1.0, 0.0])
            for k in marks:
                v = (v @ np.exp(trans)) * [1, np.exp(bias if k is None else e[k])]
                total += np.log(v.sum())
                v = v / v.sum()
        return total

    p, expected = toxicity.gradient(data, e, bias, trans)
    h = 1e-5
    for i in range(2):
        for j in range(2):
            up, down = trans.copy(), trans.copy()
            up[i, j] += h
            down[i, j] -= h
            assert expected[i, j] == pytest.approx((log_z(up, bias, e) - log_z(down, bias, e)) / (2 * h), rel=1e-4, abs=1e-4)
    for k in range(0, n, 7):
        up, down = e.copy(), e.copy()
        up[k] += h
        down[k] -= h
        assert p[k] == pytest.approx((log_z(trans, bias, up) - log_z(trans, bias, down)) / (2 * h), abs=1e-4)
    free = (log_z(trans, bias + h, e) - log_z(trans, bias - h, e)) / (2 * h)
    assert expected[:, 1].sum() - p.sum() == pytest.approx(free, rel=1e-4, abs=1e-4)
    seen = np.zeros((2, 2))
    for _, tags in sequences():
        for a, b in zip([0, *tags], tags, strict=False):
            seen[a, b] += 1
    assert (toxicity._seen(data) == seen).all()


def test_plain_texts_equal_the_whole_scan():
    model = toxicity.ToxicityModel({"bad": 6.0}, -3.0, np.array([[0.0, -1.0], [-1.0, 1.0]]), -1.0, np.zeros(3))
    texts = ["a b c", "", None, "a " * 700, "a bad c", "x"]
    p, lens, top, mass = toxicity._marginals(texts, model, toxicity.Emissions(model))
    assert lens.tolist() == [0, 0, 0, 0, 3, 0] and len(p) == 3
    for k, t in enumerate(texts):
        words = (t or "").split()
        e = np.array([model.bias + model.weights.get(w, 0.0) for w in words])
        q = toxicity.forward_backward(e, np.array([len(e)]), model)[2]
        assert mass[k] == pytest.approx(np.log1p(q[q >= 0.1].sum()))
        assert top[k] == pytest.approx(max(-1.0, np.log(q.max() / (1 - q.max())) / 10) if len(q) else -1.0)


def test_rare_toxic_words_of_a_large_vocabulary_are_learned(spark):
    """More distinct words than any table of frequent ones would hold; the toxic words occur in six documents only."""
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(240):
        words = [f"{rng.getrandbits(40):x}" for _ in range(500)]
        toxic = k % 12 == 0
        if toxic:
            words[rng.randrange(500)] = "vexling"
        rows.append((k, " ".join(words), None, None, None))
        labels.append((k, None, int(toxic)))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r["doc_id"] for r in toxicity.score(docs, model).where("tox_predicted = 1").collect()} == {k for k in range(0, 240, 12)}


def test_toxicity_stage_keeps_clashing_columns_and_rejects_nothing_unlearned(corpus, tmp_path):
    docs, labels = corpus
    docs = docs.withColumn("tox_predicted", F.lit("MINE")).withColumn("tox_score", F.lit(None).cast("string"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = toxicity.stage(docs.sparkSession, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r["tox_predicted"] for r in kept.collect()} == {"MINE"}
    assert {r["doc_id"] for r in kept.where("doc_id < 400").collect()} == {k for k in range(400) if k % 4}
    labels.where("toxic = 1").write.parquet(f"{tmp_path}/one/labels.parquet")
    assert toxicity.stage(docs.sparkSession, docs, f"{tmp_path}/one").count() == docs.count()


def test_held_out_labels_change_nothing(corpus, tmp_path):
    docs, labels = corpus
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = []
    for flip in (False, True):
        held = toxicity.held_out(F.col("doc_id"))
        labels.withColumn("toxic", F.when(held & F.lit(flip), 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        found.append(sorted(map(tuple, toxicity.query(docs.sparkSession, str(tmp_path)).collect()), key=repr))
    assert found[0] == found[1]
    known = [(r[0], r[3]) for r in found[0] if r[0] is not None and r[0] < 400 and r[1]]
    assert len(known) > 50 and all(p == int(d % 4 == 0) for d, p in known)
    assert all(r[3] == int(r[2] >= 0.3) for r in found[0])


def test_license_query_equals_plain_labels_and_scores(spark, tmp_path):
    """Tags, expressions over two lines and notices of whole texts, against a plain reading."""
    rows = [
        (1, "SPDX-License-Identifier: MIT OR GPL-2.0-only\nrest", "gpl,mit", 1.0),
        (2, "// spdx license identifier = Apache-2.0 AND mitre-custom", "apache", 0.4),
        (3, "SPDX-License-Identifier: MIT AND\nGPL-3.0", "mit", 1.0),  # an expression ends with its line
        (4, "License-Expression: (MIT OR BSD-2-Clause) AND LGPL-3.0\n under the GNU General Public License", "bsd,gpl,lgpl,mit", 0.3),
        (5, "All rights reserved. MIT License", "mit,reserved", 0.0),
        (6, "nothing here", "", 0.0),
        (7, None, "", 0.0),
        (8, "spdx license identifier", "", 0.0),
        (9, "x " * 30000 + "cc by", "cc-by", 0.9),
    ]
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in license_scan.query(spark, str(tmp_path)).collect()}
    assert got == {r[0]: r[2:] for r in rows}


def _plain_language(text, sets, order):
    """Which language's sample holds most of the text's n-grams, with plain sets in place of filters."""
    if not text or not re.search(r"[^\W\d_]", text):
        return "und"
    raw = b" " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()) + b"   "
    grams = [raw[k : k + 4] for k in range(len(raw) - 3)]
    held = {lang: sum(g in s for g in grams) for lang, s in sets.items()}
    return max(order, key=lambda lang: held[lang])  # the first of equals


def test_language_query_equals_plain_sets_and_ignores_held_out_rows(corpus, tmp_path):
    docs, _ = corpus
    spark = docs.sparkSession
    found = []
    for flip in (False, True):
        held = language_id.held_out(F.col("doc_id"))
        docs.withColumn("lang", F.when(held & F.lit(flip), F.lit("zz")).otherwise(F.col("lang"))).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        found.append(sorted(map(tuple, language_id.query(spark, str(tmp_path)).collect()), key=repr))
    assert found[0] == found[1] and len(found[0]) == docs.count()
    rows = docs.withColumn("held", language_id.held_out(F.col("doc_id"))).collect()
    sets, sizes = {}, {}
    for r in rows:
        if r["doc_id"] is not None and not r["held"] and r["lang"] is not None:
            sizes[r["lang"]] = sizes.get(r["lang"], 0) + 1
            raw = b" " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in (r["text"] or "").lower().encode()) + b"   "
            if r["text"] and re.search(r"[^\W\d_]", r["text"]):
                sets.setdefault(r["lang"], set()).update(raw[k : k + 4] for k in range(len(raw) - 3))
    order = sorted(sizes, key=lambda lang: (-sizes[lang], lang))
    said = {(r["doc_id"], r["text"]): _plain_language(r["text"], sets, order) for r in rows}
    assert {(d, lang) for d, _, lang, _ in found[0]} == {(d, lang) for (d, _), lang in said.items()}


def test_filters_hold_every_gram_of_a_large_sample(spark):
    """More distinct n-grams than any table of frequent ones would hold, each seen once."""
    rng = random.Random(6)
    texts = {lang: ["".join(rng.choices(letters, k=30_000)) for _ in range(10)] for lang, letters in (("a", "abcdefghijklmnopqrstuvwxyz"), ("b", "éèêëàâôûùïü"))}
    rows = [(k + 100 * (lang == "b"), t, lang, None, None) for lang, ts in texts.items() for k, t in enumerate(ts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fit(docs)
    learned = {r["doc_id"] for r in docs.where(language_id.learnable(F.col("doc_id"))).collect()}
    for lang, k in (("a", 0), ("b", 1)):
        for j, t in enumerate(texts[lang]):
            if j + 100 * (lang == "b") in learned:
                assert (language_id._bit(model.lookup(language_id.grams_of(t)), k) != 0).all()


def test_language_stage_keeps_clashing_columns(corpus):
    docs, _ = corpus
    docs = docs.withColumn("lang_pred", F.lit("MINE")).withColumn("lang_rate", F.lit(0.0))
    kept = language_id.stage(docs.sparkSession, docs, "")
    assert kept.columns == docs.columns and {r["lang_pred"] for r in kept.collect()} == {"MINE"}
    assert kept.where("text is null or text = ''").count() == 0 and kept.where("doc_id < 400").count() == docs.where("doc_id < 400").count()
