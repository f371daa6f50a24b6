"""URL filters, chat formatting, SimHash, MinHash, mixing, packing, media and the pipeline."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat_format, gif_media, graph, language_id, minhash, mixing, packing, registry, simhash, toxicity, url_filters
from tests.llm.test_near_copies import plain

SF = "/root/testdata/sf0.001"


def words(n, rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    base = [words(rng.randint(1, 120), rng) for _ in range(150)]
    rows = [(k, t, rng.choice(["s1", "s2", "s3", None, "Z"]), "x", 0.5) for k, t in enumerate(base)]
    rows += [(200 + k, base[3] + " tail" * (k % 3), "s1", "x", 0.1) for k in range(40)]
    rows += [(300, None, None, None, None), (301, "", "s1", None, None), (302, " \t\n ", "s2", None, None), (303, "onlyone", "s2", None, None)]
    rows += [(7, base[7], "s1", "repeat", None), (None, base[9], "s2", None, None), (None, None, None, None, None), (400, words(30000, rng), "s3", "long", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, rank double")


def duck(sql, **frames):
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(name, frame)
    return con.sql(sql).df()


def same(spark_df, pandas_df):
    key = lambda rows: sorted((tuple(None if v is None or v != v else v for v in r) for r in rows), key=repr)
    columns = sorted(spark_df.columns)
    assert columns == sorted(pandas_df.columns)
    left = [tuple(r) for r in spark_df.select(*columns).collect()]
    right = [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in pandas_df[columns].astype(object).where(pandas_df[columns].notna(), None).itertuples(index=False)]
    assert len(left) == len(right)
    norm = lambda rows: key([tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows])
    assert norm(left) == norm(right)


# ------------------------------------------------------------------ graph


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5200)] + [(9, 9), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "x long, y long")).count() == 0


@pytest.mark.parametrize("edges", [[(k, k + 1) for k in range(999)], [(5000, k) for k in range(1000)], [((k - 1) // 2, k) for k in range(1, 1000)]])
def test_rounds_grow_with_the_logarithm_of_a_chain(spark, edges):
    began = []
    found = graph.components(spark.createDataFrame(edges, "x long, y long"), began)
    assert {r["component"] for r in found.collect()} == {0}
    assert len(began) <= 12
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 500


def test_components_of_names_and_lone_loops(spark):
    found = graph.components(spark.createDataFrame([("b", "b"), ("c", "d"), ("d", "d"), ("z", None)], "x string, y string"))
    assert {tuple(r) for r in found.collect()} == {("b", "b"), ("c", "c"), ("d", "c")}


# ------------------------------------------------------------------ URL filters


def link(to):
    return f'<html><head><link rel="canonical" href="{to}"></head></html>'


def test_redirect_equivalence_and_precedence(spark):
    rows = [
        (1, "http://a.com/en/1", link("http://b.fr/x")),  # blocked, carries to b.fr/x and on
        (2, "http://b.fr/x#frag", None),
        (3, "http://c.fr/y", '<meta http-equiv="refresh" content="0; url=http://B.fr/x">'),
        (4, "http://d.org/es/1", link("/z")),  # blocked itself, d.org/z is an alias
        (5, "http://d.org/z", link("http://n.net/de/1")),  # and so is an explicitly allowed page: no spread
        (6, "http://n.net/de/1", ""),
        (7, "http://lone.fr/", link("http://lone.fr/")),
        (8, None, link("http://a.com/en/1")),
        (9, "no scheme", link("http://a.com/en/1")),
        (9, "no scheme", link("http://a.com/en/1")),
        (10, "HTTP://Shop.EXAMPLE.com/en/75?q=/en/", None),
        (11, "ftp://xcom/en/1", None),
    ]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, own string, rule string")
    rules = spark.createDataFrame([*url_filters.RULES], "verdict string, host string, prefix string")
    out = url_filters.judge(pages, rules)
    got = {(r["page_id"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got == {
        (1, "com/en/", "block"), (2, None, "block"), (3, None, "block"), (4, "org/es/", "block"), (5, None, "allow"), (6, "net/de/", "allow"),
        (7, None, "allow"), (8, None, "allow"), (9, None, "allow"), (10, "example.com/en/7", "allow"), (11, None, "allow"),
    }
    assert out.count() == len(rows)
    same(out.select("page_id", "host", "path", "rule", "verdict"), duck(url_filters.ORACLE_SQL, pages=pages.toPandas()))
    assert url_filters.judge(pages.limit(0), rules).count() == 0
    hostile = spark.createDataFrame([(1, "http://" + "a." * 100_000 + "com/en/1", None)], "page_id long, url string, html string")
    assert [(r["rule"], r["verdict"]) for r in url_filters.judge(hostile, rules).collect()] == [("com/en/", "block")]
    assert [r["verdict"] for r in url_filters.judge(hostile, rules.limit(0)).collect()] == ["allow"]
    more = spark.createDataFrame([("http://lone.fr/", "http://a.com/en/9")], "from string, to string")
    assert {r["verdict"] for r in url_filters.judge(pages, rules, more).where("page_id = 7").collect()} == {"block"}


# ------------------------------------------------------------------ chat formatting


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, "message", 10, "user", "hi"), (1, 2, "message", 11, "assistant", ""), (1, 4, "delta", 11, None, "lo"), (1, 3, "delta", 11, None, "hel"),
        (1, 5, "regenerate", 11, None, "ignored"), (1, 6, "delta", 11, None, "good"), (1, 7, "delta", 11, None, " day"), (1, 8, "edit", 10, None, "hello"),
        (1, 9, "message", 12, "tool", "gone"), (1, 10, "delete", 12, None, None), (2, 1, "delta", 1, "assistant", "x"), (None, 1, "message", 1, "user", None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, event string, message_id long, role string, text string")
    got = {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in chat_format.fold(events).collect()}
    assert got == {1: [("user", "hello"), ("assistant", "good day")], 2: [("assistant", "x")], None: [("user", "")]}


def test_fold_of_repeated_tied_and_unknown_events(spark):
    log = [
        (1, 1, "message", 1, "user", "hi"), (1, 1, "message", 1, "user", "hi"),  # repeated by the log
        (2, 1, "message", 1, "user", "a"), (2, 2, "delta", 1, None, "b"), (2, 2, "delta", 1, None, "b"),
        (3, 1, "edit", 1, "user", "new"), (3, 1, "message", 1, "user", "old"), (3, 1, "delta", 1, "user", "!"),  # one sequence, several kinds
        (4, 1, "message", 1, "user", "kept"), (4, 2, None, 1, "user", "?"), (4, 3, "what", 1, "user", "?"),
        (5, 1, "message", 1, "user", "x"), (5, 2, "delete", 1, None, None), (5, 3, "delta", 1, None, "late"),
        (6, 1, "message", 1, "user", "x"), (6, 2, "delete", 1, None, None), (6, 3, "message", 1, None, "again"),
        (7, 1, None, 1, "user", "alone"), (8, None, "message", None, None, None), (8, 2, "message", 2, "tool", "z"),
    ]
    events = spark.createDataFrame([(*r, "clash") for r in log], "conv_id long, seq long, event string, message_id long, role string, text string, kind string").withColumn("m", F.lit(1))
    got = {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in chat_format.fold(events).collect()}
    assert got == {1: [("user", "hi")], 2: [("user", "ab")], 3: [("user", "new!")], 4: [("user", "kept")], 6: [("user", "again")], 8: [("", ""), ("tool", "z")]}
    named = chat_format.digests(chat_format.render(chat_format.fold(events.withColumn("conv_id", F.concat(F.lit("c"), "conv_id")))))
    assert {r["conv_id"] for r in named.collect()} == {f"c{k}" for k in got}


def test_template_reads_back_any_text(spark):
    rng = random.Random(4)
    bits = ["[INST] ", " [/INST]", "</s>", "\\", "<<ROLE ", ">> ", " <</SYS>>", "a", "\n", " ", "é", "\\[", "<<SYS>> "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "a>> b"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) or None) for c in range(30) for t in range(rng.randint(1, 6))]
    rows += [(0, 0, "user", "same"), (0, 0, "user", "same"), (31, None, "assistant", "y" * 200_000), (None, 1, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    rendered = chat_format.render(chat_format.fold(chat_format.as_events(turns))).collect()
    for r in rendered:
        back = chat_format.read_back(r["formatted"])
        assert [(m["role"], m["text"]) for m in r["messages"]] == [(role, text) for role, text, _, _ in back]
    assert sum(len(r["messages"]) for r in rendered) == len(rows)
    got = chat_format.digests(chat_format.render(chat_format.fold(chat_format.streamed(chat_format.as_events(turns))))).where("conv_id is not null")
    same(got, duck(chat_format.ORACLE_SQL, conversations=turns.where("conv_id is not null").toPandas().astype({"turn": "Int64"})).query("conv_id >= 0"))
    assert chat_format.fold(chat_format.as_events(turns.limit(0))).count() == 0


# ------------------------------------------------------------------ SimHash


def test_fingerprint_by_definition():
    rng = random.Random(9)
    for text in [None, "", " \n", "One", "two words", "A b C", words(700, rng), "x y z " * 50]:
        w = text.encode().lower().split() if text else []
        shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        value = sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) > len(shingles))
        assert simhash.fingerprint(text) & (1 << 64) - 1 == value


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(1)
    values = {rng.getrandbits(16) for _ in range(600)}
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in list(values)[:50]:
        assert sorted(tree.search(q, 3)) == sorted(v for v in values if (v ^ q).bit_count() <= 3)


@pytest.mark.parametrize("shard", [simhash.SHARD, 20])
def test_links_join_all_near_fingerprints(spark, shard):
    rng = random.Random(11)
    values = [rng.getrandbits(64) for _ in range(150)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for v in values for _ in range(2)]
    values += [values[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20, 40)]  # a dense group
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), shard)
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {v: got.get(v, v) for v in values} == {v: find(v) for v in values}


def test_simhash_components_and_stage(spark, docs):
    rows = simhash.with_components(docs).collect()
    assert len(rows) == docs.count()
    by_fp = {}
    for r in rows:
        by_fp.setdefault(r["sim_fp"], set()).add(r["sim_component"])
    assert all(len(c) == 1 for c in by_fp.values())
    assert {r["sim_component"] for r in rows if not (r["text"] or "").strip()} == {300}
    assert simhash.with_components(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ MinHash


def _plain_minhash(text):
    def mixed(values, kind):  # Spark chains the columns of a hash, each seeds the next
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v.encode(), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    w = [x for x in text.lower().replace("\n", " ").replace("\t", " ").split(" ") if x]
    hashes = sorted(mixed(w[k : k + 5], 0) for k in range(len(w) - 4)) if len(w) >= 5 else [mixed([" ".join(w)], 0)]
    bins = [None] * minhash.BINS
    for h in hashes:
        b = (h >> (64 - minhash.BIN_BITS)) + minhash.BINS // 2
        bins[b] = h if bins[b] is None else bins[b]
    drawn = [zlib.crc32(f"bin {b}".encode()) for b in range(minhash.BINS)]
    out = []
    for b in range(minhash.BINS):
        h, t = bins[b], 0
        while h is None:
            h = bins[(drawn[b] % minhash.BINS + t * (drawn[b] // minhash.BINS % minhash.BINS | 1)) % minhash.BINS]
            t += 1
        out.append(h & 255)
    return out


def test_minhash_query_equals_plain_version(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(minhash, "RANGES_PER_TASK", 3)
    docs = docs.unionByName(docs.where("doc_id < 40").withColumn("doc_id", F.lit(250).cast("long")))  # an id that fills several ranges
    docs.withColumn("n_chars", F.length("text")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = minhash.query(spark, str(tmp_path)).collect()

    def hashed(text):
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    order = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (-x[0] if x[0] is not None else 1 << 63, hashed(x[1]), x[1]))
    expected = []
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        a, b, c = _plain_minhash(text), _plain_minhash(edited), _plain_minhash(following)
        near = lambda x, y: max(0.0, (sum(p == q for p, q in zip(x, y, strict=True)) / 128 - 1 / 256) / (255 / 256))
        expected.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), bytes(a).hex(), bytes(b).hex(), round(near(a, b), 9), round(near(a, c), 9)))
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in rows]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_minhash_estimates_likeness(spark):
    rng = random.Random(8)
    pairs = []
    for k in range(60):
        a = words(400, rng).split()
        keep = rng.random()
        b = a[: int(400 * keep)] + words(400 - int(400 * keep), rng).split()
        sa, sb = ({tuple(x[i : i + 5]) for i in range(396)} for x in (a, b))
        pairs.append((k, " ".join(a), " ".join(b), len(sa & sb) / len(sa | sb)))
    df = minhash.fingerprints(minhash.fingerprints(spark.createDataFrame(pairs, "doc_id long, text string, other string, true double")), "other", "fp2")
    errors = [r[0] - r[1] for r in df.select(minhash.likeness(F.col("fp"), F.col("fp2")), "true").collect()]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_minhash_single_row_and_empty_table(spark):
    one = minhash.with_next(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["next_text"] == "a b c" and one[0]["next_fp"] == one[0]["fp"]
    assert minhash.with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(50)], "doc_id long, text string")
    for ranges in (1, 2, 200):  # plans hold a bound for each range, never for each row
        assert {(r["doc_id"], r["next_text"]) for r in minhash.with_next(rows, ranges).collect()} == {(k, f"t{(k - 1) % 50}") for k in range(50)}


# ------------------------------------------------------------------ mixing


def test_mixing_equals_sql_and_meets_targets(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKETS", 8)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.query(spark, str(tmp_path))
    same(got, duck(mixing.ORACLE_SQL, documents=docs.toPandas().astype({"doc_id": "Int64"})))
    again = mixing.query(spark, str(tmp_path))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, again.collect()))
    mixed = mixing.mix(docs)
    assert mixed.count() == docs.count() and {"size", "rank"} <= set(mixed.columns)
    assert mixed.where("mix_taken > 2 * mix_size").count() == 0
    taken = mixed.groupBy("source").agg(F.sum("mix_taken").alias("t"), F.max("mix_target").alias("target"), F.max("mix_size").alias("largest"))
    assert all(abs(r["t"] - r["target"]) <= r["largest"] for r in taken.collect())
    copies = mixing.stage(spark, docs, SF)
    assert copies.columns == docs.columns and copies.count() == mixed.agg(F.sum("mix_copies")).first()[0]
    assert mixing.mix(docs.limit(0)).count() == 0
    clashing = docs.withColumn("mix_copies", F.lit("MINE")).withColumn("target", F.lit("MINE"))
    assert {(r["mix_copies"], r["target"]) for r in mixing.stage(spark, clashing, SF).collect()} == {("MINE", "MINE")}


@pytest.mark.parametrize(("weights", "share"), [((3, 1, 2), 1.5), ((1,), 2.0), ((5, 1), 0.01), ((1, 9), 1.99), ((2, 3), 5.0)])
def test_targets_fill_up_like_plain_water(spark, weights, share):
    rng = random.Random(12)
    rows = [(f"={k:03}", f"{k:03}", rng.choice([0, 1, 7, 7, 300, 5000, 10**9]) * (1 + k % 2)) for k in range(70)] + [("", None, 40)]
    sizes = spark.createDataFrame(rows, "skey string, source string, size long")
    got = {r["skey"]: r["target"] for r in mixing.source_targets(sizes, weights, share).collect()}
    weight = {key: weights[k % len(weights)] for k, (key, _, _) in enumerate(rows)}
    size = {key: n for key, _, n in rows}
    low, high = 0.0, 1e12
    for _ in range(200):  # the level by bisection
        level = (low + high) / 2
        low, high = (level, high) if sum(min(weight[k] * level, 2 * size[k]) for k in size) < share * sum(size.values()) else (low, level)
    assert got == pytest.approx({k: min(weight[k] * high, 2.0 * size[k]) for k in size}, rel=1e-6)


# ------------------------------------------------------------------ packing


def check_packed(rows, expected):
    """``expected``: list of (doc_id, ids); every document is packed whole, sequences are gapless."""
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    wanted = {}
    for doc_id, ids in expected:
        for k, (start, length) in enumerate(packing.cut(len(ids))):
            wanted.setdefault(doc_id, []).append((k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
    assert {d: sorted(p) for d, p in by_doc.items()} == {d: sorted(p) for d, p in wanted.items()}
    return len(by_sequence)


def test_packing_is_whole_and_tight(spark, docs, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "PER_TASK", 5)
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    special = spark.createDataFrame([(500, "a<|endoftext|>b x’s \n\n 中文 123", None, None, None)], docs.schema)
    docs = docs.unionByName(special).repartition(3)
    expected = [(r["doc_id"], [*(tokenizer.encode(r["text"], add_special_tokens=False).ids if r["text"] else []), 0]) for r in docs.collect()]
    n = check_packed(packing.pack(docs).collect(), expected)
    assert n <= 1.05 * sum(len(ids) for _, ids in expected) / packing.CAPACITY + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_sequences_that_nothing_fits_do_not_pile_up(spark, monkeypatch):
    """Every document fills 60 % of a sequence: no two fit, and each merging task hands on a bounded number."""
    monkeypatch.setattr(packing, "PER_TASK", 3)
    docs = spark.createDataFrame([(k, "a " * 1227) for k in range(60)], "doc_id long, text string").repartition(12)
    rows = packing.pack(docs).collect()
    assert {r["doc_id"] for r in packing.pack(docs.limit(3).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))).collect()} <= {f"d{k}" for k in range(60)}
    ids = packing.token_ids("a " * 1227, packing.default_tokenizer())
    assert 1100 < len(ids) < 1400 and check_packed(rows, [(k, ids.tolist()) for k in range(60)]) == 60


def test_sequences_set_aside_still_meet(spark, monkeypatch):
    """Two tasks of one block each: what the emptiest crowd out of the merge fits into it by classes."""
    sizes = [1400] * 40 + [600] * 40 + [30] * 60
    monkeypatch.setattr(packing, "PER_TASK", 2)
    monkeypatch.setattr(packing, "BLOCK", 1)
    monkeypatch.setattr(packing, "token_ids", lambda text, path: np.arange(int(text), dtype="<u4"))
    docs = spark.createDataFrame([(k, str(n)) for k, n in enumerate(sizes)], "doc_id long, text string").repartition(7)
    rows = packing.pack(docs).collect()
    assert check_packed(rows, [(k, list(range(n))) for k, n in enumerate(sizes)]) <= 42


def test_best_fit_of_classes_equals_best_fit():
    rng = random.Random(4)
    for _ in range(300):
        counts = {rng.randint(1, 99): rng.randint(1, 50) for _ in range(rng.randint(1, 12))}
        plan = packing.best_fit_classes(counts, 100)
        packed = {}
        for sizes, n in plan:
            assert sum(sizes) <= 100 and n > 0
            for size in sizes:
                packed[size] = packed.get(size, 0) + n
        assert packed == counts
        plain = packing.best_fit([s for s, n in counts.items() for _ in range(n)], 100)
        assert sum(n for _, n in plan) <= 1.02 * len(plain) + 1


def test_best_fit_against_search():
    rng = random.Random(3)
    for _ in range(20):
        sizes = [rng.randint(1, 50) for _ in range(60)]
        free, plain = [], []
        for k in sorted(range(60), key=lambda k: -sizes[k]):
            fit = [(f, b) for b, f in enumerate(free) if f >= sizes[k]]
            if fit:
                free[min(fit)[1]] -= sizes[k]
            else:
                free.append(50 - sizes[k])
        plain = len(free)
        bins = packing.best_fit(sizes, 50)
        assert sorted(k for b in bins for k in b) == list(range(60)) and all(sum(sizes[k] for k in b) <= 50 for b in bins) and len(bins) == plain
    assert packing.cut(1) == [(0, 1)] and packing.cut(2048) == [(0, 2048)] and packing.cut(4100) == [(0, 4), (4, 2048), (2052, 2048)]


# ------------------------------------------------------------------ media


def test_lzw_round_trip():
    rng = random.Random(6)
    for n in (0, 1, 2, 3, 300, 5000, 60000):
        for alphabet in (b"a", b"ab", bytes(range(256))):
            data = bytes(rng.choice(alphabet) for _ in range(n))
            assert gif_media.lzw_decode(gif_media.lzw_encode(data), 8, n) == data


def _gif(frames, palette, width=4, height=4):
    out = [b"GIF89a", np.array([width, height], "<u2").tobytes(), bytes([0x80 | 1, 0, 0]), bytes(palette)]
    for (left, top, w, h), samples, disposal, transparent, delay, interlaced in frames:
        flags = disposal << 2 | (transparent is not None)
        out.append(b"\x21\xf9\x04" + bytes([flags]) + np.array([delay], "<u2").tobytes() + bytes([transparent or 0, 0]))
        out.append(b"\x2c" + np.array([left, top, w, h], "<u2").tobytes() + bytes([0x40 * interlaced, 2]))
        stream = gif_media.lzw_encode(bytes(samples), 2)
        out += [bytes([len(stream)]), stream, b"\0"]
    return b"".join(out) + b"\x3b"


def test_disposal_transparency_and_interlace():
    palette = [0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255]
    whole = (0, 0, 4, 4)
    small = (1, 1, 2, 2)
    data = _gif([(whole, [1] * 16, 1, None, 5, 0), (small, [2, 3, 3, 2], 3, 3, 6, 0), (small, [3] * 4, 2, None, 7, 0), (whole, [3, 3, 3, 3] + [1] * 8 + [2] * 4, 0, 3, 8, 1)], palette)
    frames = list(gif_media.decode(data)[0])
    shown = [[["krgb"[int(np.argmax(np.append(0, p))) if p.any() else 0] for p in row] for row in f.rgb] for f in frames]
    text = ["/".join("".join(row) for row in f) for f in shown]
    assert [f.delay for f in frames] == [5, 6, 7, 8]
    assert text[0] == "rrrr/rrrr/rrrr/rrrr"
    assert text[1] == "rrrr/rgrr/rrgr/rrrr"  # transparent samples show the canvas
    assert text[2] == "rrrr/rbbr/rbbr/rrrr"  # the frame before was undone
    # the frame before was cleared to the background; rows of an interlaced frame come as 0, 2, 1, 3
    assert text[3] == "rrrr/rrrr/rrrr/gggg"


def _plain_lzw(data, root):
    """Codes one by one with a table of strings, by the format's description."""
    bits = "".join(f"{b:08b}"[::-1] for b in data)
    clear, at, out, last = 1 << root, 0, b"", None
    table, width = {}, root + 1
    while True:
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            table, width, last = {k: bytes([k]) for k in range(clear)} | {clear: b"", clear + 1: b""}, root + 1, None
            continue
        if code == clear + 1:
            return out
        entry = table[code] if code in table else last + last[:1]
        out += entry
        if last is not None and len(table) < 4096:
            table[len(table)] = last + entry[:1]
            if len(table) == 1 << width and width < 12:
                width += 1
        last = entry


def _plain_gif(data):
    """Boxes, delays and samples of a GIF without local palettes, read by hand."""
    at, found, delay = 13 + 3 * (2 << (data[10] & 7)), [], 0

    def blocks(at):
        out = b""
        while data[at]:
            out += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        return out, at + 1

    while data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            block, at = blocks(at + 2)
            delay = int.from_bytes(block[1:3], "little") if kind == 0xF9 else delay
        else:
            box = np.frombuffer(data[at + 1 : at + 9], "<u2").tolist()
            stream, end = blocks(at + 11)
            found.append((box, delay, _plain_lzw(stream, data[at + 10])))
            at = end
    return found


def test_media_query_equals_plain_reading(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, gif_media.query(spark, str(tmp_path)).collect()), key=repr)
    stored = gif_media.store(docs).collect()
    text = {}
    for r in docs.collect():
        text.setdefault(r["doc_id"], []).append(r["text"] or "")
    expected = []
    for r in stored:
        parts = _plain_gif(r["media"])
        payload = b"".join(samples for _, _, samples in parts)
        raw = next(t.encode() for t in text[r["doc_id"]] if t.encode().ljust(max(1, -(-len(t.encode()) // 576)) * 576, b"\xff") == payload)
        canvas, sums = np.zeros(parts[0][0][2] * parts[0][0][3], int), np.zeros(8, int)
        for _, _, samples in parts:
            canvas[: len(samples)] = list(samples)
            sums += np.bincount(canvas // 32, minlength=8)
        told = "-".join(map(str, sums))
        feature = f"frames={len(parts)};duration={4 * len(parts)};r={told};g={told};b={told}"
        expected.append((r["doc_id"], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(r["media"]), hashlib.sha256(r["media"]).hexdigest(), feature))
    assert got == sorted(expected, key=repr) and len(got) == docs.count()
    assert gif_media.features(gif_media.store(docs.limit(0))).count() == 0


def test_timed_frames_are_rows(spark):
    palette = [0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255]
    data = _gif([((0, 0, 4, 4), [1] * 16, 1, None, 5, 0), ((1, 1, 2, 2), [2, 3, 3, 2], 3, 3, 6, 0), ((0, 0, 1, 1), [3], 0, None, 7, 0)], palette)
    media = spark.createDataFrame([("a", data), ("b", None)], "doc_id string, media binary")
    rows = gif_media.frames(media).orderBy("number").collect()
    assert [(r["doc_id"], r["number"], r["start"], r["delay"], r["left"], r["top"], r["width"], r["height"]) for r in rows] == [("a", 0, 0, 5, 0, 0, 4, 4), ("a", 1, 5, 6, 1, 1, 2, 2), ("a", 2, 11, 7, 0, 0, 1, 1)]
    assert [(r["red"][7], r["green"][7], r["blue"][7]) for r in rows] == [(16, 0, 0), (14, 2, 0), (15, 0, 1)]
    assert all(sum(r[c]) == 16 for r in rows for c in ("red", "green", "blue"))


def test_pixel_bound_is_the_callers():
    data = gif_media.encode(b"a" * 4 * gif_media.UNIT)
    assert gif_media.describe(data, 1000)["error"] == "canvas too large"
    assert gif_media.describe(data, None) == gif_media.describe(data) and "error" not in gif_media.describe(data)


def test_histograms_count_each_channel():
    rgb = np.random.default_rng(1).integers(0, 256, (7, 5, 3)).astype(np.uint8)
    assert gif_media._histograms(rgb) == [np.bincount(rgb[..., k].ravel() // 32, minlength=8).tolist() for k in range(3)]


def test_foreign_and_broken_files_have_a_defined_result(spark):
    palette = [0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255]
    good = _gif([((0, 0, 4, 4), [1] * 16, 1, None, 5, 0)], palette)
    comment = good[:25] + b"\x21\xfe\x05hello\x00" + good[25:]
    huge = good[:6] + b"\xff\xff\xff\xff" + good[10:]
    bare = b"GIF89a" + b"\x04\0\x04\0\0\0\0" + good[25:]
    files = {"good": good, "comment": comment, "null": None, "empty": b"", "text": b"hello", "huge": huge, "bare": bare, "cut": good[:-5], "head": good[:9], "tail": good[:-1], "noise": good[:25] + b"\x99" * 40}
    rows = {r["doc_id"]: r for r in gif_media.features(spark.createDataFrame([*files.items()], "doc_id string, media binary")).collect()}
    assert set(rows) == set(files)
    for name in ("good", "comment"):
        assert rows[name]["error"] is None and rows[name]["n_bytes"] is None and len(rows[name]["frames"]) == 1 and rows[name]["payload_bytes"] == 16
    told = {n: r["error"] for n, r in rows.items() if n not in ("good", "comment")}
    assert told["null"] == "no media" and told["huge"] == "canvas too large" and told["bare"] == "no palette" and told["text"] == told["empty"] == "not a GIF" and told["noise"] == "unknown block"
    assert told["cut"] == told["head"] == told["tail"] == "cut off"
    assert all(rows[n]["payload_sha256"] is None and rows[n]["frames"] is None for n in told)


# ------------------------------------------------------------------ registry and pipeline


def test_registry_covers_all_operators():
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(registry.oracle_sql()) <= set(names)


def test_pipeline_against_stagewise_plain_version(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("tox_score >= 0.3").collect()}
    left = docs.where(~F.col("doc_id").isin([*toxic, -1]))
    found = language_id.predict(left, language_id.fit(left)).collect()
    kept = {r["doc_id"]: r["text"] for r in found if r["lang_pred"] != "und" and r["lang_rate"] >= language_id.MIN_SCORE}
    unique = plain(kept)
    frame = docs.where(F.col("doc_id").isin([*unique])).toPandas()
    mixed = duck(mixing.ORACLE_SQL, documents=frame)
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    text = dict(zip(frame["doc_id"], frame["text"], strict=True))
    expected = [(d, [*tokenizer.encode(text[d], add_special_tokens=False).ids, 0]) for d, size, taken in zip(mixed["doc_id"], mixed["size"], mixed["taken"], strict=True) for _ in range(taken // size if size else 0)]
    rows = [r for r in corpus_pipeline.run(spark, SF).collect() if text[r["doc_id"]].strip()]
    check_packed(rows, expected)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
