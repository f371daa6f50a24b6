"""Importance resampling, Merkle manifest and personal data against plain versions."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import importance, merkle, packing, pii, simhash


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def written(df, folder, **others):
    for name, frame in {"documents": df, **others}.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def by_sql(sql, folder, *names):
    con = duckdb.connect()
    for name in names:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    cursor = con.execute(sql)
    return [dict(zip([c[0] for c in cursor.description], row, strict=True)) for row in cursor.fetchall()]


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=repr)


# ------------------------------------------------------------------ importance


def plain_features(text, orders):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, orders, buckets, percent, least, seed=2024):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for texts, held in ((docs, s), (target, t)):
        for row in texts:
            for f in plain_features(row[-1], orders)[1]:
                held[at(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + buckets) / ((a + 1.0) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for doc_id, text in docs:
        words, found = plain_features(text, orders)
        h = int(sha(f"{seed}:{'' if doc_id is None else doc_id}")[:8], 16)
        weight = sum(gain[at(f)] for f in found)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, row in enumerate(fit[: percent * len(fit) // 100], 1):
        row[4] = rank
    return sorted((dict(zip(("doc_id", "n_features", "weight", "score", "rank"), r[:5], strict=True)) for r in out), key=repr)


def texts(rng, n):
    word = lambda: rng.choice(["alpha", "Beta", "Straße", "naïve", "x", "中文", "ÄÖ", "9", "a" * 300])
    gap = lambda: rng.choice([" ", "  ", "\n", "-", "_", ".\x7f", "\x00"])
    return ["".join(word() + gap() for _ in range(rng.choice([0, 1, 5, 30, 60]))) for _ in range(n)]


@pytest.mark.parametrize(("orders", "size"), [(1, 64), (3, 50), (2, 1 << 16)])
def test_resampling_equals_plain_version(spark, orders, size):
    rng = random.Random(orders)
    docs = list(enumerate(texts(rng, 120))) + [(5, "Alpha beta " * 20)] * 40 + [(None, "beta x " * 15), (None, None), (900, None), (901, ""), (902, "x" * 5000), (903, " -" * 500)]
    docs += [(950, " ".join(texts(rng, 40)))]
    target = [(t,) for t in texts(rng, 10)] + [(None,)]
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, row string, rank int").repartition(3)
    got = rows_of(importance.resample(frame, spark.createDataFrame(target, "text string"), orders, 97, 30, 20, size=size))
    assert got == plain_resample(docs, target, orders, 97, 30, 20)
    assert sum(r["rank"] is not None for r in got) == 30 * sum(len(plain_features(t, 1)[0]) >= 20 for _, t in docs) // 100


def test_chunks_own_every_start_once():
    rng = random.Random(1)
    for text in texts(rng, 60):
        for orders in (1, 2, 4):
            data = importance.folded(text)
            whole = importance.count(data, len(data), orders)
            parts = [importance.count(part, owned, orders) for part, owned in importance.chunks(data, orders, 7)]
            assert sum(p[0] for p in parts) == whole[0] and sum(p[1] for p in parts) == whole[1]
            summed = {}
            for _, _, buckets, counts in parts:
                for b, c in zip(buckets, counts, strict=True):
                    summed[b] = summed.get(b, 0) + c
            assert summed == dict(zip(whole[2], whole[3], strict=True))


def test_resampling_query_equals_sql_and_empty_tables(spark, tmp_path):
    rng = random.Random(9)
    docs = spark.createDataFrame(list(enumerate(texts(rng, 80))) + [(3, "alpha " * 40), (None, "x " * 25), (81, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(t,) for t in texts(rng, 12)], "text string")
    folder = written(docs, tmp_path / "a", benchmark=bench)
    assert rows_of(importance.query(spark, folder)) == sorted(by_sql(importance.ORACLE_SQL, folder, "documents", "benchmark"), key=repr)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, bench).count() == 0
    assert importance.resample(docs, bench.where("false")).count() == docs.count()
    named = importance.resample(docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"), bench)
    assert dict(named.dtypes)["doc_id"] == "string" and named.count() == docs.count()


# ------------------------------------------------------------------ Merkle


def plain_tree(leaves):
    """Root and, for each leaf, its siblings from the lowest level up."""
    proofs, owners, nodes = [[] for _ in leaves], [[k] for k in range(len(leaves))], list(leaves)
    while len(nodes) > 1:
        above, up = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for k in range(len(run)):
                for leaf in owners[at + k]:
                    proofs[leaf].append((run, k))
            above.append(sha("".join(run)))
            up.append([x for k in range(len(run)) for x in owners[at + k]])
        nodes, owners = above, up
    return nodes[0], proofs


def plain_manifest(rows):
    """``rows``: doc_id, source, lang, n_chars, text."""
    encode = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(encode, r)))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[g] = plain_tree([x for x, _ in groups[g]])
    root, upper = plain_tree([trees[g][0] for g in order])
    out = []
    for g, shared in zip(order, upper, strict=True):
        for (own, r), proof in zip(groups[g], trees[g][1], strict=True):
            path = proof + shared
            altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            fold = leaf((*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))) if altered else own
            for run, k in path:
                fold = sha("".join([*run[:k], fold, *run[k + 1 :]]))
            siblings = "".join(x for run, k in path for x in (*run[:k], *run[k + 1 :]))
            out.append({"doc_id": r[0], "leaf": own, "subroot": trees[g][0], "root": root, "proof_sha256": sha(siblings), "folded_root": fold, "verified": fold == root})
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def manifest_rows():
    rng = random.Random(3)
    rows = [(k, rng.choice(["web", None]), "big", k % 7, f"Text Nr {k}") for k in range(1300)]
    rows += [(k, "s", "nine", 1, "Ä" * k) for k in range(9)] + [(1, "s", "one", 1, "Lone")] + [(k, "s", None, None, None) for k in range(64)]
    rows += [(77, "s", "same", 1, "Copy")] * 700 + [(78, "s", "same", 1, t) for t in ("b", "A", "c")] * 2
    rows += [(None, None, None, None, None), (None, "s", "big", 1, "unknown"), (5, "s", "", 0, ""), (6, "s", "Ärmel", 3, "x" * 70000)]
    return rows + [(9, "s", f"lang {k}", 1, "T") for k in range(12)]


def test_manifest_query_equals_plain_trees(spark, manifest_rows, tmp_path):
    frame = spark.createDataFrame([(*r, "clash") for r in manifest_rows], "doc_id long, source string, lang string, n_chars int, text string, siblings string").repartition(5)
    folder = written(frame, tmp_path / "a")
    got, want = rows_of(merkle.query(spark, folder)), plain_manifest(manifest_rows)
    assert got == want
    assert 0 < sum(not r["verified"] for r in got) < len(got)


def test_manifest_equals_sql(spark, manifest_rows, tmp_path):
    folder = written(spark.createDataFrame(manifest_rows[1290:1400], "doc_id long, source string, lang string, n_chars int, text string"), tmp_path / "a")
    assert rows_of(merkle.query(spark, folder)) == sorted(by_sql(merkle.ORACLE_SQL, folder, "documents"), key=repr)


def test_manifest_of_nothing_and_of_one(spark):
    rows = spark.createDataFrame([("k", "g", "ab")], "id string, g string, h string")
    assert [tuple(r) for r in merkle.manifest(rows, "g", "id", "h", ["id"]).collect()] == [("k", "ab", [], [1][:0], [], "ab", "ab")]
    assert merkle.manifest(rows.where("false"), "g", "id", "h", ["id"]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 200, 511, 512])
def test_walk_equals_plain_tree_with_little_memory(n):
    leaves = [sha(str(k)) for k in range(n)]
    root, proofs = plain_tree(leaves)
    assert merkle.root_of(leaves, merkle.height_of(n)) == root
    for (siblings, sizes, places), proof in zip(merkle.walk(leaves, merkle.height_of(n)), proofs, strict=True):
        assert siblings == [x for run, k in proof for x in (*run[:k], *run[k + 1 :])]
        assert list(zip(sizes, places, strict=True)) == [(len(run), k) for run, k in proof]


def test_treehash_holds_a_run_for_each_level():
    tree = merkle.TreeHash(3)
    for k in range(512):
        tree.push(sha(str(k)))
        assert all(len(run) < merkle.FAN for run in tree.runs)
    assert len(tree.close()) == 1


# ------------------------------------------------------------------ personal data

PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub(r"\D", "", m)) <= 19 and plain_luhn(re.sub(r"\D", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15),
)


def plain_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def plain_spans(text):
    return [(kind, m.start(), m.end()) for kind, pattern, valid in PLAIN for m in re.finditer(pattern, text or "") if valid(m[0])]


SAMPLES = [
    "mail a.b+c@x-y.example.org, or z@host, @x.y a@b.c@d.e. ..@a.b a@@b.c",
    "10.0.0.256 1.2.3.4.5.6.7.8 0001.02.3.255 1..2.3 99999999999.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 5500005555555559 4111  1111 1111 1111",
    "call +49 (30) 123.456-78 or +1 2, ++44 20 7946 0958, +12345678901234567",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 but DE89370400440532013001; XGB82WEST12345698765432",
    "my social security number 123-45-6789, order 123-45-6789 of many words that say nothing at all here, ssn 000-45-6789",
    "中文邮箱 名@x.y, é@x.y abc@x.y 😀 1.1.1.1",
    "", None,
]


def test_base_spans_equal_the_patterns():
    find, rng = pii.finder(), random.Random(8)
    bits = ["a", "@", ".", "1", "25", "-", " ", "+4", "(", ")", "%", "é", "411111111111111", "x.y", "_", "00"]
    for text in SAMPLES + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(4000)]:
        base = [s[:3] for s in find(text) if s[0] not in ("iban", "id")]
        assert base == plain_spans(text), text


def test_added_kinds_checksums_and_context():
    find = pii.finder()
    assert [s[0] for s in find(SAMPLES[4])] == ["iban", "iban"]
    assert [s[:3] for s in find(SAMPLES[5])] == [("id", 26, 37)]
    near, far = find("visa card 4111 1111 1111 1111")[0], find("number 4111 1111 1111 1111")[0]
    assert near[3] > far[3] == 0.6
    assert pii.redact("to a@b.c, +49 30 123456!", find("to a@b.c, +49 30 123456!")) == "to [email], [phone]!"


def test_very_long_texts_take_linear_time():
    find = pii.finder()
    for text in ("a" * 2_000_000, "1" * 1_000_000, "1." * 500_000, "@" * 500_000, "a@" * 300_000, "+1" * 300_000, "@a" * 300_000 + ".b", "1 " * 500_000, "A1" * 500_000):
        find(text)
    assert find("9" * 5000 + ".1.1.1") == []


def test_private_data_query_equals_sql(spark, tmp_path):
    rows = [(k, t, "clash") for k, t in enumerate(SAMPLES * 2)] + [(0, SAMPLES[0], "again"), (None, SAMPLES[4], None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    folder = written(frame, tmp_path / "a")
    got = rows_of(pii.query(spark, folder))
    assert got == sorted(by_sql(pii.ORACLE_SQL, folder, "documents"), key=repr)
    joined = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
    assert sorted(r["base_sha256"] for r in got) == sorted(sha(joined(plain_spans(t))) for _, t, _ in rows)
    whole = pii.detect(frame).collect()
    assert len(whole) == len(rows) and all((r["redacted"] is None) == (r["text"] is None) for r in whole)
    assert pii.detect(frame.where("false")).count() == 0


# ------------------------------------------------------------------ whole queries of earlier operators


def test_simhash_query_equals_all_pairs(spark, tmp_path):
    rng = random.Random(6)
    base = ["".join(rng.choice("ab cd") for _ in range(rng.randint(0, 300))) for _ in range(60)]
    rows = list(enumerate(base)) + [(100 + k, base[k] + " zz") for k in range(40)] + [(200, None), (201, ""), (202, " \n"), (None, base[1]), (7, base[7]), (300, "A B C D " * 400), (301, "a b c d " * 400)]
    folder = written(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sim_fp int"), tmp_path / "a")
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.query(spark, folder).collect()]
    prints = [(k, simhash.fingerprint(t) & (1 << 64) - 1) for k, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        least[find(i)] = min((x for x in (least.get(find(i)), k) if x is not None), default=None)
    assert sorted(got, key=repr) == sorted([(k, f"{fp:016x}", least[find(i)]) for i, (k, fp) in enumerate(prints)], key=repr)


def test_packing_query_returns_whole_documents(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["alpha", "Beta,", "中文", "x1"]) for _ in range(rng.choice([0, 3, 700, 3000])))) for k in range(40)] + [(90, None), (None, "lost"), (3, "again")]
    folder = written(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, piece int"), tmp_path / "a")
    got, sequences = {}, {}
    for r in packing.query(spark, folder).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = {}
    for k, text in rows:
        ids = [*(tokenizer.encode(text, add_special_tokens=False).ids if text else []), 0]
        first = len(ids) % 2048 or 2048
        for a, b in [(0, first)] + [(x, x + 2048) for x in range(first, len(ids), 2048)]:
            want.setdefault(k, []).append((a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in sequences.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    assert len(sequences) <= len(packing.best_fit([n for parts in want.values() for _, n, _ in parts])) + 1
