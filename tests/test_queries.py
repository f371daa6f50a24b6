"""Every query that has SQL gives DuckDB's rows; the others run and keep their keys."""

import math
import os

import duckdb
import pytest

from tessera.plans import registry
from tests import plain_recall

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: Queries that SQL cannot express (look-around patterns, order-dependent folding), and the tests that hold them to plain versions.
ELSEWHERE = {
    "negated_spans": "test_recall_plain",
    "envelope": "test_recall_plain",
    "query_plan": "test_recall_plain",
    "rule_signals": "test_recall_plain",
    "recall_match": "test_recall_plain",
    "recall_diagnostics": "test_recall_plain",
    "recall_selection": "test_recall_plain",
    "greedy_collapse": "test_library",
}


def test_every_other_query_is_held_elsewhere(spark):
    assert set(registry.queries()) - set(registry.oracle_sql()) == set(ELSEWHERE)


def test_small_queries_without_sql(spark):
    """The queries themselves, over the functions that other tests hold to plain versions."""
    said = {r["conv_id"] * 1000 + r["turn"]: r["text"] for r in spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'user'").collect()}
    run = lambda name: registry.queries()[name](spark, SF).collect()
    plans = {}
    for r in run("query_plan"):
        plans.setdefault(r["prompt_id"], {})[r["token"]] = r["weight"]
    envelopes = {r["prompt_id"]: r for r in run("envelope")}
    for key, text in said.items():
        e = plain_recall.envelope(text)
        assert envelopes[key]["keywords"] == e["keywords"] and envelopes[key]["segments"] == e["segments"]
        want = {}
        for t, w in plain_recall.variants({**e, "intent_modes": [], "rule_signals": [], "signal_terms": []}):
            for token in plain_recall.token_set(t):
                want[token] = max(want.get(token, 0), w)
        assert plans.get(key, {}) == want
    assert {r["prompt_id"]: (r["signals"], r["intents"]) for r in run("rule_signals")} == {k: (",".join(i), ",".join(m)) for k, (i, m) in ((k, plain_recall.signals(t)) for k, t in said.items())}
    every = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    spans = {(r["conv_id"], r["turn"]): "|".join(plain_recall.distinct(x for x in (m.group(0).strip(" ") for m in plain_recall.NEGATED.finditer(r["text"] or "")) if x)) for r in every}
    assert {(r["conv_id"], r["turn"]): r["spans"] for r in run("negated_spans")} == spans


def test_recall_selection_is_a_selection(spark):
    """Admission, fusion, diversity and selection of two evidence families, recomputed in plain Python from the query's own inputs."""
    rows = registry.queries()["recall_selection"](spark, SF).collect()
    by_prompt = {}
    for r in rows:
        by_prompt.setdefault(r["prompt_id"], []).append(r)
    for own in by_prompt.values():
        own.sort(key=lambda r: (-r["rank_score"], -r["score"], -r["raw_score"], r["item_id"]))
        assert own[0]["selected"] and all(r["score"] >= 20 for r in own) and sum(r["selected"] for r in own) <= 4
        for k, r in enumerate(own):
            before = sum(x["selected"] or (x["reason"] or "").startswith("post-selection:limit") for x in own[:k])
            assert r["selected"] == (r["reason"] is None) and (before < 4 or not r["selected"])
