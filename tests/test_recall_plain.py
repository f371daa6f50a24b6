"""Whole recall queries against plain Python, on all prompts and cards of the smallest tables."""

import random

import pytest

from tessera.functions import prompt as P
from tessera.functions import signals as G
from tessera.operators import recall
from tessera.plans import lifecycle, retrieval
from tests import plain_recall
from tests.test_recall import ask

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def said(spark):
    return {r["prompt_id"]: r["text"] for r in retrieval.prompts(spark, SF).collect()}


def test_recall_equals_plain_python(spark, said):
    cards = [{**r.asDict(), "triggers": r["triggers"]} for r in lifecycle._cards(spark, SF).collect()]
    prompts = retrieval.prompts(spark, SF)
    assert recall.near_cards(lifecycle._cards(spark, SF)).count() == 0  # no two cards fold here; collapse has tests of its own
    rows = recall.match_detailed(prompts, lifecycle._cards(spark, SF), threshold=20.0).collect()
    got = {}
    for r in rows:
        got.setdefault(r["prompt_id"], {})[r["card_id"]] = r
    for key, text in said.items():
        chosen, reasons, _ = plain_recall.match(text, cards, 20.0)
        mine = got.get(key, {})
        assert {c for c, r in mine.items() if r["selected"]} == set(chosen), (key, text)
        lost = {c: r["reason"] for c, r in mine.items() if not r["selected"]}
        assert set(lost) == set(reasons), key
        assert all(reasons[c] in lost[c] for c in lost), (key, lost, reasons)


def test_envelope_equals_plain_python(spark, said):
    texts = [*said.values()] + ["Fix src/app.ts and run npm test, use git push; don't touch docs/a.md but review it.", "修复页面问题，不要部署，但是检查日志。用 npm run build 验证", "without review; `git status -s` please. Not only tests, no need to deploy", ""]
    prompts = ask(spark, *texts)
    rows = {r["prompt_id"]: r.asDict() for r in P.with_envelope(prompts).join(G.prompt_signals(prompts, "prompt_id"), "prompt_id").withColumn("rule_signals", G.ids(G.F.col("signals"))).withColumn("signal_terms", G.signal_terms(G.F.col("signals"))).collect()}
    for k, text in enumerate(texts):
        want = plain_recall.envelope(text)
        assert {c: rows[k][c] for c in want} == want, text


def test_signals_equal_plain_python(spark):
    """Prompts that mix words of atoms, patterns and turns at random."""
    rng = random.Random(3)
    bits = ["retire the legacy path", "one canonical route", "but", "then", ". ", "do not", "commit", "the dirty worktree", "read-only diff", "ai-dispatch", "provider adapter", "use ai-dispatch", "fix", "/goal", "business goal", "explain only", "is not", "stop before approval", "drop the production table", "placeholder", "never use it as evidence", "heartbeat without progress", "the page", "align", "\n", "Target: ai-dispatch", "current state:", "lease mismatch", "example runtime", "implement", "review", "; "]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(2, 14))) for _ in range(150)]
    rows = {r["prompt_id"]: ([s["id"] for s in r["signals"]], r["intent_modes"]) for r in G.prompt_signals(ask(spark, *texts), "prompt_id").collect()}
    assert {k: rows[k] for k in range(150)} == {k: plain_recall.signals(t) for k, t in enumerate(texts)}
