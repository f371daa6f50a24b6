"""Recall on small libraries with known answers."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import prompt as P
from tessera.functions import signals as G
from tessera.operators import recall

CARD = "card_id string, status string, title string, category string, summary string, triggers array<string>, negative_triggers array<string>, topics array<string>, required_any array<string>, required_all array<string>, blocked array<string>, exclude array<string>"
CARDS = [
    ("ui-check", "active", "Browser validation", "ui", "Validate pages in a real browser", ["browser validation", "check the page in a browser"], ["ui mock only"], ["ui"], ["ui_surface"], [], ["explain_only"], []),
    ("git-clean", "active", "Clean worktree commits", "git", "Keep commits of a dirty worktree scoped", ["dirty worktree commit"], [], ["git"], [], [], [], ["explain"]),
    ("old", "archived", "Old browser validation", "ui", "old", ["browser validation"], [], [], [], [], [], []),
    ("strange", "active", "Browser validation again", "ui", "needs a signal that nobody knows", ["browser validation"], [], [], ["no_such_signal"], [], [], []),
]


@pytest.fixture(scope="module")
def cards(spark):
    return spark.createDataFrame(CARDS, CARD)


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "prompt_id int, text string")


def test_selects_and_abstains(spark, cards):
    found = {(r.prompt_id, r.card_id) for r in recall.match(ask(spark, "please do browser validation of the frontend page", "cook pasta tonight", "commit only my files in the dirty worktree, it is uncommitted", None, ""), cards).collect()}
    assert found == {(0, "ui-check"), (2, "git-clean")}


def test_every_loser_has_a_reason(spark, cards):
    rows = recall.match_detailed(ask(spark, "browser validation of the frontend page", "browser validation for a ui mock only"), cards).collect()
    assert all(r.selected == (r.reason is None) for r in rows)
    why = {(r.prompt_id, r.card_id): r.reason for r in rows}
    assert why[0, "strange"] == "requiredSignals.unknown:no_such_signal"
    assert why[1, "ui-check"] == "negativeTriggers:ui mock only"
    assert "old" not in {r.card_id for r in rows}


def test_negated_text_is_no_evidence(spark, cards):
    rows = recall.match(ask(spark, "do not do browser validation of the frontend page, but tell me about pasta"), cards).collect()
    assert rows == []


def test_scores_ignore_other_cards(spark, cards):
    """More cards change the rank score's statistics, never the evidence score."""
    more = spark.createDataFrame([(f"x{k}", "active", f"Gardening tip {k}", "garden", "water the plants and browse seeds", ["water plants"], [], ["garden"], [], [], [], []) for k in range(50)], CARD)
    said = ask(spark, "browser validation of the frontend page")
    alone, crowd = ({r.card_id: r.score for r in recall.score(said, c).collect()} for c in (cards, cards.unionByName(more)))
    assert alone["ui-check"] == crowd["ui-check"]


def test_scopes_are_kept_apart(spark, cards):
    """A prompt meets its own library's cards only, with their statistics only."""
    both = cards.withColumn("library", F.lit("a")).unionByName(cards.where("card_id = 'ui-check'").withColumns({"card_id": F.lit("other"), "library": F.lit("b")}))
    said = ask(spark, "browser validation of the frontend page").withColumn("library", F.lit("a"))
    apart, alone = ({r.card_id: (r.raw_score, r.score) for r in rows.collect()} for rows in (recall.score(said, both, ["library"]), recall.score(said, cards)))
    assert apart == alone


def test_duplicates_fold_into_the_first(spark, cards):
    twin = [("twin", *CARDS[0][1:])]
    similar = spark.createDataFrame([("ui-check", "twin")], "a string, b string")
    rows = recall.match_detailed(ask(spark, "browser validation of the frontend page"), cards.unionByName(spark.createDataFrame(twin, CARD)), similar=similar).collect()
    assert {r.card_id: r.reason for r in rows if r.card_id in ("twin", "ui-check")} == {"twin": None, "ui-check": "post-selection:duplicate:global:twin"}


def test_context_keeps_whole_blocks(spark, cards):
    matches = spark.createDataFrame([(1, "ui-check", 1, 80.0), (1, "git-clean", 2, 60.0)], "prompt_id int, card_id string, rank int, score double")
    whole, short = (recall.render_context(matches, cards, n).first().context for n in (6000, 500))
    assert whole.count("   Summary: ") == 2 and short.count("   Summary: ") == 1 and whole.startswith(short)


def test_diagnostics_cover_silent_prompts(spark, cards):
    said = ask(spark, "browser validation of the frontend page", "pasta")
    rows = {r.prompt_id: r for r in recall.diagnostics(recall.match_detailed(said, cards), said).collect()}
    assert rows[0].selected == 1 and rows[0].abstain_reason is None
    assert rows[1].selected == 0 and rows[1].abstain_reason == "no-candidate-passed-evidence-contract"


def test_invalid_cards(spark, cards):
    bad = cards.unionByName(spark.createDataFrame([("a/b", "active", "t", "c", "s", [], [], [], [], [], [], []), ("e", "active", " ", "c", "s", [], [], [], [], [], [], [])], CARD))
    assert {r.card_id: r.issue for r in recall.invalid(bad).collect()} == {"a/b": "bad-id", "e": "empty-title", "strange": "unknown-signal"}


def test_envelope(spark):
    r = P.with_envelope(ask(spark, "Fix src/app.ts and run npm test; do not push to github, but review the docs. 修复页面")).first()
    assert r.files == ["src/app.ts"] and "npm test" in r.commands
    assert {"ui", "docs", "review", "test", "package"} <= set(r.task_types) and "git" not in r.task_types
    assert {"fix", "review"} <= set(r.operations) and r.language == "mixed"
    assert r.negatives == ["do not push to github"] and "push" not in r.risks and "github" not in r.surfaces


def test_signals(spark):
    texts = ("build the frontend page", "only explain the ui, don't implement it", "the dirty worktree has files to commit", "git diff on the worktree: read-only, the diff of uncommitted files before commit", "stop and wait for approval before you delete the production data", "修复UI问题")
    found = [set(r.s) for r in G.prompt_signals(ask(spark, *texts), "prompt_id").select(G.ids(F.col("signals")).alias("s"), "prompt_id").orderBy("prompt_id").collect()]
    assert "ui_implementation" in found[0] and "ui_implementation" not in found[1]
    assert "explain_only" in found[1]
    assert "worktree_diff_operation" in found[2] and "worktree_diff_operation" not in found[3]
    assert "high_risk_action" in found[4] and "ui_surface" in found[5]


def test_registry_is_sound():
    known = {s.id for s in G.REGISTRY}
    assert len(known) == len(G.REGISTRY) == 46
    assert all(set(s.targets) <= known for s in G.REGISTRY)
    assert len(G.ATOMS) == 57 and {a for s in G.REGISTRY for c in s.compositions for a in c.atoms} == set(G.ATOMS)
    assert sum(len(s.compositions) for s in G.REGISTRY) == 28 and sum(s.instead for s in G.REGISTRY) == 5
    assert all(s.patterns or s.compositions for s in G.REGISTRY)
