"""Card life cycle, suites, spool, logs and curation: cases with known answers."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import curation, evaluation, gates, messages, selection, similarity, telemetry
from tessera.sources import cards, evals, hooks, projects, sessions, spool
from tests.test_recall import CARD, CARDS


def test_trigger_contract_codes(spark):
    rows = [
        ("any", "draft", "t", "c", "s", ["fix the browser page", "cook pasta"], [], [], ["ui_surface"], [], [], []),
        ("all", "draft", "t", "c", "s", ["fix the browser page"], [], [], [], ["ui_surface", "git_operation"], [], []),
        ("blocked", "draft", "t", "c", "s", ["only explain the plan"], [], [], [], [], ["explain_only"], []),
        ("aimed", "draft", "t", "c", "s", ["github issue about the commit"], [], [], ["git_operation"], [], [], []),
    ]
    found = {(r.card_id, r.trigger_index, r.code, tuple(r.signals)) for r in cards.trigger_contract(spark.createDataFrame(rows, CARD)).collect()}
    assert {
        ("any", 1, "required-signals-missing", ("ui_surface",)),
        ("all", 0, "required-all-signals-missing", ("git_operation",)),
        ("blocked", 0, "blocked-signal-detected", ("explain_only",)),
        ("aimed", 0, "targeted-negative-suppression", ("git_source_noise",)),
    } <= found
    assert not {x for x in found if x[0] == "any" and x[1] == 0}


def test_patches_apply_in_order_and_clear(spark):
    have = spark.createDataFrame([("a", "A", "x"), ("b", "B", "y")], "card_id string, title string, summary string")
    changes = spark.createDataFrame([("a", "A1", None, 1, None), ("a", None, "z", 2, ["title"]), ("b", "B1", None, 1, None), ("b", "B1", None, 1, None)], "card_id string, title string, summary string, place int, cleared array<string>")
    assert sorted(map(tuple, cards.patch(have, changes).collect()), key=repr) == [("a", None, "z"), ("b", "B1", "y")]


def test_collapse_follows_the_greedy_rule(spark):
    rng = random.Random(9)
    rows, pairs = [], {(a, b) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.25}
    for p in range(40):
        ids = rng.sample(range(12), rng.randint(1, 9))
        seen = [(i, lib) for i in ids for lib in ((1, 2) if rng.random() < 0.4 else (1,))]
        rng.shuffle(seen)
        rows += [(p, f"{lib}:{i}", i, float(rng.randint(40, 60)), lib, place) for place, (i, lib) in enumerate(seen)]
    got = {(r.prompt_id, r.card_key): r.leader for r in selection.collapse(spark.createDataFrame(rows, "prompt_id int, card_key string, card_id int, score double, library_priority int, place int"), spark.createDataFrame(sorted(pairs), "a int, b int"), ["place"]).collect()}
    want = {}
    for p in range(40):
        leaders = []
        for _, key, i, score, lib, _ in sorted((r for r in rows if r[0] == p), key=lambda r: r[5]):
            want[p, key] = key
            k = next((k for k, x in enumerate(leaders) if x[1] == i or (min(x[1], i), max(x[1], i)) in pairs), None)
            if k is None:
                leaders.append((key, i, score, lib))
            elif lib > leaders[k][3] and (i == leaders[k][1] or score >= leaders[k][2] - 8):
                want[p, leaders[k][0]] = key
                leaders[k] = (key, i, score, lib)
            else:
                want[p, key] = leaders[k][0]
    assert got == want


def test_collapse_needs_few_rounds(spark):
    """One prompt, 3,000 candidates in random order, each like its neighbour: rounds follow ascending chains, not candidates."""
    rng = random.Random(1)
    n = 3000
    places = rng.sample(range(n), n)
    rows = spark.createDataFrame([(1, str(k), k, 50.0, 1, places[k]) for k in range(n)], "prompt_id int, card_key string, card_id int, score double, library_priority int, place int")
    similar = spark.createDataFrame([(k, k + 1) for k in range(n - 1)], "a int, b int")
    rounds = []
    got = {int(r.card_key): int(r.leader) for r in selection.collapse(rows, similar, ["place"], rounds=rounds).collect()}
    want, leaders = {}, set()
    for k in sorted(range(n), key=places.__getitem__):
        near = [x for x in (k - 1, k + 1) if x in leaders]
        want[k] = min(near, key=places.__getitem__) if near else k
        if not near:
            leaders.add(k)
    assert got == want and sum(rounds) == n and len(rounds) <= 12


def test_collapse_without_like_cards_keeps_all(spark):
    rows = spark.createDataFrame([(1, "a:1", 1, 50.0, 1, 0), (1, "a:2", 2, 50.0, 1, 1), (2, "a:1", 1, 50.0, 1, 0)], "prompt_id int, card_key string, card_id int, score double, library_priority int, place int")
    kept = selection.collapse(rows, spark.createDataFrame([(1, 9)], "a int, b int"), ["place"]).collect()
    assert len(kept) == 3 and all(r.card_key == r.leader for r in kept)


def test_pruned_pairs_are_whole(spark):
    rng = random.Random(4)
    sets = {k: sorted({rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))}) for k in range(60)}
    rows = spark.createDataFrame([*sets.items()], "k int, s array<string>")
    for least in (0.3, 0.5, 0.8, 1.0):
        got = {(r.a, r.b) for r in similarity.set_pairs(rows, "k", "s", least).collect()}
        assert got == {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= least * len(set(sets[a]) | set(sets[b]))}


def test_find_similar_and_starters(spark):
    have = spark.createDataFrame([CARDS[0], ("twin", *CARDS[0][1:]), CARDS[1]], CARD).withColumns({"rule": F.lit(""), "body": F.lit("")})
    assert {(r.a, r.b, r["rank"]) for r in similarity.find_similar(have).collect()} == {("twin", "ui-check", 1), ("ui-check", "twin", 1)}
    built = cards.starters(spark)
    assert built.count() == 3 and cards.add_missing(built, built).count() == 3


def test_code_blocks_are_searched_by_their_terms(spark):
    text = "see\n```ts\nimport x from 'src/app/main.ts'\nthrow new ERR_BAD_STATE()\nconst userName = loadUser(id)\n```\nthe end at foo.bar(x.js:1:2) ```open"
    row = spark.createDataFrame([(text,)], "t string").select(T.normalize(F.col("t")).alias("n"), T.summarize(F.col("t")).alias("s")).first()
    assert row.n.startswith("see src/app/main.ts") and row.n.endswith("the end ```open")
    assert {"err_bad_state", "username", "loaduser"} <= set(row.n.split()) and "import" not in row.n and "const" not in row.n
    assert row.s == "see the end ```open"


def test_strict_scans_fail_at_the_first_fault(spark):
    good = spark.createDataFrame([("f", 1, '{"a": 1}')], "file string, line int, value string")
    assert sessions.strict(good).count() == 1
    with pytest.raises(PySparkException, match="invalid JSON line"):
        sessions.strict(good.unionByName(spark.createDataFrame([("f", 2, "nope")], good.schema))).collect()
    with pytest.raises(PySparkException, match="must contain cases"):
        evals.cases(spark.createDataFrame([("s.json", '{"name": "x"}')], "file string, value string")).collect()


def test_suites_judge_extra_cards(spark):
    cases = [("a", ["x", "y"], ["bad"], ["ok"], False), ("b", [], [], [], True), ("c", ["x"], [], [], False), ("d", [], [], [], False)]
    ranked = [("a", "x", 1), ("a", "ok", 2), ("a", "y", 3), ("c", "x", 1), ("c", "other", 2), ("d", "bad", 1)]
    judged = evaluation.judge_cases(spark.createDataFrame(cases, "case_id string, ids array<string>, unexpected array<string>, allowed array<string>, expect_none boolean"), spark.createDataFrame(ranked, "case_id string, id string, rank int"), 4)
    rows = {r.case_id: r for r in judged.collect()}
    assert {k: r.passed for k, r in rows.items()} == {"a": True, "b": True, "c": False, "d": False}
    assert rows["a"].precision == 1.0 and rows["c"].disallowed == ["other"] and rows["c"].precision == 0.5
    report = evaluation.suite_report(judged).first()
    assert (report.cases, report.pass_rate, report.over_recall_rate, report.no_hit_rate) == (4, 0.5, 0.5, 0.25)


def test_spool_source(spark, tmp_path):
    session = {"session": {"sessionUuid": "u1", "filePath": "/p", "source": "x", "cwd": "/w"}, "messages": [{"role": "user", "contentText": "hi"}, {"role": "system", "text": "no"}, {"text": "more"}]}
    files = {"a/one.json": json.dumps(session), "two.json": "[1]", "three.json": "{broken", "four.json": json.dumps({"id": "big", "messages": [{"text": "x" * 5000}]})}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    spark.dataSource.register(spool.SpoolSource)
    rows = {r.file.rsplit("/", 1)[1]: r for r in spark.read.format("spool").option("maxBytes", "2000").load(str(tmp_path)).collect()}
    assert (rows["one.json"].session_id, rows["one.json"].messages, rows["one.json"].provider, rows["one.json"].issue) == ("u1", 2, "spool:x", None)
    assert {k: r.issue for k, r in rows.items() if k != "one.json"} == {"two.json": "no-session", "three.json": "no-session", "four.json": "too-large"}


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = [f'{{"n": {k}, "pad": "{"x" * (k % 50)}"}}' if k % 7 else "" for k in range(4000)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "s.jsonl").write_text("\r\n".join(lines))
    (tmp_path / "t.jsonl").write_text("\n\n{}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = sessions.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    kept = [x for x in lines if x]
    assert {r.line: r.value for r in rows if r.file.endswith("s.jsonl")} == dict(enumerate(kept, 1))
    assert [(r.line, r.value) for r in rows if r.file.endswith("t.jsonl")] == [(1, "{}")]


def test_nested_texts_are_found():
    line = json.dumps({"payload": {"item": {"content": [{"type": "text", "text": " a "}, {"tool_input": {"parameters": ["b", {"summary": "c"}]}}]}}, "message": "a", "other": "no"})
    assert sessions.line_text(line) == "a\n\nb\n\nc" and sessions.line_text("[1]") == sessions.line_text("x") == sessions.line_text(None) == ""


def test_hashes_tell_order_and_head(spark):
    rows = [("p", "s", "f", k, "user", f"t{k}", None, None) for k in range(1, 3000)]
    frame = spark.createDataFrame(rows, "provider string, session_id string, file string, line int, role string, text string, created_at string, cwd string")
    swapped = frame.withColumn("line", F.when(F.col("line") == 7, 8).when(F.col("line") == 8, 7).otherwise(F.col("line")))
    sized = lambda n: spark.createDataFrame([("f", n)], "file string, bytes long")
    found = {sessions.session_records(x, s).first().hash for x, s in ((frame, None), (swapped, None), (frame, sized(1)), (frame, sized(2)))}
    assert len(found) == 4 and sessions.session_records(frame.repartition(3)).first().hash in found
    assert messages.session_hash(frame.withColumn("turn", F.col("line")), "session_id", ["turn"]).count() == 1


def test_protected_references_of_any_length(spark):
    have = spark.createDataFrame([("abc-12345678-x",), ("zz9",), ("other",)], "session_id string")
    refs = spark.createDataFrame([("12345678",), ("zz",), ("",), (None,)], "ref string")
    assert {r[0] for r in curation.protected(have, refs).collect()} == {"abc-12345678-x", "zz9"}
    assert curation.protected(have, refs.where("ref = ''")).count() == 0


def test_storage_and_sanitised_logs(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text("12345")
    (tmp_path / "b.txt").write_text("1")
    role = F.element_at(F.split("path", "/"), -2)
    assert {(r.role, r.files, r.bytes) for r in telemetry.storage_audit(spark, str(tmp_path), role).collect()} >= {("log", 1, 5)}
    rows = spark.createDataFrame([("secret words", "secret", ["secret"], ["secret"], ["ui"])], "text string, summary string, files array<string>, negatives array<string>, task_types array<string>")
    assert "secret" not in str(hooks.sanitized(rows).collect()) and hooks.sanitized(rows).first().task_types == ["ui"]


def test_projects_and_applicability(spark, tmp_path):
    (tmp_path / "repo" / "src" / "x").mkdir(parents=True)
    (tmp_path / "repo" / "package.json").write_text('{"name": "pkg"}')
    found = projects.context(str(tmp_path / "repo" / "src" / "x"))
    assert (found["project_key"], found["module_path"], found["source"]) == ("pkg", "src/x", "package") and projects.context(None)["source"] == "none"
    stack = projects.library_stack(str(tmp_path / "home"), str(tmp_path / "repo"))
    assert [s for s, _ in stack] == ["global", "project"]
    frame, warnings = projects.read_stack(spark, stack, lambda s, p: s.read.schema("a string").json(p) if "home" not in p else (_ for _ in ()).throw(OSError()))
    assert frame is None or frame.count() == 0
    assert warnings[0] == "global: OSError"
    placed = spark.createDataFrame([("a", "global", None, None), ("b", "project", "k", None), ("c", "project", "other", None)], "card_id string, level string, project_key string, module_path string")
    assert [r.card_id for r in gates.filtered_by_applicability(placed, F.lit("k"), F.lit("m")).collect()] == ["c"]


def test_categories_sort_by_pinyin(spark):
    rows = [("性能与观测", 1), ("测试验收", 1), ("文档与开源", 1), ("安全", 1), ("docs", 1), ("前端工程", 1), ("产品与 UI", 5)]
    found = curation.sorted_categories(spark.createDataFrame(rows, "category string, cards int")).collect()
    assert [r.category for r in found] == ["产品与 UI", "安全", "测试验收", "前端工程", "文档与开源", "性能与观测", "docs"]
