"""Session logs, hook payloads, card files, curation steps and streams on small inputs."""

import json

from pyspark.sql import functions as F

from tessera.operators import curation, recall
from tessera.sources import cards as library
from tessera.sources import hooks, sessions
from tessera.streaming import recall as streams


def test_sessions(spark, tmp_path):
    lines = [
        {"timestamp": "t1", "role": "human", "content": "<environment_context>x</environment_context> hello", "cwd": "/w"},
        {"message": {"role": "assistant", "content": [{"type": "text", "text": "hi"}, {"type": "text", "text": "there"}]}},
        {"type": "response_item", "payload": {"role": "developer", "content": [{"type": "text", "text": "hidden"}]}},
        {"type": "response_item", "payload": {"role": "user", "content": [{"type": "input_text", "text": "again"}]}},
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "s1.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n{broken\n")
    (tmp_path / "a" / "note.txt").write_text("no log")
    read = sessions.read_lines(spark, str(tmp_path))
    rows = sessions.visible_messages(read, "codex").orderBy("line").collect()
    assert [(r.line, r.role, r.text, r.cwd) for r in rows] == [(1, "user", "hello", "/w"), (2, "assistant", "hi\n\nthere", "/w"), (4, "user", "again", "/w")]
    assert rows[0].session_id == "s1" and rows[0].id and rows[1].id is None
    assert [r.line for r in sessions.split_json(read)[1].collect()] == [5]
    record = sessions.session_records(sessions.visible_messages(read, "codex")).first()
    assert (record.messages, record.started_at, record.cwd) == (3, "t1", "/w")


def test_session_without_a_name(spark):
    row = spark.createDataFrame([("/x/session.jsonl",)], "file string").select(sessions.session_of(F.col("file"), F.lit("codex")).alias("s")).first()
    assert row.s.startswith("codex-") and len(row.s) == len("codex-") + 16


def test_hook_payloads(spark):
    values = [json.dumps({"prompt": "a", "transcript_path": "/t", "session_id": "s"}), json.dumps({"userPrompt": "b", "workspace_roots": ["/w"]}), json.dumps({"input": "run tessera doctor", "turn_id": "1"}), "not json", None]
    rows = hooks.normalize_payloads(spark.createDataFrame([(v,) for v in values], "value string")).collect()
    assert [(r.provider, r.text, r.cwd, r.maintenance) for r in rows] == [("claude", "a", None, False), ("cursor", "b", "/w", False), ("codex", "run tessera doctor", None, True), ("unknown", "", None, False), ("unknown", "", None, False)]


def test_card_files(spark, tmp_path):
    cards = spark.createDataFrame([("one", "active", "Title", ["a b"], ["no"], ["ui_surface"], "text\nmore")], "card_id string, status string, title string, triggers array<string>, negative_triggers array<string>, required_any array<string>, body string")
    for r in library.card_markdown(cards).collect():
        (tmp_path / f"{r.card_id}.md").write_text(r.markdown)
    (tmp_path / "bad.md").write_text("no front matter")
    rows = {r.card_id: r for r in library.read_cards(spark, str(tmp_path)).collect()}
    assert rows[None].issue == "no-front-matter"
    r = rows["one"]
    assert (r.title, r.triggers, r.negative_triggers, r.required_any, r.body, r.level) == ("Title", ["a b"], ["no"], ["ui_surface"], "text\nmore", "global")


def test_promotion(spark):
    cards = spark.createDataFrame([("a", "draft", "t", ["check the browser page"], ["ui_surface"]), ("b", "draft", "t", ["water plants"], ["ui_surface"]), ("c", "draft", "t", [], ["nope"])], "card_id string, status string, title string, triggers array<string>, required_any array<string>")
    assert {r.card_id: r.issues for r in library.promotable(cards).collect()} == {"a": [], "b": ["required-signals-missing:0:ui_surface"], "c": ["unknown-signal:nope"]}
    assert {r.card_id: r.status for r in library.promote(cards, cards).collect()} == {"a": "active", "b": "draft", "c": "draft"}


def test_library_steps(spark, tmp_path):
    cards = spark.createDataFrame([("a", "active", "x"), ("b", "archived", "y")], "card_id string, status string, title string")
    assert {r.card_id for r in library.add_missing(cards, spark.createDataFrame([("a", "active", "new"), ("z", "draft", "z")], cards.schema)).where("title <> 'new'").collect()} == {"a", "b", "z"}
    assert library.find(cards.unionByName(spark.createDataFrame([("a", "draft", "d")], cards.schema)), "a").first().title == "x"
    library.write_table(cards, str(tmp_path / "t"))
    assert "PartitionFilters: [isnotnull(status" in spark.read.parquet(str(tmp_path / "t")).where("status = 'active'")._jdf.queryExecution().toString()


def test_decisions(spark):
    candidates = spark.createDataFrame([(1, "old"), (2, "keep")], "candidate_id int, title string")
    decisions = spark.createDataFrame([(1, "reject", None, 1), (1, "accept", '{"title": "new"}', 2)], "candidate_id int, action string, rewrite string, line int")
    rows = curation.overlay(curation.preview(candidates, decisions, [F.desc("line")]), "rewrite", ["title"]).orderBy("candidate_id").collect()
    assert [(r.title, r.state) for r in rows] == [("new", "applied"), ("keep", "undecided")]
    assert [r.candidate_id for r in curation.not_applied(candidates, candidates.where("candidate_id = 1")).collect()] == [2]


def test_merge_lesson(spark):
    rows = spark.createDataFrame([(1, "rule", "more"), (2, "rule more", "more"), (3, None, "more"), (4, "rule", " ")], "k int, rule string, lesson string")
    assert [r.m for r in rows.select("k", curation.merge_lesson(F.col("rule"), F.col("lesson")).alias("m")).orderBy("k").collect()] == ["rule\n\nmore", "rule more", "more", "rule"]


def test_compaction_and_doctor(spark):
    records = spark.createDataFrame([("a", "long text")], "id string, summary string")
    slim, saved = curation.compact(records, ["summary"])
    assert slim.columns == ["id"] and saved.first().saved > 0
    cards = spark.createDataFrame([("a", "active"), ("b", "draft")], "card_id string, status string")
    found = curation.doctor(cards, spark.createDataFrame([("b",)], "card_id string"), recall.invalid(cards.withColumn("title", F.lit("t"))))
    assert {r.message for r in found.collect()} == {"not-indexed: a", "not-active: b"}


def test_recall_stream(spark, tmp_path):
    cards = spark.createDataFrame([("ui-check", "active", "Browser validation", ["browser validation"], ["ui"])], "card_id string, status string, title string, triggers array<string>, topics array<string>")
    (tmp_path / "in").mkdir()
    said = [json.dumps({"prompt": "browser validation please", "session_id": "s", "turn_id": "1"}), "junk", json.dumps({"prompt": "pasta", "session_id": "s", "turn_id": "2"})]
    (tmp_path / "in" / "a.json").write_text("\n".join(said))
    query = streams.recall_stream(streams.payload_stream(spark, str(tmp_path / "in")), cards, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
    assert query.awaitTermination(120) and query.exception() is None
    assert [(r.card_id, r.session_id) for r in spark.read.parquet(str(tmp_path / "out/matches")).collect()] == [("ui-check", "s")]
    assert [r.value for r in spark.read.parquet(str(tmp_path / "out/dead")).collect()] == ["junk"]


def test_rates_stream(spark, tmp_path):
    rows = [("1", "2024-01-01 00:10:00", ["a"], ["a"], "x"), ("2", "2024-01-01 00:20:00", [], [], "x"), ("3", "2024-01-01 09:00:00", ["a"], [], "x"), ("3", "2024-01-01 09:00:00", ["a"], [], "x")]
    spark.createDataFrame(rows, "event_id string, ts string, selected array<string>, rendered array<string>, snapshot string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.json(str(tmp_path / "in"))
    source = spark.readStream.schema(streams.EVENTS).json(str(tmp_path / "in"))
    writer = streams.rates_stream(streams.once(source), late=None).writeStream.format("parquet").outputMode("append")
    run = writer.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [(r.events, r.matched, r.rendered_events) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, 1, 1)]
