"""A spool read as a table, through another scheme and as a stream."""

import json

from tessera.sources import spool


def test_table_scheme_and_stream_agree(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    said = lambda *texts: [{"role": "user", "text": t} for t in texts]
    files = {
        "a.json": {"session": {"uuid": "A", "source": "codex", "filePath": "/x", "cwd": "/w"}, "messages": [*said("Fix the Cache", ""), {"role": "system", "text": "hidden"}, {"role": "assistant", "content": "done"}]},
        "b.json": {"id": "B", "messages": said("nothing")},
        "large.json": {"id": "C", "messages": said("x" * 5000)},
        "list.json": [1, 2],
    }
    for name, value in files.items():
        (folder / name).write_text(json.dumps(value))
    (folder / "broken.json").write_text("{")
    (folder / "other.txt").write_text("{}")
    path = str(tmp_path / "in")
    table = spool.sessions(spark, path, 4000)
    rows = {r.file.rsplit("/", 1)[1]: r for r in table.collect()}
    assert {k: (r.session_id, r.messages, r.issue) for k, r in rows.items()} == {"a.json": ("A", 2, None), "b.json": ("B", 1, None), "large.json": (None, None, "too-large"), "list.json": (None, None, "no-session"), "broken.json": (None, None, "no-session")}
    assert rows["a.json"].texts == ["Fix the Cache", "done"] and rows["a.json"].provider == "spool:codex"
    assert [(r.session_id, r.hit) for r in spool.search(table, "fix the cache").collect()] == [("A", "Fix the Cache")]
    assert [tuple(r) for r in spool.show(table, "A").orderBy("place").collect()] == [(0, "Fix the Cache"), (1, "done")]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.spool.link./in", f"file://{path}")
    key = lambda df: sorted((r.file.rsplit("/", 1)[1], r.hash or "", r.issue or "") for r in df.collect())
    assert key(spool.sessions(spark, "viewfs://spool/in", 4000)) == key(table)

    def run():  # a stream that is started again takes each file once
        query = spool.sessions(spark, path, 4000, stream=True).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()

    run()
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(table)
    (folder / "late.json").write_text(json.dumps({"id": "D", "messages": said("late")}))
    run()
    run()
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(spool.sessions(spark, path, 4000))
