"""Turns of a shuffled stream equal those of the table."""

import json
import os
import random

from tessera.streaming import sessions


def test_shuffled_micro_batches_equal_the_table(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for s in range(6):
        for t in range(rng.randint(1, 12)):
            minute = t * 3 + s % 3
            rows.append({"session_id": f"s{s}", "turn_id": f"t{t:02d}", "ts": f"2024-01-01 10:{minute:02d}:{rng.randint(0, 59):02d}", "text": f"text {s} {t}", "cwd": rng.choice([None, None, f"/w/{s}/{t}"])})
    rows += rng.sample(rows, 8)  # a sender repeats turns
    rng.shuffle(rows)
    last = {"session_id": "end", "turn_id": "z", "ts": "2024-01-03 00:00:00", "text": "", "cwd": None}
    (tmp_path / "in").mkdir()
    for k in range(4):
        part = rows[k::4] + ([last] if k == 3 else [])
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + 60 * k,) * 2)  # files are taken by their time
    source = spark.readStream.schema(sessions.TURN).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    writer = sessions.turns_stream(source).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
    query = writer.trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("session_id", "turn_id", "ts", "text", "cwd").collect()))
    whole = sessions.turns(spark.read.schema(sessions.TURN).json(str(tmp_path / "in"))).where("session_id <> 'end'")
    assert got == sorted(map(tuple, whole.select("session_id", "turn_id", "ts", "text", "cwd").collect())) and len(got) == len({(r["session_id"], r["turn_id"]) for r in rows})
