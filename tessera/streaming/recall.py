"""Streams: prompts in, selected cards and events out; telemetry as a running aggregate.

A batch is recalled as a whole (``foreachBatch``), so a stream uses the very plan of a batch query.
Sinks are append-only tables keyed by batch; a batch that runs again writes its own folder anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tessera.operators import recall
from tessera.sources import hooks
from tessera.tables import discard, materialize

EVENTS = "event_id string, ts timestamp, selected array<string>, rendered array<string>, snapshot string"


def payload_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """JSON payloads, one a line, as they arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def prompts_of(payloads: DataFrame, number: int) -> DataFrame:
    """Prompts of a batch of JSON payloads.  A sender may repeat a turn, which counts once; payloads that name no session and
    turn are prompts of their own."""
    said = hooks.normalize_payloads(payloads).where("not maintenance and event = 'prompt.submit' and text <> ''")
    named = F.col("session_id").isNotNull() & F.col("turn_id").isNotNull()
    key = F.when(named, F.concat_ws("\x00", "session_id", "turn_id", "text")).otherwise(F.concat_ws("\x00", F.lit(str(number)), F.col("row").cast("string")))
    return said.select(F.sha2(key, 256).alias("prompt_id"), "text", "session_id", "provider").dropDuplicates(["prompt_id"])


def recall_stream(payloads: DataFrame, cards: DataFrame | Callable[[], DataFrame], out: str, checkpoint: str, available_now: bool = False, **options) -> StreamingQuery:
    """Recall every prompt of a stream of payloads into ``out``/matches; payloads without JSON go to ``out``/dead.

    The stream fails open: a batch that recall cannot do goes to ``out``/failed with its error, and the next one
    follows.  ``cards`` is the library as it was listed when the stream began, or a function that lists it anew for each batch.
    """

    def run(batch: DataFrame, number: int) -> None:
        kept: list[DataFrame] = []
        rows = materialize(batch.select("value").withColumn("row", F.monotonically_increasing_id()), "payloads")
        good = F.coalesce(F.try_parse_json("value").isNotNull(), F.lit(False))
        rows.where(~good).select("value").write.mode("overwrite").parquet(f"{out}/dead/batch={number}")
        try:
            prompts = prompts_of(rows.where(good), number)
            found = recall.match(prompts, cards() if callable(cards) else cards, keep=kept, **options)
            found.join(prompts.select("prompt_id", "session_id", "provider"), "prompt_id").write.mode("overwrite").parquet(f"{out}/matches/batch={number}")
        except Exception as e:
            rows.where(good).select("value", F.lit(str(e)[:2000]).alias("error")).write.mode("overwrite").parquet(f"{out}/failed/batch={number}")
        for table in (rows, *kept):
            discard(table)

    writer = payloads.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def rates_stream(events: DataFrame, window: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """Events, matched and rendered events by window of event time; rows later than ``late`` are left out
    (None where the stream has its watermark, as after ``once``)."""
    shown = F.size(F.array_intersect("rendered", "selected")) > 0
    grouped = (events.withWatermark("ts", late) if late else events).groupBy(F.window("ts", window).alias("w"))
    counts = grouped.agg(F.count("*").alias("events"), F.count_if(F.size("selected") > 0).alias("matched"), F.count_if(shown).alias("rendered_events"))
    return counts.select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), "events", "matched", "rendered_events")


def once(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events of a stream without those that a sender repeats within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
