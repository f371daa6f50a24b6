"""Telemetry over an append-only event log: rates, counts per card, stale cards, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def comparable(events: DataFrame, snapshot: dict[str, Column]) -> DataFrame:
    """Events of one snapshot (schema, engine, scorer, card set, configuration): null-safe equality on each."""
    keep = F.lit(True)
    for name, value in snapshot.items():
        keep = keep & F.col(name).eqNullSafe(value)
    return events.where(keep)


def rates(events: DataFrame, selected: str = "selected", rendered: str = "rendered", *by: str) -> DataFrame:
    """Matched, rendered and no-hit rates; both columns are arrays of card ids."""
    shown = F.size(F.array_intersect(rendered, selected)) > 0
    n, matched, seen = F.count("*"), F.count_if(F.size(selected) > 0), F.count_if(shown)
    return events.groupBy(*by).agg(n.alias("events"), matched.alias("matched"), seen.alias("rendered_events"), F.try_divide(matched, n).alias("match_rate"), F.try_divide(seen, n).alias("render_rate"), F.try_divide(n - matched, n).alias("no_hit_rate"))


def card_counts(events: DataFrame, cards: DataFrame, selected: str = "selected", rendered: str = "rendered") -> DataFrame:
    """Recall and rendered counts of every known card, zero included."""
    recalled = events.select(F.explode(selected).alias("card_id")).groupBy("card_id").agg(F.count("*").alias("recalled"))
    shown = events.select(F.explode(F.array_intersect(rendered, selected)).alias("card_id")).groupBy("card_id").agg(F.count("*").alias("rendered"))
    return cards.select("card_id").join(recalled, "card_id", "left").join(shown, "card_id", "left").na.fill(0)


def stale(cards: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Cards that no event has used."""
    return cards.join(used.select(key).distinct(), key, "left_anti")


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The last row of each group; later wins."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


#: Digits of a hash by which hashes are folded, one level after the other.
FOLDS = (6, 3)


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """Hash of a set of rows (a card set or configuration), whatever their order.

    Rows are hashed where they are and equal ones become one with a count; hashes are folded by their first six digits, those
    folds by three, and those at last, so with n different rows a task folds n / 16**6 or 4,096 of them at a time, whichever is more."""
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(columns)])
    counted = rows.select(F.sha2(line, 256).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    folds = counted.select(F.col("h").alias("part"), F.concat("h", F.when(F.col("n") > 1, F.concat(F.lit(":"), "n")).otherwise("")).alias("h"))
    fold = lambda: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), ""), 256)
    for digits in FOLDS:
        folds = folds.groupBy(F.substring("part", 1, digits).alias("part")).agg(fold().alias("h")).select("part", F.concat("part", "h").alias("h"))
    return folds.agg(fold().alias("fingerprint"))


def stats_report(events: DataFrame, cards: DataFrame, snapshot: dict[str, Column]) -> DataFrame:
    """One row for each view, ``current`` (events of the snapshot; only known global cards count) and ``cumulative``: event
    counts and rates, and for the current view the excluded events, stale cards and maintenance actions.

    ``events``: event_id, selected and rendered (arrays of card ids) and the snapshot's columns.  ``cards``: card_id."""
    of_snapshot = F.lit(True)
    for name, value in snapshot.items():
        of_snapshot = of_snapshot & F.col(name).eqNullSafe(value)
    rows = events.withColumn("is_current", of_snapshot)
    used = rows.where("is_current").select(F.explode("selected").alias("card_id")).distinct()
    ours = rows.where("is_current").select("event_id", F.explode("selected").alias("card_id")).join(cards.select("card_id"), "card_id", "left_semi").groupBy("event_id").agg(F.collect_list("card_id").alias("own"))
    none = F.array().cast(dict(events.dtypes)["selected"])
    one = rows.where("is_current").join(ours, "event_id", "left").withColumn("selected", F.coalesce("own", none))
    now = rates(one, "selected", "rendered").withColumn("view", F.lit("current"))
    ever = rates(rows, "selected", "rendered").withColumn("view", F.lit("cumulative"))
    idle = stale(cards.select("card_id"), used, "card_id").agg(F.sort_array(F.collect_list(F.col("card_id").cast("string"))).alias("stale"))
    out = rows.agg(F.count_if(~F.col("is_current")).alias("excluded"), F.count("*").alias("all"))
    return _with_actions(now.unionByName(ever), idle, out)


def _with_actions(views: DataFrame, idle: DataFrame, totals: DataFrame) -> DataFrame:
    """Views with what their figures call for; ``idle`` and ``totals`` have one row each."""
    one = idle.withColumn("view", F.lit("current")).join(totals.withColumn("view", F.lit("current")), "view")
    rows = views.join(one, "view", "left")
    current, n = F.col("view") == "current", F.col("events")
    idle_ids = F.when(current & (n > 0), F.col("stale")).otherwise(F.array().cast("array<string>"))
    said = (
        F.when(current & (F.col("all") == 0), "no events yet"),
        F.when(current & (F.col("all") > 0) & (n == 0), "no events of the current snapshot"),
        F.when(current & (n > 0) & (F.col("matched") == 0), "no prompt matched a card"),
        F.when(F.size(idle_ids) > 0, F.concat(F.lit("review stale cards: "), F.array_join(idle_ids, ", "))),
    )
    return rows.select("view", "events", "matched", "rendered_events", "match_rate", "render_rate", "no_hit_rate", F.when(current, F.col("excluded")).alias("excluded"), idle_ids.alias("stale"), F.array_compact(F.array(*said)).alias("actions"))


def source_state(rows: DataFrame, by: list[str], text: str, counted: dict[str, Column]) -> DataFrame:
    """Rows, conditional counts, bytes in sum and at most of the texts of each group."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *[F.count_if(c).alias(name) for name, c in counted.items()], F.sum(size).alias("bytes"), F.max(size).alias("largest"))


def storage_audit(spark, path: str, role: Column) -> DataFrame:
    """Files and bytes below a folder by ``role`` (an expression over ``path``), from the listing alone: no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.groupBy(role.alias("role")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("length").alias("largest"))
