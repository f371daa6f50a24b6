"""Conversation messages: search, context around a hit, ordered session hashes, carried columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources import sessions


def normalize_search(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def search_score(text: Column, query: str) -> Column:
    """100 and its length if the whole query occurs, else 10 and the lengths of its words if all occur, else 0."""
    whole = " ".join(query.lower().split())
    if not whole:
        return F.lit(0)
    normal = normalize_search(text)
    words = whole.split(" ")
    every = F.lit(True)
    for w in words:
        every = every & F.contains(normal, F.lit(w))
    return F.when(F.contains(normal, F.lit(whole)), 100 + len(whole)).when(every, 10 + sum(map(len, words))).otherwise(0)


def search(messages: DataFrame, query: str, order: list[Column], k: int) -> DataFrame:
    """Best messages; Spark keeps k rows of each partition (no full sort)."""
    return messages.withColumn("score", search_score(F.col("text"), query)).where("score > 0").orderBy(F.desc("score"), *order).limit(k)


def snippet(text: Column, query: str, before: int = 80, after: int = 120) -> Column:
    """The text around the first place of a query, from ``before`` characters ahead of it."""
    at = F.greatest(F.instr(F.lower(text), query.lower()), F.lit(1))
    return F.substring(text, F.greatest(at - before, F.lit(1)), F.least(at, F.lit(before + 1)) - 1 + after)


def context(messages: DataFrame, hits: DataFrame, session: str, position: str, n: int) -> DataFrame:
    """Messages within ``n`` places of each hit, by an equi-join on session and place."""
    around = hits.select(session, F.col(position).alias("hit"), F.explode(F.sequence(F.col(position) - n, F.col(position) + n)).alias(position))
    return messages.join(around, [session, position])


def session_hash(messages: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Hash of a session's messages in order, folded in two levels (``sessions.ordered_hash``)."""
    placed = messages.withColumn("__place", F.row_number().over(Window.partitionBy(session).orderBy(*order)))
    line = F.concat(F.coalesce("role", F.lit("")), F.lit("\x00"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return sessions.ordered_hash(placed, [session], "__place", line)


def carry_forward(rows: DataFrame, column: str, by: list[str], order: list[Column]) -> DataFrame:
    """The last known value of a column up to each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))
