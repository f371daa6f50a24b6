"""Scoring corpus: postings, document frequencies, field lengths, and BM25F over them.

Statistics depend on the cards that apply to a prompt, so every table carries a ``scope`` key; one
scope is the plain case.  Prompts meet cards only through shared tokens (an equi-join), never by a
cross product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.scoring import bm25_idf

#: Weights of the fields (fixed values), and BM25's parameters.
FIELD_WEIGHTS = {"title": 4.2, "triggers": 6.0, "aliases": 5.2, "topics": 3.0, "intentModes": 2.2, "requiredSignals": 2.4, "category": 1.8, "summary": 1.5}
K1, B = 1.2, 0.75


def field_rows(cards: DataFrame, fields: dict[str, Column], keys: list[str]) -> DataFrame:
    """One row per card and field with its text."""
    return cards.select(*keys, F.inline(F.array(*[F.struct(F.lit(name).alias("field"), text.alias("text")) for name, text in fields.items()])))


def postings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Term frequencies by card, field and token."""
    return T.explode_tokens(rows, F.col("text"), *keys, "field").groupBy(*keys, "field", "token").agg(F.count("*").alias("tf"))


def document_frequency(posted: DataFrame, scope: list[str], key: str) -> DataFrame:
    """Cards that hold a token in any field."""
    return posted.select(*scope, key, "token").distinct().groupBy(*scope, "token").agg(F.count("*").alias("df"))


def token_frequency(cards: DataFrame, fields: list[Column], scope: list[str]) -> DataFrame:
    """``document_frequency`` straight from the cards: distinct tokens are found within each row, so tokens are
    shuffled once, as counts."""
    found = cards.select(*scope, F.explode(T.tokens(F.concat_ws("\n", *fields))).alias("token"))
    return found.groupBy(*scope, "token").agg(F.count("*").alias("df"))


def field_lengths(rows: DataFrame, posted: DataFrame, scope: list[str]) -> DataFrame:
    """Mean tokens of a field over all cards, empty fields included, at least 1; ``n`` cards."""
    n = rows.groupBy(*scope, "field").agg(F.count("*").alias("n"))
    total = posted.groupBy(*scope, "field").agg(F.sum("tf").alias("total"))
    average = F.greatest(F.coalesce("total", F.lit(0)) / F.col("n"), F.lit(1.0))
    return n.join(total, [*scope, "field"], "left").select(*scope, "field", "n", average.alias("average"))


def token_weights(posted: DataFrame, average: DataFrame, df: DataFrame, key: str, weights: dict[str, float] | None = None, scope: list[str] | None = None) -> DataFrame:
    """What each token of each card is worth, whatever the query: scope, key, ``token``, ``wtf`` and ``idf``.

    ``posted`` has ``field``, ``token``, ``tf`` and the field's ``length``; ``average`` is as from ``field_lengths``, ``df`` as from
    ``document_frequency``."""
    weights, scope = weights or FIELD_WEIGHTS, scope or []
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    part = weight[F.col("field")] * F.col("tf") / (1 - B + B * F.col("length") / F.col("average"))
    held = posted.join(average, [*scope, "field"]).groupBy(*scope, key, "token").agg(F.sum(part).alias("wtf"), F.max("n").alias("n"))
    return held.join(df, [*scope, "token"]).withColumn("idf", bm25_idf(F.col("n"), F.col("df"))).select(*scope, key, "token", "wtf", "idf")


def with_lengths(posted: DataFrame, keys: list[str]) -> DataFrame:
    return posted.withColumn("length", F.sum("tf").over(Window.partitionBy(*keys, "field")))


def bm25f(query_tokens: DataFrame, rows: DataFrame | None, key: str, weights: dict[str, float] | None = None, scope: list[str] | None = None, pairs: DataFrame | None = None, kept: DataFrame | None = None) -> DataFrame:
    """``raw_score`` of every prompt and card that share a token.

    ``query_tokens``: scope columns, ``prompt_id``, ``token``, ``weight``.  ``rows``: as from ``field_rows``,
    one per card and field.  ``pairs`` (scope columns, ``prompt_id`` and the key), if given, are the only ones that are scored.
    ``kept``: token weights that a kept corpus holds, instead of ``rows``.
    """
    scope = scope or []
    if kept is None:
        posted = postings(rows, [*scope, key])
        average = field_lengths(rows, posted, scope)  # a few rows per scope
        kept = token_weights(with_lengths(posted, [*scope, key]), average, document_frequency(posted, scope, key), key, weights, scope)
    value = F.col("weight") * F.col("idf") * ((K1 + 1) * F.col("wtf") / (K1 + F.col("wtf")))
    if pairs is None:
        met = query_tokens.join(kept, [*scope, "token"])
    else:
        met = query_tokens.join(pairs.select(*scope, "prompt_id", key).hint("merge"), [*scope, "prompt_id"]).join(kept, [*scope, key, "token"])
    return met.groupBy(*scope, "prompt_id", key).agg(F.sum(value).alias("raw_score"))


def top_k(scores: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group with their ``rank``; Spark cuts groups before the shuffle."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
