"""Registration of queries with their DuckDB equivalents, and shared SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.text import STOPWORDS, WORD

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) under a name."""

    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"


def sql_tokens(relation: str, ids: str, text: str) -> str:
    """Subquery with a row (ids, tok) for each token, repeats included."""
    return f"""(SELECT {ids}, tok FROM (SELECT {ids}, unnest(
      CASE WHEN regexp_matches(v, '^[一-鿿]') THEN CASE WHEN length(v) <= 2 THEN [v] ELSE list_concat([v], list_transform(range(1, length(v)), lambda i: substr(v, i, 2))) END
        WHEN regexp_matches(v, '[._/-]') THEN list_concat([v], list_filter(regexp_split_to_array(v, '[._/-]+'), lambda p: length(p) > 1)) ELSE [v] END) AS tok
      FROM (SELECT {ids}, regexp_replace(w, '[./-]+$', '') AS v FROM (SELECT {ids}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '{WORD}')) AS w FROM {relation}))
      WHERE v <> '' AND v NOT IN {STOP}) WHERE tok NOT IN {STOP})"""


PROMPTS = "(SELECT conv_id * 1000 + turn AS prompt_id, text FROM conversations WHERE role = 'user')"
