"""The engine's scores and its message search as functions of Spark SQL: ``register(spark)``, then ``SELECT jaccard(a, b)``;
``register_search(spark, table)``, then ``SELECT * FROM search_messages('some words')``.

They are SQL functions, so their bodies are inlined into a query's plan.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, arguments, what it returns and its body.
FUNCTIONS = (
    ("jaccard", "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0.0D ELSE size(array_intersect(a, b)) / CAST(size(array_union(a, b)) AS DOUBLE) END"),
    ("overlap_coefficient", "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0.0D ELSE size(array_intersect(a, b)) / CAST(least(size(array_distinct(a)), size(array_distinct(b))) AS DOUBLE) END"),
    ("noisy_or", "v ARRAY<DOUBLE>", "DOUBLE", "100 * (1 - aggregate(v, 1.0D, (acc, x) -> acc * (1 - least(greatest(x, 0.0D), 100.0D) / 100)))"),
    ("rrf", "a BIGINT, b BIGINT", "DOUBLE", "floor(1000 * (1.0D / (60 + a) + 1.0D / (60 + b)) * 100 + 0.5D) / 100"),
    (
        "message_score",
        "text STRING, words STRING",
        "INT",
        """(SELECT CASE WHEN w = '' THEN 0 WHEN contains(t, w) THEN 100 + length(w) WHEN forall(split(w, ' '), x -> contains(t, x)) THEN 10 + length(replace(w, ' ')) ELSE 0 END
        FROM (SELECT trim(regexp_replace(lower(coalesce(text, '')), '\\\\s+', ' ')) AS t, trim(regexp_replace(lower(coalesce(words, '')), '\\\\s+', ' ')) AS w))""",
    ),
    ("dcg", "relevant ARRAY<INT>", "DOUBLE", "aggregate(transform(relevant, (x, i) -> x / log2(i + 2.0D)), 0.0D, (acc, x) -> acc + x)"),
)


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for name, arguments, returns, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")


def register_search(spark: SparkSession, table: str, session: str = "session_id", place: str = "place", name: str = "search_messages") -> None:
    """A table function ``name(words)`` over a table or view with ``text`` and the columns that name a message's session and place.

    It gives every message that the words occur in, with its score; a caller's ``ORDER BY ... LIMIT`` keeps the best of each partition before it merges them."""
    kinds = dict(spark.table(table).dtypes)
    register(spark)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(words STRING) RETURNS TABLE({session} {kinds[session]}, {place} {kinds[place]}, text STRING, score INT)
        RETURN SELECT * FROM (SELECT m.{session}, m.{place}, m.text, message_score(m.text, {name}.words) AS score FROM {table} m) WHERE score > 0"""
    )
