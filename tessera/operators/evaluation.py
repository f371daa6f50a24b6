"""Retrieval evaluation: case metrics, roll-ups and the comparison of two reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scoring import rounded


def case_metrics(expected: DataFrame, ranked: DataFrame, limit: int) -> DataFrame:
    """Precision, recall, reciprocal rank and nDCG of each case.

    ``expected``: case_id and ``ids`` (array; empty where nothing should match).  ``ranked``: case_id,
    id, rank (from 1, at most ``limit``).  A case without expected ids is right if nothing is returned.
    """
    wanted = expected.select("case_id", F.explode("ids").alias("id"), F.lit(1).alias("hit"))
    seen = ranked.join(wanted, ["case_id", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    totals = seen.groupBy("case_id").agg(
        F.count("*").alias("returned"),
        F.sum("hit").alias("hits"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    rows = expected.withColumn("wanted", F.size("ids")).join(totals, "case_id", "left")
    returned, hits = F.coalesce("returned", F.lit(0)), F.coalesce("hits", F.lit(0))
    nothing = F.col("wanted") == 0
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("wanted"), F.lit(limit)), F.lit(1))), F.lit(0.0), lambda acc, k: acc + 1 / F.log2(k + 1.0))
    right = F.when(returned > 0, 0.0).otherwise(1.0)
    return rows.select(
        *[c for c in expected.columns if c != "ids"],
        returned.alias("returned"),
        hits.alias("hits"),
        F.col("wanted"),
        rounded(F.when(returned > 0, hits / F.greatest(returned, F.lit(1))).otherwise(F.when(nothing, 1.0).otherwise(0.0)), 3).alias("precision"),
        rounded(F.when(nothing, right).otherwise(hits / F.greatest(F.col("wanted"), F.lit(1))), 3).alias("recall"),
        rounded(F.coalesce(1 / F.col("first"), F.lit(0.0)), 3).alias("reciprocal_rank"),
        rounded(F.when(nothing, right).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal), 3).alias("ndcg"),
        F.when(nothing, returned == 0).otherwise((hits == F.col("wanted")) & (returned == hits)).alias("passed"),
    )


def roll_up(cases: DataFrame, *by: str) -> DataFrame:
    """Means over cases; ranking metrics count only cases with expected ids."""
    mean = lambda c: rounded(F.coalesce(F.avg(c), F.lit(0.0)), 3)
    ranking = lambda c: F.when(F.col("wanted") > 0, F.col(c))
    return cases.groupBy(*by).agg(
        F.count("*").alias("cases"),
        mean(F.col("passed").cast("double")).alias("pass_rate"),
        mean("precision").alias("precision"),
        mean("recall").alias("recall"),
        mean(ranking("reciprocal_rank")).alias("mrr"),
        mean(ranking("ndcg")).alias("ndcg"),
        mean((F.col("returned") == 0).cast("double")).alias("no_hit_rate"),
    )


def compare(base: DataFrame, following: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Full outer comparison of two reports: drift (missing, added) and per-metric deltas; a drop is a regression."""

    def named(df: DataFrame, side: str) -> DataFrame:
        return df.select(key, F.lit(True).alias(f"in_{side}"), *[F.col(m).alias(f"{m}_{side}") for m in metrics])

    both = named(base, "base").join(named(following, "next"), key, "full_outer")
    state = F.when(F.col("in_next").isNull(), "missing").when(F.col("in_base").isNull(), "added")
    deltas = [rounded(F.col(f"{m}_next") - F.col(f"{m}_base"), 3).alias(f"{m}_delta") for m in metrics]
    worse: Column = F.lit(False)
    for m in metrics:
        worse = worse | F.coalesce(F.col(f"{m}_next") < F.col(f"{m}_base"), F.lit(False))
    return both.select(key, F.coalesce(state, F.when(worse, "regressed").otherwise("kept")).alias("state"), *deltas)


def judge_cases(cases: DataFrame, ranked: DataFrame, limit: int) -> DataFrame:
    """``case_metrics`` with a suite's judgement of extra cards: an extra card is a fault unless the case allows it.

    ``cases``: case_id, ids, unexpected, allowed (arrays), expect_none.  ``ranked``: case_id, id, rank."""
    returned = ranked.groupBy("case_id").agg(F.collect_list("id").alias("returned_ids"))  # at most ``limit`` ids
    rows = cases.join(returned, "case_id", "left").withColumn("returned_ids", F.coalesce("returned_ids", F.array().cast(dict(cases.dtypes)["ids"])))
    extra = F.array_except("returned_ids", "ids")
    rows = rows.withColumns({"false_positives": F.array_intersect(extra, "unexpected"), "allowed_extras": F.array_except(F.array_intersect(extra, "allowed"), "unexpected")})
    rows = rows.withColumn("disallowed", F.array_except(extra, "allowed_extras"))
    measured = case_metrics(cases.select("case_id", "ids"), ranked, limit).drop("passed", "precision")
    both = rows.join(measured, "case_id")
    good = F.col("hits") + F.size("allowed_extras")
    precision = F.when(F.col("returned") > 0, good / F.greatest(F.col("returned"), F.lit(1))).when(F.col("wanted") > 0, 0.0).otherwise(1.0)
    passed = F.when(F.col("expect_none"), F.col("returned") == 0).otherwise((F.col("hits") == F.col("wanted")) & (F.size("disallowed") == 0))
    return both.withColumns({"precision": rounded(precision, 2), "passed": passed, "missing": F.array_except("ids", "returned_ids")}).drop("returned_ids")


def suite_report(judged: DataFrame) -> DataFrame:
    """One row of a suite's rates over its judged cases."""
    rate = lambda c: rounded(F.avg(c.cast("double")), 2)
    ranking = lambda c: rounded(F.coalesce(F.avg(F.when(F.col("wanted") > 0, F.col(c))), F.lit(0.0)), 2)
    return judged.agg(
        F.count("*").alias("cases"),
        rate(F.col("passed")).alias("pass_rate"),
        rounded(F.avg("precision"), 2).alias("precision"),
        rounded(F.avg("recall"), 2).alias("recall"),
        ranking("reciprocal_rank").alias("mrr"),
        ranking("ndcg").alias("ndcg"),
        rate(F.size("false_positives") > 0).alias("false_positive_rate"),
        rate(F.size("disallowed") > 0).alias("over_recall_rate"),
        rate(F.col("returned") == 0).alias("no_hit_rate"),
    )


#: Bounds that a report can be held to: flag, metric and whether the metric must reach or not exceed it.
BOUNDS = {
    "min-pass-rate": ("pass_rate", "min"),
    "min-precision": ("precision", "min"),
    "min-recall": ("recall", "min"),
    "min-mrr": ("mrr", "min"),
    "max-over-recall": ("over_recall_rate", "max"),
    "max-false-positive": ("false_positive_rate", "max"),
    "max-no-hit": ("no_hit_rate", "max"),
}


def threshold_gates(report: DataFrame, bounds: dict[str, float], *keys: str) -> DataFrame:
    """``keys``, ``flag``, ``expected``, ``actual`` and ``passed`` of each bound; a missing metric counts as 0."""
    rows = []
    for flag, expected in bounds.items():
        metric, direction = BOUNDS[flag]
        actual = F.coalesce(F.col(metric), F.lit(0.0)) if metric in report.columns else F.lit(0.0)
        rows.append(F.struct(F.lit(flag).alias("flag"), F.lit(float(expected)).alias("expected"), actual.cast("double").alias("actual"), (actual >= expected if direction == "min" else actual <= expected).alias("passed")))
    return report.select(*keys, F.inline(F.array(*rows)))


#: What two reports must share to be comparable, and what of it must be there at all.
IDENTITY = ("suite", "engine_version", "scorer_version", "suite_fingerprint", "card_set_fingerprint", "config_fingerprint", "limit", "threshold")


def comparable_reports(base: DataFrame, following: DataFrame) -> DataFrame:
    """``field`` and ``issue`` (missing or drift) of what keeps two reports (a row each) from being compared; none if they
    are comparable.  A field that either lacks fails, so nothing is compared by accident."""
    def told(df: DataFrame, side: str) -> DataFrame:
        values = [F.struct(F.lit(f).alias("field"), (F.nullif(F.trim(F.col(f).cast("string")), F.lit("")) if f in df.columns else F.lit(None).cast("string")).alias(side)) for f in IDENTITY]
        return df.select(F.inline(F.array(*values)))

    both = told(base, "before").join(told(following, "after"), "field", "full_outer")
    issue = F.when(F.col("before").isNull() | F.col("after").isNull(), "missing").when(F.col("before") != F.col("after"), "drift")
    return both.select("field", issue.alias("issue"), "before", "after").where("issue is not null")
