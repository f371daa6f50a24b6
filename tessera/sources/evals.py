"""Evaluation suites: JSON files of cases and card fixtures as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STRINGS = "array<string>"
CASE = (
    f"struct<id:string,difficulty:string,prompt:string,expectedCards:{_STRINGS},unexpectedCards:{_STRINGS},allowedExtraCards:{_STRINGS},"
    f"expectNoMatches:boolean,threshold:double,cwd:string,tags:{_STRINGS}>"
)
FIXTURE = (
    "struct<id:string,status:string,title:string,category:string,summary:string,rule:string,"
    f"criteria:struct<use_when:{_STRINGS},ignore_when:{_STRINGS},intent_modes:struct<include:{_STRINGS},exclude:{_STRINGS}>>,"
    f"engine_hints:struct<positive:{_STRINGS},required_all:{_STRINGS},negative:{_STRINGS}>,"
    f"recall:struct<policy:string,risk:string,confidence:string,triggers:{_STRINGS},topics:{_STRINGS},aliases:map<string,{_STRINGS}>>,"
    "scope:struct<level:string,project_key:string,projectKey:string,module_path:string,modulePath:string>>"
)
SUITE = f"struct<name:string,experiencesFile:string,cases:array<{CASE}>,experiences:array<{FIXTURE}>>"


def read_suites(spark: SparkSession, path: str) -> DataFrame:
    """Suite files below a path: ``file``, ``value`` (the JSON text)."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), "value")


def cases(suites: DataFrame) -> DataFrame:
    """One row per case of each suite (``file``, ``value``), with its ``place``.  A suite without a list of cases fails the job."""
    parsed = F.from_json("value", SUITE)
    rows = suites.select("file", parsed.alias("s")).select("file", F.coalesce("s.name", F.element_at(F.split("file", "/"), -1)).alias("suite"), "s.cases")
    checked = F.when(F.col("cases").isNull(), F.raise_error(F.concat(F.lit("a recall suite must contain cases[]: "), "file"))).otherwise(F.lit(0))
    none = F.array().cast(_STRINGS)
    ids = lambda c: F.coalesce(F.col(f"c.{c}"), none)
    return rows.where(checked == 0).select("suite", "file", F.posexplode("cases").alias("place", "c")).select(
        "suite",
        "file",
        "place",
        F.col("c.id").alias("case_id"),
        F.coalesce("c.difficulty", F.lit("unknown")).alias("difficulty"),
        F.col("c.prompt").alias("text"),
        ids("expectedCards").alias("ids"),
        ids("unexpectedCards").alias("unexpected"),
        ids("allowedExtraCards").alias("allowed"),
        F.coalesce("c.expectNoMatches", F.lit(False)).alias("expect_none"),
        F.col("c.threshold").alias("threshold"),
        F.col("c.cwd").alias("cwd"),
        ids("tags").alias("tags"),
    )


def fixtures(suites: DataFrame) -> DataFrame:
    """Card fixtures of each suite, or of fixture files (a list, or an object with ``experiences``), as card columns."""
    listed = F.startswith(F.ltrim("value"), F.lit("["))
    found = F.when(listed, F.from_json("value", f"array<{FIXTURE}>")).otherwise(F.from_json("value", SUITE)["experiences"])
    return suites.select("file", F.explode(found).alias("x")).select("file", *[v.alias(k) for k, v in fixture_columns(F.col("x")).items()])


def fixture_columns(x: Column) -> dict[str, Column]:
    """Card columns of a fixture record, with their defaults."""
    none = F.array().cast(_STRINGS)
    some = lambda c: F.coalesce(c, none)
    text = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))
    r, c, e, s = x["recall"], x["criteria"], x["engine_hints"], x["scope"]
    return {
        "card_id": x["id"],
        "status": text(x["status"], "active"),
        "title": text(x["title"], ""),
        "category": text(x["category"], "未分类"),
        "summary": text(x["summary"], ""),
        "rule": text(x["rule"], ""),
        "triggers": some(r["triggers"]),
        "negative_triggers": some(c["ignore_when"]),
        "aliases": some(F.flatten(F.map_values(r["aliases"]))),
        "topics": some(r["topics"]),
        "include": some(c["intent_modes"]["include"]),
        "exclude": some(c["intent_modes"]["exclude"]),
        "required_any": some(e["positive"]),
        "required_all": some(e["required_all"]),
        "blocked": some(e["negative"]),
        "level": text(s["level"], "global"),
        "project_key": F.coalesce(s["project_key"], s["projectKey"]),
        "module_path": F.coalesce(s["module_path"], s["modulePath"]),
        "recall_policy": text(r["policy"], "should"),
        "risk": text(r["risk"], "medium"),
        "confidence": text(r["confidence"], "medium"),
    }


def contract(case: DataFrame) -> Column:
    """What a case promises, as text: prompt, card ids (sorted, once each), flags and place."""
    ids = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), "\x1e")
    or_none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    return F.concat_ws("\x1f", or_none("case_id"), F.coalesce("text", F.lit("")), ids("ids"), ids("unexpected"), ids("allowed"), F.col("expect_none").cast("string"), or_none("threshold"), or_none("cwd"))


def suite_fingerprint(case: DataFrame) -> DataFrame:
    """``suite`` and ``fingerprint`` of its cases in their order."""
    parts = F.sort_array(F.collect_list(F.struct("place", F.sha2(contract(case), 256).alias("h"))))
    return case.groupBy("suite").agg(parts.alias("p")).select("suite", F.sha2(F.concat_ws("\n", "suite", F.array_join(F.transform("p", lambda x: x["h"]), "\n")), 256).alias("fingerprint"))
