"""Conversation logs: JSON lines of several hosts as one table of visible messages.

Lines are read with their file and place; a line that is no JSON goes to a dead-letter table.  Role and
text are looked up under the names that hosts use.  All of it runs in the JVM but the walk through nested texts.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Where hosts put a message's role, text, time and folder.
ROLE_PATHS = ("$.role", "$.item.role", "$.payload.item.role", "$.payload.message.role", "$.message.role", "$.payload.role")
TEXT_PLACES = (("item",), ("item", "content"), ("payload", "item"), ("payload", "message"), ("payload", "content"), ("message",), ("message", "content"), ("content",), ("text",), ("payload",))
TIME_PATHS = ("$.timestamp", "$.created_at", "$.createdAt", "$.message.createdAt")
CWD_PATHS = ("$.cwd", "$.working_directory", "$.current_dir", "$.session.cwd", "$.message.cwd")
VISIBLE = ("user", "assistant", "tool")
ALIASES = {"human": "user", "ai": "assistant"}
# Fields of a record that hold text, or more records.
TEXT_KEYS = ("text", "content", "message", "summary", "output_text", "contentText", "arguments", "input", "tool_input", "toolInput", "parameters")
#: Messages whose hashes are hashed together before a session's hash.
HASH_BLOCK = 1024


def read_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """``file``, ``line`` (from 1; blank lines don't count) and ``value`` of all files below a folder.

    Spark's reader splits long files; lines are counted within a split, and the numbers of a file's
    earlier splits are added, so no task holds a whole file.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.rtrim("value", F.lit("\r")).alias("value"))
    rows = rows.where(F.trim("value") != "")
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("lines"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    offsets = counts.select("file", "block", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("file", "block").orderBy("n"))
    return rows.withColumn("within", within).join(offsets, ["file", "block"]).select("file", (F.col("offset") + F.col("within")).alias("line"), "value")


def strict(lines: DataFrame) -> DataFrame:
    """The lines, none of which may be other than a JSON object: the job fails at the first that is."""
    fine = F.coalesce(F.try_parse_json("value").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{")), F.lit(False))
    said = F.concat_ws(":", F.lit("invalid JSON line"), *[F.col(c).cast("string") for c in ("file", "line") if c in lines.columns])
    return lines.withColumn("value", F.when(fine, F.col("value")).otherwise(F.raise_error(said).cast("string")))


def split_json(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that are JSON objects, and the others as a dead-letter table."""
    fine = F.coalesce(F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{"), F.lit(False))
    return lines.where(fine), lines.where(~fine).withColumn("issue", F.lit("invalid-json"))


def _first(value: Column, paths: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(value, p), F.lit("")) for p in paths])


def role_of(value: Column) -> Column:
    kind = F.get_json_object(value, "$.type")
    raw = F.lower(F.coalesce(_first(value, ROLE_PATHS), F.when(kind.isin(*VISIBLE), kind), F.lit("unknown")))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])[raw], raw)


def _collect(value: object, out: list[str]) -> None:
    """Texts of a JSON value, in order: strings, items of lists, and the TEXT_KEYS of records, however deep."""
    if isinstance(value, str):
        out.append(value)
    elif isinstance(value, list):
        for item in value:
            _collect(item, out)
    elif isinstance(value, dict):
        for key in TEXT_KEYS:
            _collect(value.get(key), out)


def line_text(line: str | None) -> str:
    """Distinct texts of a line with a blank line between; empty where the line is no JSON object."""
    try:
        event = json.loads(line or "")
    except ValueError:
        return ""
    found: list[str] = []
    for place in TEXT_PLACES:
        at = event
        for key in place:
            at = at.get(key) if isinstance(at, dict) else None
        _collect(at, found)
    return "\n\n".join(dict.fromkeys(t.strip() for t in found if t.strip()))


@F.pandas_udf(StringType())
def _line_texts(lines: pd.Series) -> pd.Series:
    return lines.map(line_text)


def text_of(value: Column) -> Column:
    """``line_text`` of a column: records nest without bound, so this runs in Arrow batches."""
    return _line_texts(value)


def clean_user_text(text: Column) -> Column:
    """Text without injected instruction and context blocks."""
    plain = F.regexp_replace(text, r"(?s)<(environment_context|user_instructions|instructions|system-reminder)\b[^>]*>.*?</\1>", "")
    return F.regexp_replace(F.regexp_replace(plain, r"(?s)# AGENTS\.md instructions for.*?(?:</environment_context>|</INSTRUCTIONS>)", ""), r"^\s+|\s+$", "")


def session_of(file: Column, provider: Column) -> Column:
    """The file's name, or a hash of its path where the name says nothing."""
    base = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"(?i)\.jsonl$", "")
    return F.when((base != "") & (base != "session"), base).otherwise(F.concat(provider, F.lit("-"), F.substring(F.sha1(file), 1, 16)))


def visible_messages(lines: DataFrame, provider: str) -> DataFrame:
    """provider, session_id, file, line, role, text, created_at, cwd (carried forward within a file) and ``id`` of user messages."""
    good, _ = split_json(lines)
    value = F.col("value")
    rows = good.select("file", "line", role_of(value).alias("role"), text_of(value).alias("raw"), _first(value, TIME_PATHS).alias("created_at"), _first(value, CWD_PATHS).alias("own_cwd"))
    carried = F.last("own_cwd", ignorenulls=True).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"cwd": carried, "provider": F.lit(provider), "text": F.when(F.col("role") == "user", clean_user_text(F.col("raw"))).otherwise(F.col("raw"))})
    key = F.concat_ws("\x00", "provider", "file", F.col("line").cast("string"), "text")
    kept = rows.where(F.col("role").isin(*VISIBLE) & (F.col("text") != ""))
    return kept.select("provider", session_of(F.col("file"), F.col("provider")).alias("session_id"), "file", "line", "role", "text", "created_at", "cwd", F.when(F.col("role") == "user", F.substring(F.sha1(key), 1, 16)).alias("id"))


def user_index(messages: DataFrame) -> DataFrame:
    """The user messages that a search reads."""
    return messages.where("role = 'user'")


def index_report(messages: DataFrame) -> DataFrame:
    """Sessions, files and messages of each provider."""
    return messages.groupBy("provider").agg(F.count_distinct("session_id").alias("sessions"), F.count_distinct("file").alias("files"), F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages"))


def read_user_index(rows: DataFrame) -> DataFrame:
    """A stored user index with its columns restored: empty texts are dropped, missing ids are made anew."""
    have = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in rows.columns else F.lit(d)
    kept = rows.withColumn("text", F.trim(have("text", ""))).where("text <> ''")
    kept = kept.withColumns({"provider": have("provider", "unknown"), "session_id": have("session_id", ""), "file": have("file", ""), "line": have("line", "0").cast("int"), "role": F.lit("user")})
    made = F.substring(F.sha1(F.concat_ws("\x00", "provider", "file", F.col("line").cast("string"), "text")), 1, 16)
    given = F.nullif(have("id", ""), F.lit("")) if "id" in rows.columns else F.lit(None).cast("string")
    optional = [F.nullif(have(c, ""), F.lit("")).alias(c) for c in ("created_at", "cwd")]
    return kept.select("provider", "session_id", "file", "line", "role", "text", *optional, F.coalesce(given, made).alias("id"))


def ordered_hash(rows: DataFrame, by: list[str], place: str, line: Column) -> DataFrame:
    """``by`` and ``hash`` of each group's lines in order of ``place`` (unique in a group, from 1): hashes of HASH_BLOCK
    neighbouring places are hashed together, then those, so no task collects a group's texts."""
    hashed = rows.select(*by, place, F.sha2(line, 256).alias("h"), F.floor((F.col(place) - 1) / HASH_BLOCK).alias("block"))
    joined = lambda c, k: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k, c))), lambda x: x[c]), "")
    blocks = hashed.groupBy(*by, "block").agg(F.sha2(joined("h", place), 256).alias("h"))
    return blocks.groupBy(*by).agg(F.sha2(joined("h", "block"), 256).alias("hash"))


def session_records(messages: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """One row per file: the first known folder and time, counts of messages, and an order-true hash (texts stay out).

    With ``sizes`` (file, bytes) the hash also covers a file's path and size, so a moved or grown file is a new one."""
    by = ["provider", "session_id", "file"]
    grouped = messages.groupBy(*by).agg(
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line"))).alias("cwd"),
        F.min_by("created_at", F.when(F.col("created_at").isNotNull(), F.col("line"))).alias("started_at"),
        F.count("*").alias("messages"),
    )
    hashes = ordered_hash(messages, by, "line", F.concat("role", F.lit("\x00"), "text", F.lit("\n")))
    rows = grouped.join(hashes, by)
    if sizes is None:
        return rows
    head = F.concat("file", F.lit(":"), F.col("bytes").cast("string"), F.lit(":"), "hash")
    return rows.join(sizes.select("file", "bytes"), "file").withColumn("hash", F.sha2(head, 256)).drop("bytes")


# ---------------------------------------------------------------- source catalogue


def catalog(lines: DataFrame) -> DataFrame:
    """Stored session records (JSON objects in ``value``) of any age with the columns of today's catalogue; others are dropped."""
    v = F.col("value")
    field = lambda *names: _first(v, tuple(f"$.{n}" for n in names))
    good, _ = split_json(lines)
    counted = F.size(F.from_json(F.get_json_object(v, "$.messages"), "array<string>"))
    return good.select(
        field("id").alias("session_id"),
        F.coalesce(field("provider"), F.lit("unknown")).alias("provider"),
        field("sourcePath", "source_path").alias("source_path"),
        field("startedAt", "started_at").alias("started_at"),
        field("cwd").alias("cwd"),
        F.coalesce(field("summary"), F.lit("")).alias("summary"),
        field("metadataHash", "metadata_hash").alias("hash"),
        F.coalesce(field("messageCount", "message_count").cast("int"), F.when(counted >= 0, counted), F.lit(0)).alias("messages"),
    ).where("session_id is not null")


def by_start(sources: DataFrame) -> list[Column]:
    """Order of sources: when they began, then provider and id."""
    return [F.coalesce("started_at", F.lit("")), F.concat_ws(":", "provider", "session_id")]
