"""Staged exports of a session spool as tables and streams.

An export is a folder of JSON files, one session each, on any file system that Spark reads.  ``sessions`` gives one row per file
(``parse_session``), as a table or, with ``stream``, as a stream that takes each file once and whose checkpoint remembers which.  Sessions above
``max_bytes`` are rows with a reason and nothing else, and their files are not read; files that are no session are rows with a
reason too.  ``search`` and ``show`` look into them.  ``SpoolSource`` is the same as a Python data source, for folders that all executors mount.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, session_id string, provider string, source_path string, started_at string, cwd string, messages int, hash string, issue string"
VISIBLE = ("user", "assistant", "tool")
MAX_BYTES, FILES_PER_TASK = 2 << 20, 256


def _first(record: dict, *names: str) -> str | None:
    return next((str(record[n]) for n in names if record.get(n)), None)


def said_in(raw: dict) -> list[tuple[str, str]]:
    """Roles and texts of what is visible in a session."""
    session = raw.get("session") or raw
    listed = raw.get("messages") or session.get("messages") or []
    said = [(str(m.get("role") or "user"), _first(m, "contentText", "text", "content") or "") for m in listed if isinstance(m, dict)]
    return [(role, t) for role, t in said if t and role in VISIBLE]


def parse_session(raw: object) -> dict | None:
    """A session's columns; None if the JSON is no session.  The hash covers its id, path and visible texts."""
    session = raw.get("session") or raw if isinstance(raw, dict) else None
    if not isinstance(session, dict):
        return None
    texts = [t for _, t in said_in(raw)]
    key, path = _first(session, "sessionUuid", "uuid", "id"), _first(session, "filePath", "sourcePath") or ""
    digest = hashlib.sha256(f"{key}:{path}:{chr(10).join(texts)}".encode("utf-8", "surrogatepass")).hexdigest()
    return {
        "session_id": key or hashlib.sha256(digest.encode()).hexdigest()[:16],
        "provider": f"spool:{_first(session, 'source') or 'unknown'}",
        "source_path": path,
        "started_at": _first(session, "startedAt", "createdAt"),
        "cwd": _first(session, "cwd", "projectDisplayPath"),
        "messages": len(texts),
        "hash": digest,
    }


_TEXT = ("session_id", "provider", "source_path", "started_at", "cwd")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, texts = [], []
        for value in batch.column("value").to_pylist():
            try:
                raw = json.loads(value or "")
                row = parse_session(raw)
            except ValueError:
                row = None
            found.append(row or {})
            texts.append([t for _, t in said_in(raw)] if row else None)
        columns = [pa.array([r.get(c) for r in found], pa.string()) for c in _TEXT]
        columns += [pa.array([r.get("messages") for r in found], pa.int32()), pa.array([r.get("hash") for r in found], pa.string())]
        columns += [pa.array(texts, pa.list_(pa.string())), pa.array([None if r else "no-session" for r in found], pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("file"), *columns], names=["file", *_TEXT, "messages", "hash", "texts", "issue"])


def sessions(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, stream: bool = False) -> DataFrame:
    """``SCHEMA`` with the visible ``texts`` of each session below ``path``; equal whether it is read as a table or a stream."""
    reader = (spark.readStream if stream else spark.read).format("text").schema("value string").option("wholetext", True)
    files = reader.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(path)
    small = F.col("_metadata.file_size") <= max_bytes
    file = F.col("_metadata.file_path").alias("file")
    schema = SCHEMA.replace("hash string,", "hash string, texts array<string>,")
    read = files.where(small).select(file, "value").mapInArrow(_parsed, schema)
    large = files.where(~small).select(file, F.lit("too-large").alias("issue"))
    return read.unionByName(large, allowMissingColumns=True)


def search(found: DataFrame, words: str) -> DataFrame:
    """Sessions of which a text holds ``words``, whatever their case, with the first such text as ``hit``."""
    hits = F.filter("texts", lambda t: F.contains(F.lower(t), F.lit(words.lower())))
    return found.withColumn("hit", F.get(hits, 0)).where(F.col("hit").isNotNull())


def show(found: DataFrame, session_id: str) -> DataFrame:
    """Texts of a session in order: ``place`` and ``text``."""
    return found.where(F.col("session_id") == session_id).select(F.posexplode("texts").alias("place", "text"))


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file://")
        self.limit = int(options.get("maxBytes", MAX_BYTES))

    def partitions(self) -> list[InputPartition]:
        files = sorted(os.path.join(at, f) for at, _, names in os.walk(self.folder) for f in names if f.endswith(".json"))
        return [_Files(files[k : k + FILES_PER_TASK]) for k in range(0, len(files), FILES_PER_TASK)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        names = ("session_id", "provider", "source_path", "started_at", "cwd", "messages", "hash")
        for file in partition.files:
            row, issue = None, None
            if os.path.getsize(file) > self.limit:
                issue = "too-large"
            else:
                try:
                    with open(file, encoding="utf-8") as f:
                        row = parse_session(json.load(f))
                except ValueError:
                    pass
                issue = None if row else "no-session"
            yield (file, *[(row or {}).get(n) for n in names], issue)


class SpoolSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
