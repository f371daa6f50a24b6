"""Shared helpers: reading tables, Arrow batches, held-out split."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.tables import discard, materialize  # noqa: F401  (what the operators write and drop tables with)

#: Rows in one Arrow batch handed to Python.  Texts may be long, so batches stay small.
ARROW_ROWS = 1000
#: Bytes in one Arrow batch handed to Python.
ARROW_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry whole texts, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves 2 mod 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """Rows that a model may learn from: a known id outside the held-out quarter."""
    return doc_id.isNotNull() & ~held_out(doc_id)


_ARROW = {"double": "float64", "integer": "int32", "long": "int64", "string": "string", "boolean": "bool_"}


def private(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with columns named by place, so that no added column can clash, and its text's name."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))), f"c{docs.columns.index('text')}"


def add_columns(docs: DataFrame, new: dict[str, str], fn: Callable[[list], list], carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """``carry`` columns of ``docs`` (all by default) and ``new`` ones (name to Spark type), which
    ``fn`` makes from the list of texts of an Arrow batch.  Same-named old columns are replaced;
    carried columns pass through untouched, so nulls and large integers stay exact."""
    small_batches(docs.sparkSession)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in new]
    read_as = text if text in carry else "__text"
    while read_as != text and read_as in carry:
        read_as += "_"
    read = docs.select(*carry) if read_as == text else docs.select(*carry, F.col(text).alias(read_as))
    schema = docs.select(*carry).schema
    for name, kind in new.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = fn(batch.column(read_as).to_pylist())
                arrays = [pa.array(v, getattr(pa, _ARROW[kind])()) for v, kind in zip(made, new.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + arrays, names=[*carry, *new])

    return read.mapInArrow(run, schema)


def _running(group: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names, copies = batch.column(group), batch.column("copies").to_numpy()
            starts = np.append(names[0].as_py() != last, pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False))
            before = seen + np.cumsum(copies) - copies
            at = before - np.maximum.accumulate(np.where(starts, before, 0))
            last, seen = names[-1].as_py(), int(at[-1] + copies[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(np.full(len(at), part, np.int32))], names=[*batch.schema.names, "at", "part"])

    return run


def numbered(rows: DataFrame, group: str, order: list[Column], label: str) -> DataFrame:
    """Distinct rows of ``rows`` with ``copies``, ``at`` (how many rows of their group come before the first copy) and
    ``total`` (rows of the group).

    ``group`` is a string without nulls.  Rows are ordered by ``order``, then by all columns, so only equal rows tie, and
    those count as one before anything is shuffled by range.  Each range numbers its own rows; how many rows
    earlier ranges hold is added from a table of one row for each range and group in it.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    by = [F.col(group), *order, *map(F.col, rows.columns)]
    schema = T.StructType([*counted.schema, T.StructField("at", T.LongType()), T.StructField("part", T.IntegerType())])
    placed = materialize(counted.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_running(group), schema), label)
    held = placed.groupBy("part", group).agg(F.sum("copies").alias("n"))
    whole = Window.partitionBy(group)
    ahead = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held.select("part", group, ahead.alias("ahead"), F.sum("n").over(whole).alias("total"))
    return placed.join(offsets, ["part", group]).select(*rows.columns, "copies", (F.col("at") + F.col("ahead")).alias("at"), "total")
