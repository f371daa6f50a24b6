"""Corpus pipeline over ``documents``: toxicity, language, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the
shared folder and rereads it as the next stage's documents.  All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import language_id, mixing, near_copies, packing, toxicity
from tessera.llm.common import materialize, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("language_id", language_id.stage),
    ("simhash_near_dedup", near_copies.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: SQL cannot express trained models; tests compare ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that pass all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
