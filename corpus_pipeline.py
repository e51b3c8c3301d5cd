"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last keep
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontamination, language_id, line_dedup, near_dedup, packing
from corpusloom.llm.common import discard, materialise, scratch

STAGES = [
    ("language_id", language_id.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("decontamination", decontamination.stage),
    ("packing", packing.stage),
]

#: A learned model and token ids are not SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; a stage's tables are deleted once the next one has been written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs, path = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep(path)
        discard(spark, *before)
        before = [path]
    return docs
