"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.workers import small_batches  # noqa: F401  for the operators
from ..operators.lineage import discard, materialise, scratch, shared_dir  # noqa: F401  for the operators
from . import bloom


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32(doc_id as text) mod ``folds``; null ids count as the text "null"."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % folds


def hash_share(column: Column, share: float | Column, salt: int = 0) -> Column:
    """True for about ``share`` of the values, the same ones at every run."""
    spread = 1 << 24
    share = share if isinstance(share, Column) else F.lit(float(share))
    return F.pmod(F.xxhash64(F.lit(salt), column), F.lit(spread)) < share * F.lit(float(spread))


def input_bytes(df: DataFrame, text: str) -> int:
    """The optimizer's size estimate, or the bytes of ``text`` where that is a guess
    (frames without files, products of joins). Only sizes of filters and parts depend on it."""
    said = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if said < 1 << 46:
        return said
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], rank: str, spread: int) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in parallel inside a group.

    Rows go to ``spread`` hash slots by the order columns; slots are numbered by
    their sizes (a small aggregate), rows inside a slot by a window. A group
    with a third of all rows is thus ranked by many tasks. ``df`` is read twice.
    """
    cut = df.withColumn("__slot", F.pmod(F.xxhash64(*order), F.lit(spread)).cast("int"))
    sizes = cut.groupBy(*group, "__slot").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "__slot", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*group, "__slot").orderBy(*order)
    numbered = cut.withColumn("__k", F.row_number().over(inside) - 1)
    return (
        numbered.join(starts, [*group, "__slot"])
        .withColumn(rank, F.col("__start") + F.col("__k"))
        .drop("__slot", "__start", "__k")
    )


def marked(docs: DataFrame, keys: DataFrame, *on: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose values ``on`` may be a row of ``keys``, and the others.

    A broadcast filter of the keys' hashes tells, so rows need no shuffle for it.
    ``keys`` is read twice; ``docs`` is read by each of the two frames.
    """
    hashed = keys.select(F.xxhash64(*keys.columns).alias("h"))
    found = bloom.filter_of(hashed, lambda pdf: pdf["h"].to_numpy(np.int64).view(np.uint64), bloom.bits_for(hashed.count()))
    shared = docs.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("boolean")
    def has(column: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(column.to_numpy(np.int64).view(np.uint64)))

    test = has(F.xxhash64(*on))
    return docs.where(test), docs.where(~test)


def without(docs: DataFrame, keys: DataFrame, *on: Column) -> DataFrame:
    """The rows of ``docs`` whose values ``on`` are no row of ``keys``; only rows that may be one are shuffled."""
    keys, _ = materialise(keys.distinct(), "gone")
    some, others = marked(docs, keys, *on)
    names = [f"__on_{k}" for k in range(len(on))]
    left = some.withColumns(dict(zip(names, on))).join(keys.toDF(*names), names, "left_anti")
    return left.select(*docs.columns).unionByName(others)


def tokenizer_path(name: str) -> str:
    """Where the vocabulary file ``name`` lies; a path is passed through."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
