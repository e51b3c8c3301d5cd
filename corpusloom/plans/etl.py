"""Declarative ETL: a list of named steps with arguments, resolved in a registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.dedup import near_duplicate_groups

REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def step(name: str):
    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY[name] = f
        return f

    return register


@dataclass(frozen=True)
class Step:
    name: str
    args: dict[str, Any] = field(default_factory=dict)


@step("ingest_parquet")
def ingest_parquet(spark: SparkSession, df: DataFrame | None, path: list[str]) -> DataFrame:
    return spark.read.parquet(*path)


@step("near_dedup")
def near_dedup(spark: SparkSession, df: DataFrame, subset: str, threshold: float, ngram_size: int) -> DataFrame:
    """One row of each group of near-duplicates, by a digest of the text; rows without text stay."""
    keyed = df.withColumn("__id", F.sha2(subset, 256))
    groups = near_duplicate_groups(keyed.select("__id", subset).where(F.col(subset).isNotNull()).distinct(), "__id", subset, threshold, ngram_size)
    kept = keyed.join(groups.where("kept").select("__id"), "__id", "left_semi").dropDuplicates(["__id"])
    return kept.unionByName(keyed.where(F.col(subset).isNull())).drop("__id")


def _on(subset: str, df: DataFrame, f: Callable) -> DataFrame:
    return df.withColumn(subset, f(F.col(subset)))


step("remove_accent")(lambda spark, df, subset: _on(subset, df, X.remove_accents))
step("normalize_whitespace")(lambda spark, df, subset: _on(subset, df, X.normalize_whitespace))
step("remove_unprintable")(lambda spark, df, subset: _on(subset, df, X.remove_unprintable))
step("trim_sections")(lambda spark, df, subset: _on(subset, df, X.trim_sections))
step("split_by_word")(lambda spark, df, subset, word_per_chunk: X.split_by_word(df, subset, word_per_chunk))
step("split_by_sentence_block")(lambda spark, df, subset, min_words=10: X.split_by_sentence_block(df, subset, min_words))
step("filter_language")(lambda spark, df, subset, predict, threshold=0.65: X.keep_language(df, subset, predict, "en", threshold))


@step("save_parquet")
def save_parquet(spark: SparkSession, df: DataFrame, save_path: str) -> DataFrame:
    df.write.mode("errorifexists").parquet(save_path)
    return spark.read.parquet(save_path)


def article_plan(source: str | None, target: str | None, subset: str = "Full Text", language_filter: bool = False, predict: Callable | None = None) -> list[Step]:
    """The steps for article texts; the language filter needs a predictor."""
    if language_filter and predict is None:
        raise ValueError("the language filter needs a predictor")
    steps = [
        Step("near_dedup", {"subset": subset, "threshold": 0.75, "ngram_size": 5}),
        Step("remove_accent", {"subset": subset}),
        Step("normalize_whitespace", {"subset": subset}),
        Step("remove_unprintable", {"subset": subset}),
        *([Step("filter_language", {"subset": subset, "predict": predict})] if language_filter else []),
        Step("trim_sections", {"subset": subset}),
        Step("split_by_word", {"subset": subset, "word_per_chunk": 300}),
    ]
    first = [Step("ingest_parquet", {"path": [source]})] if source else []
    return first + steps + ([Step("save_parquet", {"save_path": target})] if target else [])


def run(spark: SparkSession, plan: list[Step], df: DataFrame | None = None) -> DataFrame:
    for s in plan:
        df = REGISTRY[s.name](spark, df, **s.args)
    return df
