"""Corpus assembly: column choice, merging, prefix limits, guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, strip

#: The columns that may hold a text, best first.
PAPER_COLUMNS = ("Abstract1", "Abstract", "text", "Full Text1", "Full Text")
OTHER_COLUMNS = ("Full Text1", "Full Text", "text", "Abstract1", "Abstract")
RENAMED_COLUMNS = ("Full Text1", "Full Text", "Abstract1", "Abstract")


def choose_text_column(columns: Sequence[str], file_name: str) -> str | None:
    """The text column of a file, by its name and schema; None if it has none."""
    order = PAPER_COLUMNS if "source_papers" in file_name.lower() else OTHER_COLUMNS
    return next((c for c in order if c in columns), None)


def with_text_column(df: DataFrame) -> DataFrame:
    """With its text column named ``text``."""
    if "text" in df.columns:
        return df
    name = next((c for c in RENAMED_COLUMNS if c in df.columns), None)
    if name is None:
        raise ValueError("there is no supported text column")
    return df.withColumnRenamed(name, "text")


def merge_corpora(literature: DataFrame, web: DataFrame) -> DataFrame:
    """text and source of both, texts unstripped, blank and missing ones left out."""
    if "text" not in web.columns:
        raise ValueError("the web corpus has no text column")
    parts = [with_text_column(literature).withColumn("source", F.lit("literature")), web.withColumn("source", F.lit("web"))]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return both.where(F.length(strip(F.col("text"))) > 0).select("text", "source")


def first_rows(df: DataFrame, order: Sequence[str], limit: int | None) -> DataFrame:
    """The first ``limit`` rows by ``order``: a top-k, so no full sort is made."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def build_sft_corpus(
    sources: DataFrame, web: DataFrame | None, min_chars: int = 10, max_sources: int | None = None, max_web: int | None = None, order: Sequence[str] = ("source_file", "pos")
) -> DataFrame:
    """stage, the order columns and text: usable source texts, then usable web texts, each up to its limit.

    Both inputs have ``text`` and the order columns; limits count usable texts.
    """
    def usable(df: DataFrame, stage: int, limit: int | None) -> DataFrame:
        kept = df.select(F.lit(stage).alias("stage"), *order, clean_text(F.col("text"), min_chars).alias("text"))
        return first_rows(kept.where(F.col("text").isNotNull()), order, limit)

    out = usable(sources, 0, max_sources)
    return out if web is None else out.unionByName(usable(web, 1, max_web))


def usable_queries(df: DataFrame) -> DataFrame:
    """Rows with a non-blank text, stripped."""
    return df.withColumn("text", strip(F.col("text"))).where(F.length("text") > 0)


def cap_per_group(expert: DataFrame, generated: DataFrame, keys: Sequence[str], order: Sequence[str], cap: int = 205) -> DataFrame:
    """The first ``cap`` rows of each group, expert rows before generated ones (a group limit, pushed below the shuffle)."""
    both = expert.withColumn("origin", F.lit(0)).unionByName(generated.withColumn("origin", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("origin", *order)
    return both.withColumn("group_rank", F.row_number().over(w)).where(F.col("group_rank") <= cap)


def distinct_dois(df: DataFrame, column: str = "DOI") -> DataFrame:
    """Distinct values, told apart before stripping."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().select(strip(F.col(column)).alias("doi"))
