"""Sections of standards: chunk ids, long-section splitting, prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import blank_to_null

MOST_TOKENS = 4096


def file_id(stem: Column) -> Column:
    """The leading digits of a file's stem, else the stem."""
    return F.coalesce(F.nullif(F.regexp_extract(stem, r"^(\d+)", 1), F.lit("")), stem)


def chunk_ids(sections: DataFrame) -> DataFrame:
    """Add chunk_id to sections (source_file, stem, pos, section_id, content).

    Rows without an id or content go first; the nth repeat of an id gets ``.n``,
    counted over all files in path order.
    """
    s = sections.withColumn("section_id", blank_to_null(F.col("section_id"))).withColumn("content", blank_to_null(F.col("content")))
    s = s.where("section_id is not null and content is not null").withColumn("__base", F.concat_ws(".", file_id(F.col("stem")), "section_id"))
    n = F.row_number().over(Window.partitionBy("__base").orderBy("source_file", "pos")) - 1
    return s.withColumn("chunk_id", F.when(n == 0, F.col("__base")).otherwise(F.concat_ws(".", "__base", n.cast("string")))).drop("__base")


def require_unique(df: DataFrame, column: str) -> DataFrame:
    """The rows; an error when they are read if two have the same value."""
    n = F.count(F.lit(1)).over(Window.partitionBy(column))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit(f"duplicate {column}: "), F.col(column).cast("string"))).cast("string"))
    return df.withColumn("__checked", checked).where("__checked is null").drop("__checked")


@dataclass(frozen=True)
class SplitPlan:
    most_tokens: int = 3500
    overlap: int = 200

    def __post_init__(self) -> None:
        if not 1 <= self.most_tokens <= MOST_TOKENS or self.overlap < 0:
            raise ValueError("most_tokens must be within 1 and 4096 and overlap not negative")


def split_text(text: str, count: Callable[[str], int], plan: SplitPlan) -> list[tuple[int, int]]:
    """Ranges of a text that fit, each as long as possible, ending after a line in its second half if one ends there.

    A part's end is sought from the size of the part before it, first by doubling,
    so a search counts a few parts' length, however long the text is.
    """
    if count(text) <= plan.most_tokens:
        return [(0, len(text))]
    parts, at, size = [], 0, 4 * plan.most_tokens
    while True:
        fits, fails = at, len(text) + 1
        probe = min(len(text), at + size)
        while fails > len(text) and probe > fits:  # upwards to an end that fails, or the text's
            if count(text[at:probe]) <= plan.most_tokens:
                fits, probe = probe, min(len(text), at + 2 * (probe - at))
            else:
                fails = probe
        while fails - fits > 1:
            probe = (fits + fails) // 2
            if count(text[at:probe]) <= plan.most_tokens:
                fits = probe
            else:
                fails = probe
        if fits == at:
            raise ValueError("not even one character fits")
        if fits < len(text):
            line = text.rfind("\n", at + (fits - at) // 2, fits) + 1
            if line > 0 and count(text[at:line]) <= plan.most_tokens:
                fits = line
        parts.append((at, fits))
        size = fits - at
        if fits >= len(text):
            return parts
        at = max(at + 1, fits - min(plan.overlap, (fits - at) // 2))


def words_as_tokens() -> Callable[[str], int]:
    """Stand-in tokenizer."""
    return lambda text: len(text.split())


def counted_by(load: Callable[[], Callable[[list], list]]) -> Callable[[], Callable[[str], int]]:
    """A counter of a tokenizer's tokens; ``load`` gives a function from texts to lists of tokens."""

    def start() -> Callable[[str], int]:
        tokenize = load()
        return lambda text: len(tokenize([text])[0])

    return start


def split_long_sections(chunks: DataFrame, load: Callable[[], Callable[[str], int]] = words_as_tokens, plan: SplitPlan = SplitPlan(), content: str = "content") -> DataFrame:
    """chunk_id, content, parent_chunk_id, part_index, char_start and char_end; the last four are null for sections that fit."""
    columns = [c for c in chunks.columns if c not in ("chunk_id", content)]

    @F.pandas_udf("array<struct<s:int,e:int>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = load()
        for texts in batches:
            yield pd.Series([[{"s": s, "e": e} for s, e in split_text(t, count, plan)] for t in texts], dtype=object)

    parts = chunks.withColumn("__parts", cut(F.col(content))).select("*", F.posexplode("__parts").alias("__k", "__p"))
    split = F.size("__parts") > 1
    text = F.substring(F.col(content), F.col("__p.s") + 1, F.col("__p.e") - F.col("__p.s"))
    return parts.select(
        *columns,
        F.when(split, F.concat(F.col("chunk_id"), F.lit("::part"), (F.col("__k") + 1).cast("string"))).otherwise(F.col("chunk_id")).alias("chunk_id"),
        text.alias(content),
        F.when(split, F.col("chunk_id")).alias("parent_chunk_id"),
        F.when(split, F.col("__k") + 1).alias("part_index"),
        F.when(split, F.col("__p.s")).alias("char_start"),
        F.when(split, F.col("__p.e")).alias("char_end"),
    )


def require_budget(df: DataFrame, tokens: str, new_tokens: int, context: int) -> DataFrame:
    """The rows; an error when a prompt and its answer don't fit the context."""
    bad = F.col(tokens) + new_tokens > context
    checked = F.when(bad, F.raise_error(F.concat(F.lit("over the token budget: "), F.col(tokens).cast("string"))).cast("string"))
    return df.withColumn("__checked", checked).where("__checked is null").drop("__checked")
