"""Teacher generation with resumption, amplification and merging of triples."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import prompts as T
from . import sampling
from .lineage import cut


#: The names of a record's category fields, in the order in which they are asked.
MAJOR_KEYS = ("major_category", "major categories", "major_category_name")
SUB_KEYS = ("sub_category", "sub-categories", "sub_category_name")


def category_groups(records: DataFrame, record: str = "record") -> DataFrame:
    """major, sub, text and source of variant records: blank texts go, unknown categories are "unknown"."""
    r = F.col(record)
    out = records.withColumns({
        "major": P.nested_value(r, MAJOR_KEYS), "sub": P.nested_value(r, SUB_KEYS),
        "text": P.blank_to_null(F.try_variant_get(r, "$.text", "string")),
    })
    return out.where(F.col("text").isNotNull())


def seed_groups(*parts: DataFrame | None) -> DataFrame:
    """major, sub, text and source of records that may come from several places; blank texts go.

    Seeds (with major, sub and source, as :func:`corpusloom.sources.files.seed_directory`
    gives them) keep the names of their folder and file; other records, those of a
    retrieved file, are grouped by their category fields, as source "retrieved".
    """
    out = []
    for part in parts:
        if part is None:
            continue
        if {"major", "sub"} <= set(part.columns):
            text = P.blank_to_null(F.try_variant_get("record", "$.text", "string"))
            out.append(part.select("major", "sub", text.alias("text"), "source").where("text is not null"))
        else:
            out.append(category_groups(part).select("major", "sub", "text", F.lit("retrieved").alias("source")))
    if not out:
        raise ValueError("there are no input records")
    return reduce(DataFrame.unionByName, out)


def at_least_rank(df: DataFrame, rank: str, least: int = 3) -> DataFrame:
    """Rows whose rank is a whole number of at least ``least``; others count as 0."""
    return df.where(F.coalesce(F.try_to_number(F.col(rank), F.lit("999999999")).cast("int"), F.lit(0)) >= least)


def with_prompts(items: DataFrame, seed: int = 42, key: str = "text") -> DataFrame:
    """Shuffle each (major, sub) group, give each row a question type and its prompt."""
    typed = sampling.shuffled_types(items, ("major", "sub"), key, seed)
    return typed.withColumn("prompt", T.generation_prompt(F.col("question_type"), F.col("major"), F.col("sub"), F.col("text")))


def pending(items: DataFrame, results: DataFrame | None, keys: list[str]) -> DataFrame:
    """Items that have no result yet."""
    return items if results is None else items.join(results.select(*keys).distinct(), keys, "left_anti")


def require_same_run(results: DataFrame, fingerprint: str) -> DataFrame:
    """Earlier results; an error when they are read if they were made by other inputs or settings."""
    bad = F.col("fingerprint") != fingerprint
    return results.where(F.when(bad, F.raise_error(F.lit("the results belong to another run")).cast("boolean")).otherwise(True))


def generate(items: DataFrame, provider: Callable[[Column], Column]) -> DataFrame:
    """Items with response, error and the parsed triple (null where the provider failed)."""
    said = items.withColumn("__said", provider(F.col("prompt"))).select("*", "__said.response", "__said.error").drop("__said")
    return said.withColumn("triple", P.parse_response(F.col("response")))


def require_complete(df: DataFrame) -> DataFrame:
    """The rows; an error when they are read if one has failed. For the sink."""
    failed = F.col("error").isNotNull() | F.col("triple").isNull()
    message = F.concat(F.lit("generation failed: "), F.coalesce("error", F.lit("no valid triple")))
    return df.where(F.when(failed, F.raise_error(message).cast("boolean")).otherwise(True))


def amplify(cells: DataFrame, pool: DataFrame, provider: Callable[[Column], Column], per_cell: int = 10, seed: int = 42, enough: int = 3) -> DataFrame:
    """Generate until each cell (cat, sub, kind) has ``per_cell`` samples; a failure or a lack of examples ends its cell.

    Each round writes one sample for every open cell at once, so there are
    ``per_cell`` rounds; rows are written down, so a round is never generated twice.
    """
    spark = cells.sparkSession
    sample = ("instruction", "input", "output")
    made = spark.createDataFrame([], pool.select("cat", "sub", "kind", *sample).schema)
    open_cells = cells
    for n in range(per_cell):
        have = made.groupBy("cat", "sub", "kind").agg(F.count(F.lit(1)).alias("have"))
        open_cells = open_cells.join(have, ["cat", "sub", "kind"], "left").where(F.coalesce("have", F.lit(0)) < per_cell).drop("have")
        examples = sampling.pick_examples(open_cells, pool, made, seed + n, enough).groupBy("cat", "sub", "kind").agg(F.collect_list(F.struct(*sample)).alias("examples"))
        prompted = examples.withColumn("prompt", T.example_prompt(F.col("kind"), F.col("cat"), F.col("sub"), F.col("examples")))
        said = prompted.withColumn("triple", P.parse_fenced_response(provider(F.col("prompt"))["response"])).where("triple is not null")
        new = cut(said.select("cat", "sub", "kind", "triple.*"))
        if new.limit(1).count() == 0:
            break
        made = cut(made.unionByName(new))
        open_cells = cut(open_cells.join(new.select("cat", "sub", "kind").distinct(), ["cat", "sub", "kind"], "left_semi"))
    return made
