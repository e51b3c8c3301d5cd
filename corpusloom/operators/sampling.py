"""Deterministic shuffles, draws and counts."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prompts import QUESTION_TYPES


def turn(seed: int, key: Column) -> Column:
    """A shuffling order that any machine computes alike."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def shuffled_types(df: DataFrame, group: Sequence[str], key: str, seed: int = 42, types: Sequence[str] = QUESTION_TYPES) -> DataFrame:
    """Add shuffled_index (from 0, inside the group) and question_type, both by the digest of seed and key."""
    w = Window.partitionBy(*group).orderBy(turn(seed, F.col(key)), key)
    pick = F.conv(F.substring(turn(seed + 1, F.col(key)), 1, 8), 16, 10).cast("long") % len(types)
    return df.withColumn("shuffled_index", F.row_number().over(w) - 1).withColumn("question_type", F.element_at(F.array(*map(F.lit, types)), (pick + 1).cast("int")))


def mersenne_types(df: DataFrame, group: Sequence[str], order: Sequence[str], seed: int = 42, types: Sequence[str] = QUESTION_TYPES) -> DataFrame:
    """The same columns from Python's generator: a seeded shuffle of each group and a seeded choice at each place.

    One group is one task here; use :func:`shuffled_types` for large groups.
    """
    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        import random

        rows = list(range(len(pdf)))
        pdf = pdf.sort_values(list(order)).reset_index(drop=True)
        random.Random(seed).shuffle(rows)
        out = pdf.iloc[rows].copy()
        out["shuffled_index"] = range(len(out))
        out["question_type"] = [random.Random(seed + i).choice(list(types)) for i in range(len(out))]
        return out

    schema = df.withColumn("shuffled_index", F.lit(0).cast("long")).withColumn("question_type", F.lit("")).schema
    return df.groupBy(*group).applyInPandas(draw, schema)


def pick_examples(cells: DataFrame, pool: DataFrame, generated: DataFrame, seed: int = 42, enough: int = 3) -> DataFrame:
    """Examples (cat, sub, kind, origin, instruction, input, output) for each cell (cat, sub, kind).

    One from the cell's own pool, one of another cell of its kind and, where the
    cell has ``enough`` generated samples, one of those; each the first by digest.
    The other cell's example needs two rows per kind only, so no pairs are made.
    """
    sample = ("instruction", "input", "output")
    order = turn(seed, F.concat_ws("\u0001", "cat", "sub", *sample))

    def first(df: DataFrame, keys: Sequence[str], k: int = 1) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(order)
        return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k)

    keys = ("cat", "sub", "kind")
    own = cells.join(first(pool, keys), list(keys)).select(*keys, F.lit("local").alias("origin"), *sample)
    # the first of the kind, and the first of the kind outside that one's cell
    best = first(pool, keys).drop("__k")
    two = first(best, ("kind",), 2).select("kind", F.col("cat").alias("oc"), F.col("sub").alias("os"), "__k", *sample)
    other = cells.join(two, "kind").where((F.col("cat") != F.col("oc")) | (F.col("sub") != F.col("os")))
    other = other.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("__k"))).where("__r = 1")
    other = other.select(*keys, F.lit("other").alias("origin"), *sample)
    many = generated.groupBy(*keys).count().where(F.col("count") >= enough).select(*keys)
    new = cells.join(many, list(keys)).join(first(generated, keys), list(keys)).select(*keys, F.lit("generated").alias("origin"), *sample)
    return own.unionByName(other).unionByName(new)


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
