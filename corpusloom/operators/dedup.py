"""Exact and near-duplicate removal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import TRIPLE
from ..functions.text import strip
from ..functions.workers import few_rows, tidy
from .graph import similarity_components
from .lineage import cut


def exact_triples(df: DataFrame, order: Sequence[str], dedup: bool = True) -> DataFrame:
    """Valid triples, stripped; of equal ones the first by ``order`` if ``dedup``."""
    bare = df.select(*order, *[strip(F.col(c)).alias(c) for c in TRIPLE]).where(" and ".join(f"length({c}) > 0" for c in TRIPLE))
    if not dedup:
        return bare
    first = bare.groupBy(*TRIPLE).agg(F.min(F.struct(*order)).alias("__first"))
    return first.select("__first.*", *TRIPLE)


def _signatures(ngram: int, hashes: int, rows: int):
    rng = np.random.default_rng(42)
    a, b = rng.integers(1, 1 << 60, hashes, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 60, hashes, dtype=np.uint64)

    @F.pandas_udf("shingles array<long>, bands array<long>")
    @tidy
    def describe(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import re

        word = re.compile(r"\w+")
        for column in texts:
            out = []
            for text in column:
                ws = word.findall((text or "").lower())
                grams = {" ".join(ws[i : i + ngram]) for i in range(len(ws) - ngram + 1)}
                s = np.array(sorted(int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little") for g in grams), np.uint64)
                if not len(s):
                    out.append(([], []))
                    continue
                least = np.full(hashes, np.iinfo(np.uint64).max)
                for at in range(0, len(s), 4096):  # bounds the table of a long text
                    h = s[at : at + 4096, None] * a + b
                    least = np.minimum(least, (h ^ (h >> np.uint64(31))).min(axis=0))
                parts = least.reshape(-1, rows)
                band = np.arange(len(parts), dtype=np.uint64)
                for k in range(rows):
                    band = (band ^ parts[:, k]) * np.uint64(0x9E3779B97F4A7C15)
                    band ^= band >> np.uint64(29)
                out.append((s.view(np.int64), band.view(np.int64)))
            yield pd.DataFrame(out, columns=["shingles", "bands"])

    return describe


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.75, ngram: int = 5, hashes: int = 128, rows: int = 4) -> DataFrame:
    """Pairs (a, b) with a Jaccard similarity of at least ``threshold`` between distinct word n-grams.

    Exact copies are represented by their smallest id, so pairs are between
    different texts; :func:`near_duplicate_groups` adds the copies. Candidates
    share a band of minhashes; each is verified on the n-gram hashes. The result
    is the pairs themselves, so a group of k near copies has up to k squared rows:
    use :func:`near_duplicate_groups` to drop duplicates.
    """
    few_rows(df.sparkSession)
    rep = df.where(F.col(text_col).isNotNull()).groupBy(F.sha2(text_col, 256).alias("h")).agg(F.min(F.struct(id_col, text_col)).alias("r"))
    described = rep.select(F.col(f"r.{id_col}").alias("id"), _signatures(ngram, hashes, rows)(F.col(f"r.{text_col}")).alias("d"))
    described = cut(described.select("id", "d.shingles", "d.bands").where(F.size("shingles") > 0))
    bands = described.select("id", F.explode("bands").alias("band"), F.size("shingles").alias("n"))
    left, right = bands.select("band", F.col("id").alias("a"), F.col("n").alias("na")), bands.select("band", F.col("id").alias("b"), F.col("n").alias("nb"))
    pairs = left.join(right, "band").where("a < b").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb")).select("a", "b").distinct()
    sets = described.select("id", "shingles")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    similarity = common / (F.size("sa") + F.size("sb") - common)
    return both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.75, ngram: int = 5, hashes: int = 128, rows: int = 4) -> DataFrame:
    """The id, its component (the smallest id of its group) and kept, for each row; null texts are alone.

    Links are found bucket by bucket, so a large group of near copies never makes
    its pairs; see :func:`corpusloom.operators.graph.similarity_components`.
    """
    few_rows(df.sparkSession)
    reps = df.where(F.col(text_col).isNotNull()).groupBy(F.sha2(text_col, 256).alias("h")).agg(F.min(F.struct(id_col, text_col)).alias("r"))
    described = cut(reps.select("h", F.col(f"r.{id_col}").alias("id"), _signatures(ngram, hashes, rows)(F.col(f"r.{text_col}")).alias("d")).select("h", "id", "d.*"))
    members = cut(described.select("id", F.size("shingles").alias("n"), F.explode("bands").alias("bucket")))
    id_type = df.schema[id_col].dataType.simpleString()
    found, _ = similarity_components(
        members, described.select("id", F.col("shingles").alias("z")), round(100 * threshold), id_type, lambda: lambda column: [np.asarray(z, np.int64).view(np.uint64) for z in column]
    )
    each = df.select(id_col, F.sha2(text_col, 256).alias("h")).join(described.select("h", F.col("id").alias("rep")), "h", "left")
    each = each.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", id_col)
    return each.select(id_col, component.alias("component"), (component == F.col(id_col)).alias("kept"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
