"""Joining texts to their metadata by title, exactly and nearly."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import scalar_or_empty
from .lineage import cut


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 x twice the common subsequence over both lengths; 100 for two empty texts."""
    both = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / both if both else 100.0


_RESERVED = frozenset("\0\1")


def ratios(left: Sequence[str], right: Sequence[str], at_once: int = 4096) -> np.ndarray:
    """:func:`ratio` of each pair; where the shorter text has 64 characters at most, many pairs a step."""
    out = np.zeros(len(left))
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(left, right)]
    short = [i for i, (a, b) in enumerate(pairs) if 0 < len(a) <= 64 and not _RESERVED.intersection(a, b)]
    for i in set(range(len(pairs))) - set(short):
        out[i] = ratio(*pairs[i])
    short.sort(key=lambda i: len(pairs[i][1]))
    for at in range(0, len(short), at_once):
        here = short[at : at + at_once]
        a, b = [pairs[i][0] for i in here], [pairs[i][1] for i in here]
        table, wide = (np.array(t, f"U{w}").view(np.uint32).reshape(len(t), w) for t, w in ((a, 64), (b, len(b[-1]))))
        wide[wide == 0] = 1  # behind the longer text; 0 is behind the shorter one
        if max(table.max(), wide.max()) < 256:
            table, wide = table.astype(np.uint8), wide.astype(np.uint8)
        n, m = np.array([len(x) for x in a]), np.array([len(y) for y in b])
        rows = np.full(len(here), np.iinfo(np.uint64).max)
        for j in range(wide.shape[1]):
            masks = np.packbits(table == wide[:, j, None], axis=1, bitorder="little").view(np.uint64).ravel()
            hit = rows & masks
            rows = (rows + hit) | (rows - hit)
        unset = np.bitwise_count(~rows & (np.iinfo(np.uint64).max >> (64 - n).astype(np.uint64)))
        out[here] = 200.0 * unset / (n + m)
    return out


def first_by_title(metadata: DataFrame, title: str, order: str) -> DataFrame:
    w = Window.partitionBy(title).orderBy(order)
    return metadata.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def _most_edits(n: int, m: int, threshold: float) -> int:
    """Insertions and deletions between texts of these lengths that the threshold allows."""
    return int((n + m) * (100.0 - threshold) / 100.0 + 1e-9)


@lru_cache(maxsize=65536)
def _needed(n: int, q: int, threshold: float) -> int:
    """The least number of q-grams that a text of ``n`` characters shares with any text that matches it; 0 or less if maybe none.

    An insertion or deletion changes q grams at most.
    """
    slack = (200.0 - threshold) / threshold
    lengths = range(max(1, math.ceil(n / slack - 1e-9)), int(n * slack + 1e-9) + 1)
    return min(max(n, m) - q + 1 - q * _most_edits(n, m, threshold) for m in lengths)


def _gram_length(threshold: float) -> int:
    return 3 if threshold >= 90 else 2 if threshold >= 80 else 1


def _gram_sets(text: str, threshold: float) -> list[tuple[list[str], int]]:
    """(grams, size of the prefix) for each gram length that the text is compared by.

    Long texts are compared by q-grams, short ones, which could match without a
    common q-gram, by characters; near the border a text has both. Repeats of a
    gram are numbered, so the lists are sets.
    """
    n, q = len(text), _gram_length(threshold)
    slack = (200.0 - threshold) / threshold
    border = _border(q, threshold)
    lengths = ([q] if n * slack >= border else []) + ([1] if q > 1 and n / slack < border else [])
    out = []
    for k in lengths:
        seen: dict[str, int] = {}
        grams = []
        for i in range(n - k + 1):
            gram = text[i : i + k]
            seen[gram] = seen.get(gram, 0) + 1
            grams.append(f"{k}:{seen[gram]}:{gram}")
        if grams:
            out.append((grams, max(1, min(len(grams), len(grams) - max(1, _needed(n, k, threshold)) + 1))))
    return out


@lru_cache(maxsize=64)
def _border(q: int, threshold: float) -> int:
    """The least length from which on texts that match always share a q-gram."""
    return next((n for n in range(1, 10_000) if all(_needed(m, q, threshold) >= 1 for m in range(n, n + 40))), 10_000)


_ODD, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _spelled(text: str) -> tuple[int, np.ndarray]:
    """The hash of a text, and the different ones of the text without each of its characters, in time linear in the text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    c = (c ^ (c << np.uint64(23))) * np.uint64(0xBF58476D1CE4E5B9)
    powers = np.cumprod(np.full(len(c), _ODD, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c ^ (c >> np.uint64(31))) * powers)])
    less = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(_INVERSE)
    return int(sums[-1:].view(np.int64)[0]), np.unique(less.view(np.int64))


def _score():
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(ratios(a.to_list(), b.to_list()), dtype="float64")

    return score("stem", "title")


def _one_off(stems: DataFrame, titles: DataFrame, threshold: float) -> DataFrame:
    """(stem, title, score): all pairs of equal texts, or with one character more in one of them, that reach the threshold.

    Texts meet by the hashes of what is left without one character, so rows grow
    with the characters, and pairs with the result; all pairs are verified.
    """

    @F.pandas_udf("own long, less array<long>")
    def spelled(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in texts:
            yield pd.DataFrame([_spelled(t or "") for t in column], columns=["own", "less"])

    a, b = (cut(df.select(name, spelled(name).alias("h")).select(name, "h.*")) for df, name in ((stems, "stem"), (titles, "title")))
    longer = b.select(F.col("own").alias("b"), F.explode(F.array_append("less", F.col("own"))).alias("a")).join(a.select(F.col("own").alias("a")).distinct(), "a")
    shorter = a.select(F.col("own").alias("a"), F.explode("less").alias("b")).join(b.select(F.col("own").alias("b")).distinct(), "b")
    pairs = longer.select("a", "b").union(shorter.select("a", "b")).distinct()
    pairs = pairs.join(a.select(F.col("own").alias("a"), "stem"), "a").join(b.select(F.col("own").alias("b"), "title"), "b")
    n, m = F.length("stem"), F.length("title")
    scored = pairs.where(F.abs(n - m) <= 1).select("stem", "title").withColumn("score", _score())
    return scored.where((F.col("score") >= threshold) & (F.col("score") == F.lit(200.0) * F.least(n, m) / (n + m)))


def _best(scored: DataFrame, titles: DataFrame) -> DataFrame:
    best = scored.join(titles.select("title", "pos"), "title").groupBy("stem").agg(F.max(F.struct("score", (-F.col("pos")).alias("turn"), "title")).alias("b"))
    return best.select("stem", "b.title", "b.score")


def near_titles(left: DataFrame, titles: DataFrame, threshold: float = 95.0) -> DataFrame:
    """(stem, title, score): the best title of each stem with at least ``threshold``, ties to the smaller ``pos``.

    ``titles`` has title and pos; ``threshold`` is above 50. A title that differs
    from a stem of three characters or more by one added or missing character has
    a higher ratio than all that differ by more, so stems with such titles are
    settled by them; only the others are compared by grams.
    """
    stems, known = left.select("stem").distinct(), titles.select("title").distinct()
    near = cut(_best(_one_off(stems.where(F.length("stem") >= 3), known, threshold), titles))
    rest = cut(stems.join(near.select("stem"), "stem", "left_anti"))
    return near if rest.isEmpty() else near.unionByName(_best(_by_grams(rest, known, threshold), titles))


def _by_grams(stems: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(stem, title, score): all pairs of distinct stems and titles that reach the threshold.

    Two texts of that ratio share most of their q-grams. With each text's grams
    in one order, rare ones first, they have one in common among the first few
    of both: only these prefixes are joined. Candidates whose lengths can't match
    are left out before they are scored. Empty texts match each other.
    """
    slack = (200.0 - threshold) / threshold

    @F.pandas_udf("array<struct<prefix:int,grams:array<string>>>")
    def gram_sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in texts:
            yield pd.Series([[{"prefix": p, "grams": g} for g, p in _gram_sets(t or "", threshold)] for t in column], dtype=object)

    def exploded(df: DataFrame, name: str) -> DataFrame:
        sets = df.select(name, F.explode(gram_sets(name)).alias("s")).withColumn("k", F.substring(F.col("s.grams")[0], 1, 1))
        return sets.select(name, "k", "s.prefix", F.explode("s.grams").alias("gram"))

    stem_grams, title_grams = cut(exploded(stems, "stem")), cut(exploded(known, "title"))
    often = cut(title_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often")))

    def prefixes(grams: DataFrame, name: str) -> DataFrame:
        rated = grams.join(often, "gram", "left").groupBy(name, "k", "prefix").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("o"), "gram"))).alias("g"))
        return rated.select(name, F.explode(F.transform(F.slice("g", F.lit(1), F.col("prefix")), lambda g: g["gram"])).alias("gram"))

    pairs = prefixes(stem_grams, "stem").join(prefixes(title_grams, "title"), "gram")
    near = (F.length("stem") <= F.length("title") * slack) & (F.length("title") <= F.length("stem") * slack)
    # as many tasks as a shuffle has: a pair is few bytes and much work
    parts = int(stems.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.where(near).select("stem", "title").repartition(parts, "stem", "title").distinct()
    empty = stems.where("stem = ''").join(known.where("title = ''"))  # one row each at most
    return pairs.unionByName(empty).withColumn("score", _score()).where(F.col("score") >= threshold)


def attach_metadata(texts: DataFrame, metadata: DataFrame, title: str = "Article Title", order: str = "pos", threshold: float = 95.0) -> DataFrame:
    """Texts (stem, full_text) with ``matched_title`` and ``match_score``: exact first, then near, else nulls."""
    known = metadata.where(F.col(title).isNotNull()).select(F.col(title).alias("title"), F.col(order).alias("pos"))
    known = known.groupBy("title").agg(F.min("pos").alias("pos"))
    exact = texts.join(known.select(F.col("title").alias("stem")), "stem", "left_semi")
    rest = texts.join(known.select(F.col("title").alias("stem")), "stem", "left_anti")
    near = near_titles(rest, known, threshold)
    out = exact.withColumn("matched_title", F.col("stem")).withColumn("match_score", F.lit(100.0))
    return out.unionByName(rest.join(near.select("stem", F.col("title").alias("matched_title"), F.col("score").alias("match_score")), "stem", "left"))


#: The fields of an article record, in its order.
ARTICLE_FIELDS = (
    "Full Text", "Article Title", "Source Title", "Keywords Plus", "Abstract", "Publisher", "Publication Year", "DOI", "Open Access Designations",
)


def article_records(matched: DataFrame, metadata: DataFrame, title: str = "Article Title", order: str = "pos") -> DataFrame:
    """stem and the nine fields of each matched text: the metadata of its title's first row, and the text itself.

    Missing fields and values are empty. ``matched`` is what :func:`attach_metadata` gives.
    """
    first = first_by_title(metadata.where(F.col(title).isNotNull()), title, order)
    value = lambda name: scalar_or_empty(F.col(f"`{name}`")) if name in first.columns else F.lit("")
    known = first.select(F.col(title).alias("matched_title"), *[value(name).alias(name) for name in ARTICLE_FIELDS[1:]])
    found = matched.where(F.col("matched_title").isNotNull()).join(known, "matched_title")
    return found.select("stem", F.col("full_text").alias("Full Text"), *ARTICLE_FIELDS[1:])


def unmatched(matched: DataFrame) -> DataFrame:
    return matched.where(F.col("matched_title").isNull()).select("stem")
