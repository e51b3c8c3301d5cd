"""Connected components and verified similarity links, without pair tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import discard, materialise

Sets = Callable[[], Callable[[list], list[np.ndarray]]]


def components(edges: DataFrame, about: int | None = None) -> tuple[DataFrame, str]:
    """(id, component): the smallest id reachable over ``edges`` (a, b), for ids that have an edge and aren't smallest.

    Large-star and small-star steps in turn until nothing changes, by the count
    and two 64-bit sums of the edges; each round is a written table, so a lost
    executor never goes back further than that. Least neighbours are written
    before they are joined back: both sides of that join are then plain shuffles,
    whose partitions adaptive execution splits where a hub makes one large. The
    result's path is returned too. ``about`` is a bound on the number of edges,
    for the number of files of the first table.
    """
    spark = edges.sparkSession
    current, path = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc", about, 4)
    state, n = None, current.count()
    while n:
        both = current.union(current.select("v", "u"))
        near, near_path = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-near", 2 * n, 4)
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after, new_path = materialise(small.where("u <> v").distinct(), "cc", n, 4)
        sums = [F.bit_xor(F.xxhash64(F.lit(seed), "u", "v")) for seed in (1, 2)]
        now = tuple(after.agg(F.count(F.lit(1)), *sums).first())
        discard(spark, path, near_path)
        current, path, n = after, new_path, now[0]
        if now == state:
            break
        state = now
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")), path


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted arrays of distinct numbers have that Jaccard similarity."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    common = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)) if len(b) else 0
    return 100 * common >= percent * (len(a) + len(b) - common)


def links(sets: list[np.ndarray], percent: int, queries: int | None = None, cross: bool = False, labels: Sequence | None = None) -> list[tuple[int, int]]:
    """Similar pairs of sets, as places in the list, that connect what is not connected yet.

    Only pairs with one of the first ``queries`` sets; with ``cross`` the other
    is not one of those. Sets of equal ``labels`` count as connected already.
    """
    n = len(sets)
    queries = n if queries is None else queries
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    if labels is not None:
        first: dict = {}
        for i, label in enumerate(labels):
            parent[i] = first.setdefault(label, i)
    if n == 2:
        return [(0, 1)] if root(0) != root(1) and queries and similar(sets[0], sets[1], percent) else []
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[element] > 1
    owner, element = owner[shared], element[shared]
    order = np.argsort(element, kind="stable")
    posting, ends = owner[order], np.cumsum(np.bincount(element, minlength=len(times)))
    begins = np.searchsorted(owner, np.arange(n + 1))
    out = []
    for i in range(queries):
        own = element[begins[i] : begins[i + 1]]
        if not len(own):
            continue
        stop = ends[own]
        start = np.where(own > 0, ends[own - 1], 0)
        lengths = stop - start
        at = np.repeat(start - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        common = np.bincount(posting[at], minlength=n)
        hit = 100 * common >= percent * (sizes[i] + sizes - common)
        hit[: queries if cross else i + 1] = False
        for j in np.flatnonzero(hit).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                out.append((i, j))
    return out


def similarity_components(members: DataFrame, stored: DataFrame, percent: int, id_type: str, sets_of: Sets, most: int = 1 << 20) -> tuple[DataFrame, list[str]]:
    """(id, component) of ids linked to another, component being the smallest id reachable; and the paths that the frame reads.

    members: id, n (the size of its set) and bucket, a row for each bucket that
    an id is in; buckets of one member are fine. stored: one row (id, z) for each
    id that shares a bucket; ``sets_of`` gives, once a task, a function from a list
    of z to sorted arrays of distinct numbers.

    Every pair in a bucket is either verified on whole sets or already connected:

    1. Each bucket's members are verified against its leader, the smallest id;
       an id meets a leader once, however many buckets they share. A group of near
       copies is thus linked by as many checks as it has members.
    2. Links make components. What is left are buckets whose other members are
       not all in one component. There, the members outside the bucket's largest
       component are verified against all others, through posting lists; pairs
       inside that component never meet.

    Tasks are bounded by set elements, not by documents: a leader's members, and
    a bucket's, are cut into blocks of about ``most`` elements, and a block travels
    once for each block that it has to meet. Candidates are never chained across
    buckets, so similar but distinct texts make no giant group.
    """
    spark = members.sparkSession
    leaders, leaders_path = materialise(members.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("bucket", "a"), "sim-leaders")
    followers, followers_path = materialise(members.join(leaders, "bucket").where("id <> a").select("bucket", "a", "id", "n"), "sim-followers")
    pairs, pairs_path = materialise(followers.select("a", "id", "n").distinct(), "sim-pairs")
    total = pairs.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // most))

    # 1. against the leaders
    large, large_path = materialise(
        pairs.groupBy("a").agg(F.sum("n").alias("w")).where(F.col("w") > most).select("a", F.ceil(F.col("w") / most).cast("int").alias("k")), "sim-large", 1, 1
    )
    cut = pairs.join(large, "a", "left").withColumn("i", F.pmod(F.xxhash64("id"), F.coalesce("k", F.lit(1))).cast("int"))
    rows = cut.select("a", "i", F.lit(1).alias("side"), "id").union(cut.select("a", "i").distinct().select("a", "i", F.lit(0), "a"))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("a", "i"), F.lit(parts))).join(stored, "id")

    def against_leader(pdf: pd.DataFrame) -> pd.DataFrame:
        make, found = sets_of(), []
        for _, unit in pdf.sort_values(["a", "i", "side"]).groupby(["a", "i"], sort=False):
            ids, z = unit["id"].tolist(), unit["z"].tolist()
            leader = make(z[:1])[0]
            for at in range(1, len(ids)):
                if similar(leader, make(z[at : at + 1])[0], percent):
                    found.append((ids[0], ids[at]))
        return pd.DataFrame(found, columns=["a", "b"])

    linked, linked_path = materialise(rows.groupBy("g").applyInPandas(against_leader, f"a {id_type}, b {id_type}"), "sim-links")
    labels, labels_path = components(linked, linked.count())
    discard(spark, leaders_path, pairs_path, large_path, linked_path)

    # 2. between the components of a bucket
    known = followers.join(labels, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("c"))
    several = known.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("bucket")
    several, several_path = materialise(several, "sim-several")
    left, left_path = materialise(known.join(several, "bucket"), "sim-open")
    weights = left.groupBy("bucket", "c").agg(F.sum("n").alias("w"))
    whole = weights.groupBy("bucket").agg(F.max(F.struct("w", "c")).alias("m"), F.sum("w").alias("w"))
    blocks = lambda w: F.greatest(F.lit(1), F.ceil(w / most)).cast("int")
    whole, whole_path = materialise(
        whole.select(
            "bucket", F.col("m.c").alias("main"), (F.col("w") <= most).alias("fits"), blocks(F.col("w") - F.col("m.w")).alias("others"), blocks(F.col("m.w")).alias("mains"), "w"
        ),
        "sim-buckets",
    )
    parts = max(1, -(-(whole.agg(F.sum("w")).first()[0] or 0) // most))
    rows = left.join(whole, "bucket").withColumn("inner", F.col("c") == F.col("main"))
    block = lambda k: F.pmod(F.xxhash64("id", F.lit(7)), k).cast("int")
    mine = F.when(F.col("inner"), block(F.col("mains"))).otherwise(block(F.col("others")))
    # units of a large bucket: blocks (i, j) of others, and a block i of others with block j of the main component, as (i, -1 - j)
    unit = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    other_blocks, main_blocks = F.sequence(F.lit(0), F.col("others") - 1), F.sequence(F.lit(0), F.col("mains") - 1)
    among = F.transform(other_blocks, lambda o: F.struct(F.least(F.col("mine"), o).alias("i"), F.greatest(F.col("mine"), o).alias("j"), F.when(F.col("mine") <= o, 0).otherwise(1).alias("side")))
    units = F.when(F.col("fits"), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("inner").cast("int").alias("side"))))
    units = units.when(F.col("inner"), F.transform(other_blocks, lambda o: unit(o, -1 - F.col("mine"), 1)))
    units = units.otherwise(F.concat(among, F.transform(main_blocks, lambda m: unit(F.col("mine"), -1 - m, 0))))
    rows = rows.withColumn("mine", mine).select("bucket", "id", "c", F.explode(units).alias("u")).select("bucket", "id", "c", "u.*")
    rows = rows.withColumn("g", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(parts))).join(stored, "id")

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        make, found = sets_of(), []
        for (_, i, j), unit in pdf.sort_values(["bucket", "i", "j", "side", "id"]).groupby(["bucket", "i", "j"], sort=False):
            c = unit["c"].tolist()
            if len(unit) > 1:
                queries = int((unit["side"] == 0).sum())
                found += [(c[x], c[y]) for x, y in links(make(unit["z"].tolist()), percent, queries, i != j, c)]
        return pd.DataFrame(found, columns=["a", "b"])

    joined, joined_path = materialise(rows.groupBy("g").applyInPandas(between, f"a {id_type}, b {id_type}"), "sim-joins")
    roots, roots_path = components(joined, joined.count())
    discard(spark, followers_path, several_path, left_path, whole_path, joined_path)
    higher = roots.select(F.col("id").alias("component"), F.col("component").alias("root"))
    out = labels.join(higher, "component", "left").select("id", F.coalesce("root", "component").alias("component")).unionByName(roots)
    return out, [labels_path, roots_path]
