"""Sharding by a k-d tree over row metadata.

A node of the tree holds rows and a number of leaves. It is split along its
widest dimension (its range over the whole table's) at the weighted quantile
that gives each side the bytes of its leaves, until every node is one leaf. The
quantile is exact and distributed: a histogram of at most 4096 bins for each
node narrows the range, again and again; ties are parted by the text's checksum
and then by a hash of the id. The driver only sees those histograms and one
cut for each inner node, whatever the table's size.

Rows with equal texts have equal coordinates, so they share a shard unless a cut
has to fall inside their group to keep the shards' bytes near equal; a cut
moves to the group's border where that costs at most ``slack`` of a shard.

Null and empty texts have the fixed size alone. Repeated rows stay together and
get a slot each. A text larger than a shard's share makes its shard as large as
that. An empty table gives an empty result; shards can be empty if there are
fewer rows than shards. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, ranked

_BINS = 4096


@dataclass
class _Node:
    """Leaves [first, first + leaves); parts is the order of a split, cut its place."""

    first: int
    leaves: int
    parts: tuple[str, ...] = ()
    equal: list[int] = field(default_factory=list)  # values of the parts before the current one
    cut: int | None = None
    low: int = 0
    high: int = 0
    below: float = 0.0
    goal: float = 0.0
    sides: tuple[_Node, _Node] | None = None

    def before_cut(self) -> Column:
        """True for rows of the left side."""
        k = len(self.equal)
        less = F.col(self.parts[k]) < F.lit(self.cut)
        for part, value in zip(reversed(self.parts[:k]), reversed(self.equal)):
            less = (F.col(part) < F.lit(value)) | ((F.col(part) == F.lit(value)) & less)
        return less

    def inside(self) -> Column:
        """True for rows that the search still has in range."""
        here = F.col(self.parts[len(self.equal)]).between(F.lit(self.low), F.lit(self.high))
        for part, value in zip(self.parts, self.equal):
            here &= F.col(part) == F.lit(value)
        return here

    def leaf(self) -> Column:
        if self.sides is None:
            return F.lit(self.first)
        return F.when(self.before_cut(), self.sides[0].leaf()).otherwise(self.sides[1].leaf())


def kd_shards(
    rows: DataFrame, shards: int, weight: str, dims: Sequence[str], ties: Sequence[str], slack: float = 0.005, exact: float = 0.0005
) -> Column:
    """The shard of each row, as an expression over the columns of ``rows``.

    ``dims`` and ``ties`` are columns of non-negative whole numbers; the last
    tie should differ between rows. ``rows`` is read a few times for each level
    of the tree (five levels for 24 shards), so give a materialised table.
    """
    root = _Node(0, shards)
    total = rows.agg(F.sum(weight).alias("w"), *[f(d).alias(f"{k}{i}") for i, d in enumerate(dims) for k, f in (("min", F.min), ("max", F.max))]).first()
    if not total.w:
        return F.lit(0)
    target = total.w / shards
    spread = [max(1, total[f"max{i}"] - total[f"min{i}"]) for i in range(len(dims))]
    open_nodes = [root] if shards > 1 else []
    while open_nodes:
        stats = _by_node(rows, root, open_nodes, [
            F.sum(weight).alias("w"), *[f(c).alias(f"{k}_{c}") for c in dict.fromkeys([*dims, *ties]) for k, f in (("min", F.min), ("max", F.max))],
        ])
        search = []
        for n in open_nodes:
            if (s := stats.get(n.first)) is None:  # no rows: any cut will do
                n.parts, n.cut = (dims[0],), 0
                continue
            widths = [(s[f"max_{d}"] - s[f"min_{d}"]) / spread[i] for i, d in enumerate(dims)]
            widest = dims[widths.index(max(widths))]
            n.parts = (widest, *[t for t in ties if t != widest])
            n.low, n.high, n.goal = s[f"min_{widest}"], s[f"max_{widest}"], s["w"] * (n.leaves // 2) / n.leaves
            search.append(n)
        while search:
            search = _narrow(rows, root, search, weight, slack * target, exact * target)
        following = []
        for n in open_nodes:
            left = n.leaves // 2
            n.sides = (_Node(n.first, left), _Node(n.first + left, n.leaves - left))
            following += [s for s in n.sides if s.leaves > 1]
        open_nodes = following
    return root.leaf()


def _by_node(rows: DataFrame, root: _Node, nodes: list[_Node], measures: list[Column]) -> dict:
    wanted = rows.withColumn("__node", root.leaf()).where(F.col("__node").isin([n.first for n in nodes]))
    return {r["__node"]: r for r in wanted.groupBy("__node").agg(*measures).collect()}


def _narrow(rows: DataFrame, root: _Node, search: list[_Node], weight: str, slack: float, exact: float) -> list[_Node]:
    """One histogram for all nodes in ``search``; returns those whose cut isn't settled yet."""
    binned = F.lit(None).cast("long")
    for n in search:
        width = -(-(n.high - n.low + 1) // _BINS)
        here = (F.col("__node") == n.first) & n.inside()
        binned = F.when(here, F.floor((F.col(n.parts[len(n.equal)]) - F.lit(n.low)) / F.lit(width)).cast("long")).otherwise(binned)
    found = rows.withColumn("__node", root.leaf()).withColumn("__bin", binned).where(F.col("__bin").isNotNull())
    bins: dict[int, list] = {}
    for r in found.groupBy("__node", "__bin").agg(F.sum(weight).alias("w")).collect():
        bins.setdefault(r["__node"], []).append((r["__bin"], r["w"]))
    again = []
    for n in search:
        width = -(-(n.high - n.low + 1) // _BINS)
        sums = n.below
        for b, w in sorted(bins[n.first]):
            start, sums = sums, sums + w
            if sums >= n.goal:
                break
        low, high = n.low + b * width, min(n.high, n.low + (b + 1) * width - 1)
        off, cut = min((abs(start - n.goal), low), (abs(sums - n.goal), high + 1))
        single, last = low == high, len(n.equal) + 1 == len(n.parts)
        text_known = single and last is False and len(n.equal) + 2 == len(n.parts)
        if off <= exact or (text_known and off <= slack) or (single and last):
            n.cut = cut
            continue
        n.below = start
        if single:
            n.equal.append(low)
            n.low, n.high = 0, (1 << 60) - 1
        else:
            n.low, n.high = low, high
        again.append(n)
    return again


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and what the tree sees of a text: size, lines, text_crc32 and a hash of the id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("lines"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col(id_col).alias("__id"),
    ).withColumn("id_hash", F.xxhash64("__id").bitwiseAND(F.lit((1 << 60) - 1))).drop("__id")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, size, text_crc32, shard and slot of each row; bytes of shards are near equal.

    Texts are read once; all later steps use a narrow table of 40 bytes a row.
    """
    rows, _ = materialise(describe(docs, id_col, text_col), "shard-rows")
    shard = kd_shards(rows, shards, "size", ("size", "lines", "text_crc32"), ("text_crc32", "id_hash"))
    placed = rows.withColumn("shard", shard.cast("int"))
    spread = max(8, rows.count() // shards // 250_000)
    return ranked(placed, ["shard"], ["id_hash", "text_crc32"], "slot", spread).select(id_col, "size", "text_crc32", "shard", "slot")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(documents(spark, sf_dir))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
