"""Exact vector search, ranking and reranking.

An index is a table (id, vector, ...). Queries and index are packed into blocks
of bounded size, numbered where they are made; each pair of a query block and an
index block meets in a task, which multiplies them and keeps the best of each
query. Blocks are written tables, and a task holds one pair of blocks and a bounded
number of scores at once. There is no pair table, and no vector passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workers import small_batches, tidy
from .lineage import cut


#: Scores that a task holds at once, at most.
_SCORES = 1 << 20


def _blocks(df: DataFrame, id_col: str, vector_col: str, name: str, block_bytes: int) -> DataFrame:
    """{name}, ids and vectors (float64, row after row) of blocks of about ``block_bytes``; ids of any type stay as they are."""
    id_type = df.schema[id_col].dataType.simpleString()

    @tidy
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, rows, size = TaskContext.get().partitionId() << 32, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, rows, size
            keys = pa.concat_arrays(ids)
            columns = [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([np.concatenate(rows).tobytes()], pa.binary())]
            number, ids, rows, size = number + 1, [], [], 0
            return pa.RecordBatch.from_arrays(columns, [name, "ids", "vectors"])

        for batch in batches:
            width = len(batch.column(1)[0]) if len(batch) else 0
            step = max(1, block_bytes // max(1, 8 * width))
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                ids.append(part.column(0))
                rows.append(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                size += rows[-1].nbytes
                if size >= block_bytes:
                    yield flush()
        if ids:
            yield flush()

    vectors = df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(vector_col).cast("array<double>").alias("v"))
    return vectors.mapInArrow(build, f"{name} long, ids array<{id_type}>, vectors binary")


def top_k(
    queries: DataFrame, index: DataFrame, k: int, query_id: str = "id", query_vector: str = "vector", index_id: str = "id", index_vector: str = "vector",
    block_bytes: int = 16 << 20, digits: int | None = None,
) -> DataFrame:
    """(query_id, match_id, score, rank): the ``k`` largest inner products of each query, ranks from 1, ties by match id.

    ``digits`` rounds scores before they are compared. Rows without a vector are
    left out. Query blocks are a quarter of the index blocks in size; both travel
    once for each block that they meet, which are the rows of a nested loop over
    blocks, not over vectors.
    """
    match_type, id_type = (df.schema[c].dataType.simpleString() for df, c in ((index, index_id), (queries, query_id)))
    small_batches(queries.sparkSession)
    # written once: a nested loop reads its right side again for each part of the left, and would build it in workers beside the searching one
    left = cut(_blocks(queries, query_id, query_vector, "qb", max(1, block_bytes // 4)))
    right = cut(_blocks(index, index_id, index_vector, "ib", block_bytes)).withColumnsRenamed({"ids": "match_ids", "vectors": "match_vectors"})

    @tidy
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                ids, match_ids = (batch.column(c)[row].values for c in ("ids", "match_ids"))
                order = pa.compute.sort_indices(match_ids)
                match_ids = match_ids.take(order)
                mine = np.frombuffer(batch.column("vectors")[row].as_buffer(), np.float64).reshape(len(ids), -1)
                other = np.frombuffer(batch.column("match_vectors")[row].as_buffer(), np.float64).reshape(len(match_ids), -1)[order.to_numpy()]
                most = min(k, len(match_ids))
                step = max(1, min(256, _SCORES // max(1, len(match_ids))))
                for at in range(0, len(ids), step):
                    scores = mine[at : at + step] @ other.T
                    if digits is not None:
                        np.round(scores, digits, out=scores)
                    best = _best(scores, most)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(np.repeat(np.arange(at, at + len(scores)), most))), match_ids.take(pa.array(best.ravel())),
                            pa.array(np.take_along_axis(scores, best, axis=1).ravel()),
                        ],
                        ["query_id", "match_id", "score"],
                    )

    found = left.join(right).mapInArrow(search, f"query_id {id_type}, match_id {match_type}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "match_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(scores: np.ndarray, most: int) -> np.ndarray:
    """The places of the ``most`` largest of each row, ties to the smaller place, largest first."""
    if 4 * most >= scores.shape[1]:
        return np.argsort(-scores, axis=1, kind="stable")[:, :most]
    bound = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
    out = np.empty((len(scores), most), np.int64)
    for r, row in enumerate(scores):
        at = np.flatnonzero(row >= bound[r])
        out[r] = at[np.argsort(-row[at], kind="stable")[:most]]
    return out


def semantic_filter(queries: DataFrame, seeds: DataFrame, top: int = 140_180, order: str = "id", digits: int | None = None, **names: str) -> DataFrame:
    """The ``top`` queries by the score of their nearest seed: (rank, query_id, match_id, score).

    Ties keep the input order. The rank is global, over the limited result only.
    """
    best = top_k(queries, seeds, 1, digits=digits, **names).drop("rank")
    kept = best.orderBy(F.desc("score"), "query_id").limit(top)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "query_id")))


def attach_annotations(matches: DataFrame, seeds: DataFrame, seed_id: str, fields: Sequence[str]) -> DataFrame:
    """Matches with struct matched_annotation of their seed; null where the seed is unknown."""
    notes = seeds.select(F.col(seed_id).alias("match_id"), F.struct(*fields).alias("matched_annotation"))
    return matches.join(notes, "match_id", "left")


def retrieve(queries: DataFrame, index: DataFrame, k: int = 30, **names: str) -> DataFrame:
    """(query_id, match_id, distance, retrieval_rank): cosine distance of unit vectors, ascending."""
    found = top_k(queries, index, k, **names)
    return found.select("query_id", "match_id", (1 - F.col("score")).alias("distance"), F.col("rank").alias("retrieval_rank"))


def rerank(candidates: DataFrame, score: str, k: int = 15, retrieved: int = 30) -> DataFrame:
    """Add rerank_rank (by ``score`` descending, then retrieval rank) and kept (the first ``k``)."""
    if not 1 <= k <= retrieved:
        raise ValueError("k must be between 1 and the number of retrieved documents")
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "retrieval_rank")
    return candidates.withColumn("rerank_rank", F.row_number().over(w)).withColumn("kept", F.col("rerank_rank") <= k)


def collect_evidence(ranked: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per query: retrieved_docs in retrieval order and reranked_docs (kept only) in rerank order."""
    def listed(order: str, only=None):
        item = F.struct(F.col(order).alias("__o"), *fields)
        items = F.array_sort(F.collect_list(item if only is None else F.when(only, item)))
        return F.transform(items, lambda s: F.struct(*[s[f].alias(f) for f in fields]))

    return ranked.groupBy("query_id").agg(listed("retrieval_rank").alias("retrieved_docs"), listed("rerank_rank", F.col("kept")).alias("reranked_docs"))
