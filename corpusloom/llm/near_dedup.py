"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

1. A document's set is its distinct five-word shingles, as 64-bit hashes. Equal
   sets form a class that one representative, the smallest id, stands for.
2. Each set is sketched in rounds of hashed bin placement (Dahlgaard, Knudsen and
   Thorup, 2017): in round i every element falls into a random one of t bins with
   the value i + random fraction, and a bin keeps its least value; after t rounds
   each further round aims at one bin, so all coordinates are filled after 2t
   rounds at most, and two sketches agree in a share of coordinates that is
   concentrated around the Jaccard similarity.
3. t = bands x rows coordinates make bands. With 60 bands of 9 rows a pair of
   similarity 0.85 shares no band with probability 1.4e-7, one of 0.9 with 2e-13.
4. Filters of repeated hashes drop bands that one representative alone has; the
   others are buckets.
5. Members of a bucket are verified on their full sets against the bucket's
   leader; what that leaves unconnected meets by blocks of bounded size, through
   posting lists (element -> documents), so work follows the overlaps that there
   are (see :func:`corpusloom.operators.graph.similarity_components`). A group of
   k near copies takes about k checks. Links make the components.

Null and empty texts and texts without words have the empty set, link with
nothing and are kept. Rows without an id are their own component (null) and are
kept. A row is linked by its own text: rows that repeat an id with equal sets are
one document; rows that repeat it with unequal sets are linked each by its set,
and their components may differ. Very long texts are whole sets. Other columns
pass through the pipeline stage untouched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import similarity_components
from . import bloom
from .common import discard, documents, materialise, small_batches, without
from .workers import tidy

WORDS, PERCENT, BANDS, ROWS = 5, 85, 60, 9
_CACHE_LIMIT, _CACHED_BYTES = 200_000, 64
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64((1 << 32) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _MIX2
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= _CACHED_BYTES and len(self) < _CACHE_LIMIT:
            self[word] = h
        return h


def shingles(text: str | None, hashes: _WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(w))
    n = len(w) - size + 1
    h = np.full(n, np.uint64(size))
    for k in range(size):
        h = (h ^ w[k : k + n]) * _MIX
        h ^= h >> np.uint64(31)
    return np.unique(h)


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """t filled coordinates: (round << 32) | value of the element that each bin keeps."""
    n = len(elements)
    out = np.zeros(t, np.uint64)
    empty = np.ones(t, bool)
    at = 0
    while empty.any():
        rounds = min(max(1, 4 * t // n), 2 * t - at)
        i = np.arange(at, at + rounds, dtype=np.uint64)[:, None]
        h = _mixed(elements[None, :] + i * _MIX2)
        bins = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        late = at + rounds - t
        if late > 0:
            bins[-late:] = i[-late:] - np.uint64(t)
        keys = ((bins << np.uint64(43)) | (i << np.uint64(32)) | (h & _LOW)).ravel()
        keys.sort()
        b = (keys >> np.uint64(43)).astype(np.int64)
        first = np.concatenate([[True], b[1:] != b[:-1]])
        first &= empty[b]
        out[b[first]] = keys[first] & np.uint64((1 << 43) - 1)
        empty[b[first]] = False
        at += rounds
    return out


def band_hashes(elements: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash for each band of a set's sketch; empty for the empty set."""
    if not len(elements):
        return np.zeros(0, np.uint64)
    parts = sketch(elements, bands * rows).reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64) * _MIX2
    for k in range(rows):
        h = (h ^ parts[:, k]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _digest(elements: np.ndarray) -> bytes | None:
    """What tells unequal sets apart; None for the empty set."""
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None


def _describe(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """id, text_hash, n, digest (null for the empty set) and the bands' hashes of each row."""

    @F.pandas_udf("n long, digest binary, bands array<long>")
    @tidy
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for texts in batches:
            out = []
            for text in texts:
                s = shingles(text, hashes)
                out.append((len(s), _digest(s), band_hashes(s, bands, rows).view(np.int64)))
            yield pd.DataFrame(out, columns=["n", "digest", "bands"])

    return docs.select("id", F.xxhash64("text").alias("text_hash"), describe("text").alias("__d")).select("id", "text_hash", "__d.*")


def _candidates(texts: DataFrame, found: bloom.Bits) -> DataFrame:
    """The set's digest and the compressed text of each row whose id is in the filter."""
    has = texts.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("id binary, z binary")
    @tidy
    def compressed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        """Nulls for rows that are no candidate."""
        hashes = _WordHashes()
        for hashed, column in batches:
            chosen = has.value.has(hashed.to_numpy(np.int64).view(np.uint64))
            out = [(_digest(shingles(t, hashes)), zlib.compress((t or "").encode("utf-8", "surrogatepass"), 1)) if c else (None, None) for t, c in zip(column, chosen)]
            yield pd.DataFrame(out, columns=["id", "z"])

    once = compressed.asNondeterministic()  # else the filter would compute it as well, in a worker of its own
    return texts.where(F.col("id").isNotNull()).select(once(F.xxhash64("id"), "text").alias("s")).select("s.*").where("id is not null")


def _classified(docs: DataFrame, percent: int, bands: int, rows: int, most: int, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, n_shingles, component_id and kept of each row.

    Shuffled: 16-byte digests and the bands' hashes of all rows, bands that
    several representatives have, and the compressed texts of documents that
    have a candidate.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets, sets_path = materialise(_describe(texts, bands, rows), "nd-sets")
    n_rows = sets.count()
    classed = sets.where("digest is not null and id is not null")
    # n and bands follow from the set, so the least struct is that of the smallest id
    reps, reps_path = materialise(
        classed.groupBy("digest").agg(F.min(F.struct("id", "n", "bands")).alias("r")).select("r.*", "digest"), "nd-reps", n_rows
    )

    def keys(pdf: pd.DataFrame) -> np.ndarray:
        return np.concatenate([np.asarray(b, np.int64) for b in pdf["bands"]] or [np.zeros(0, np.int64)]).view(np.uint64)

    shared = spark.sparkContext.broadcast(bloom.repeated(reps.select("bands"), keys, n_rows * bands))

    @F.pandas_udf("array<long>")
    def repeated(column: pd.Series) -> pd.Series:
        each = [np.asarray(b, np.int64) for b in column]
        hit = shared.value.has(np.concatenate(each).view(np.uint64)) if each else np.zeros(0, bool)
        return pd.Series([b[h] for b, h in zip(each, np.split(hit, np.cumsum([len(b) for b in each])[:-1]))], dtype=object)

    members, members_path = materialise(reps.select("id", F.col("digest").alias("node"), "n", F.explode(repeated("bands")).alias("bucket")), "nd-buckets")
    several = members.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("bucket")
    wanted, wanted_path = materialise(several.join(members, "bucket").select(F.xxhash64("id").alias("h")).distinct(), "nd-wanted", n_rows // 8)
    found = bloom.filter_of(wanted, lambda pdf: pdf["h"].to_numpy(np.int64).view(np.uint64), bloom.bits_for(wanted.count()))
    stored, stored_path = materialise(_candidates(texts, found).groupBy("id").agg(F.first("z").alias("z")), "nd-texts")

    def sets_of() -> Callable[[list], list[np.ndarray]]:
        hashes = _WordHashes()
        return lambda column: [shingles(zlib.decompress(z).decode("utf-8", "surrogatepass"), hashes) for z in column]

    labels, label_paths = similarity_components(members.select(F.col("node").alias("id"), "n", "bucket"), stored, percent, "binary", sets_of, most)
    # documents of components: written before their least ids are joined back, so a large component's rows can be split
    heads = labels.select(F.col("component").alias("id"), "component").distinct()
    grouped = labels.unionByName(heads).withColumnRenamed("id", "digest").join(reps.select("digest", "id"), "digest")
    grouped, grouped_path = materialise(grouped, "nd-grouped")
    least, least_path = materialise(grouped.groupBy("component").agg(F.min("id").alias("component_id")), "nd-least")
    named = grouped.join(least, "component").select("digest", "component_id")
    classes = reps.select("digest", "id").join(named, "digest", "left").select("digest", F.coalesce("component_id", "id").alias("component_id"))
    classes, classes_path = materialise(classes, "nd-classes", n_rows)
    linked = classed.select("id", "text_hash", "n", "digest").join(classes, "digest").drop("digest")
    alone = sets.where("digest is null or id is null").select("id", "text_hash", "n", F.col("id").alias("component_id"))
    out = linked.unionByName(alone).select(
        "id", "text_hash", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
    done, _ = materialise(out, "nd-result", n_rows)
    discard(spark, sets_path, reps_path, members_path, wanted_path, stored_path, grouped_path, least_path, classes_path, *label_paths)
    return done


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, most: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The id, n_shingles, component_id and kept of each row; ``most`` bounds the shingles that a task compares at once."""
    found = _classified(docs, percent, bands, rows, most, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


OP5_SQL = r"""
with words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), sets as (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) end) as s from words
), sizes as (select doc_id, len(s) as n from sets
), items as (select doc_id, unnest(s) as x from sets
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from items a join items b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from common join sizes m on m.doc_id = a join sizes n on n.doc_id = b where 100 * k >= 85 * (m.n + n.n - k)
), ends as (select a, b from links union all select b, a from links
), recursive_reach as (
  with recursive reach(id, r) as (select doc_id, doc_id from sizes union select b.b, r from reach join ends b on b.a = reach.id)
  select id, min(r) as component_id from reach group by id
)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from sizes join recursive_reach on id = doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    gone = _classified(docs, PERCENT, BANDS, ROWS, 1 << 20, "doc_id", "text").where(~F.col("kept")).select("id", "text_hash")
    return without(docs, gone, F.col("doc_id"), F.xxhash64("text"))
