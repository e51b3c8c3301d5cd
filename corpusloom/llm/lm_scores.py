"""Stupid-backoff language-model scores of a corpus under its own n-gram counts.

The score of a word after its context is c(context word) / c(context) if that
n-gram was counted at least ``min_count`` times, else ``alpha`` times the score
after the shorter context, and c(word) / N at the end. A document's score is the
mean natural logarithm over its words; counts are of all documents.

Relations, with n-grams as 64-bit hashes:

* blocks: a few megabytes of documents, as lists of local word numbers and the
  words' hashes; they go to the place of their key, where both later uses find them;
* n-grams: a row (hash and order, block and times) for each distinct n-gram of a
  block, partitioned by hash. A block holds an n-gram once, so the most frequent
  n-gram has as many rows as there are blocks, however often it occurs;
* count tables: n-grams summed by hash, where they lie. The counts that a score
  can use (above one of single words, of at least ``min_count`` of others) are
  joined to the n-grams by hash, which are read a second time, not shuffled again;
* counted n-grams go back to their block, where each document's words are summed.
  A block knows its n-grams, so of those that lie in one partition only the counts
  travel, in the order of the hashes; their number and a checksum are compared.

Nothing is gathered: blocks, rows and partitions follow the input, and all
groups are bounded by a block. Blocks and n-grams are shuffled once, and counted
n-grams once; the sum of the documents' words, N, enters last.

Words are runs of characters other than ASCII white space, A-Z lower-cased. Null
texts and texts without words have 0 words and a null score. A document is never
split over blocks, so a block can be as large as the longest text. Repeated rows
are counted and scored each; ids of any type, also null ones, come back as they
are. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, input_bytes, materialise, small_batches

_BLOCK_BYTES = 7 << 20
_PART_BYTES, _MOST_PARTS = 8 << 20, 1 << 16  # of input for each partition of n-grams; larger ones are sorted on disk
_CHUNK = 1 << 18  # n-gram rows that a task hands on at once
_ORDER_BITS, _TIMES_BITS = 3, 20  # of a hash, and of a block's number
_AT_ONCE = 1 << 18  # counted n-grams that a task holds
_COUNTS = "block long, part int, turn int, n long, checksum long, counts binary, hashes binary"


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    width = values.dtype.itemsize
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(width, -1).T).view(kind).ravel()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


_BLOCK = "block long, ids array<{}>, n_words long, lengths binary, words binary, vocabulary binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the documents (i, t)."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    ids, lengths, tokens, size, local = [], [], [], 0, {}

    def flush() -> pa.RecordBatch:
        nonlocal ids, lengths, tokens, size, local, number
        hashes = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in local), np.uint64)
        numbers = np.concatenate(tokens) if tokens else np.zeros(0, np.uint32)
        often = np.argsort(-np.bincount(numbers, minlength=len(hashes)), kind="stable")
        place = np.empty(len(often), np.uint32)
        place[often] = np.arange(len(often), dtype=np.uint32)
        keys = pa.concat_arrays(ids)
        row = pa.RecordBatch.from_arrays(
            [
                pa.array([(part << _TIMES_BITS) + number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([len(numbers)], pa.int64()),
                pa.array([_pack(np.array(lengths, np.uint32))], pa.binary()), pa.array([_pack(place[numbers] if len(numbers) else numbers)], pa.binary()),
                pa.array([hashes[often].tobytes()], pa.binary()),
            ],
            ["block", "ids", "n_words", "lengths", "words", "vocabulary"],
        )
        ids, lengths, tokens, size, local, number = [], [], [], 0, {}, number + 1
        return row

    for batch in batches:
        at = 0
        for k, text in enumerate(batch.column(1).to_pylist()):
            ws = words(text)
            lengths.append(len(ws))
            tokens.append(np.fromiter((local.setdefault(w, len(local)) for w in ws), np.uint32, len(ws)))
            size += 64 + (len(text) if text else 0)
            if size >= _BLOCK_BYTES:
                ids.append(batch.column(0).slice(at, k + 1 - at))
                at = k + 1
                yield flush()
        if at < len(batch):
            ids.append(batch.column(0).slice(at))
    if lengths:
        yield flush()


def _ngrams(block: dict, order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Document lengths; for each order the hash at each word; for each order where its context is inside the document."""
    lengths = _unpack(block["lengths"], np.uint32).astype(np.int64)
    vocabulary = np.frombuffer(block["vocabulary"], np.uint64)
    word = vocabulary[_unpack(block["words"], np.uint32)] if block["n_words"] else np.zeros(0, np.uint64)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(len(word)) - starts
    hashes, valid = [word], [np.ones(len(word), bool)]
    for n in range(2, order + 1):
        h = np.zeros(len(word), np.uint64)
        h[1:] = (hashes[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]) ^ (hashes[-1][:-1] >> np.uint64(29))
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        hashes.append(h)
        valid.append(place >= n - 1)
    return lengths, hashes, valid


def _with_order(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hashes with the n-grams' order in their last bits."""
    return hashes >> np.uint64(_ORDER_BITS) << np.uint64(_ORDER_BITS) | np.uint64(n - 1)


def _explode(order: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The n-gram rows (h, v) of blocks; v is the block's number and how often it has the n-gram, in one value."""
        for batch in batches:
            for block in batch.select(["block", "n_words", "lengths", "words", "vocabulary"]).to_pylist():
                _, hashes, valid = _ngrams(block, order)
                for n, (h, ok) in enumerate(zip(hashes, valid), 1):
                    keys, times = np.unique(_with_order(h[ok], n), return_counts=True)
                    most = (1 << _TIMES_BITS) - 1
                    if len(times) and times.max() > most:  # several rows for an n-gram that a very long text has that often
                        rows = -(-times // most)
                        last = times - (rows - 1) * most
                        at = np.repeat(np.arange(len(keys)), rows)
                        keys, times = keys[at], np.where(np.append(at[1:] != at[:-1], True), last[at], most)
                    value = (np.int64(block["block"]) << np.int64(_TIMES_BITS)) + times
                    for at in range(0, len(keys), _CHUNK):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + _CHUNK].view(np.int64)), pa.array(value[at : at + _CHUNK])], ["h", "v"])

    return explode


def _partition(h: np.ndarray, parts: int) -> np.ndarray:
    """Where Spark's hash partitioning (32-bit Murmur3, seed 42) puts rows with these long keys."""
    rotl = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    h1 = np.full(len(h), 42, np.uint32)
    for half in (h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)):
        h1 = rotl(h1 ^ rotl(half * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h1 ^= np.uint32(8)
    h1 = (h1 ^ (h1 >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h1 = (h1 ^ (h1 >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h1 ^ (h1 >> np.uint32(16))).view(np.int32) % parts


def _pack_counts(counts: np.ndarray) -> bytes:
    """A byte a count; those of 255 and more stand behind, in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=n)
    return out


def _hand_back(parts: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counted n-grams (h, block, total) of one partition, in the order of h, as rows of _COUNTS."""
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held, size, turn, last, reached = [], 0, 0, {}, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, turn, reached
            h, block, total = (np.concatenate([x[k] for x in held]) for k in range(3))
            # the hashes travel with the counts of rows that a plan deals or orders otherwise, as where it splits a partition
            plain = (_partition(h.view(np.uint64), parts) == task).all() and (h[1:] >= h[:-1]).all() and (reached is None or reached <= h[0])
            reached = h[-1] if plain else reached
            by = np.argsort(block, kind="stable")
            h, block, total = h[by], block[by], total[by]
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
            rows = []
            for start, stop in zip(edges[:-1], edges[1:]):
                mine, b = h[start:stop], int(block[start])
                if plain:
                    first = np.concatenate([[mine[0] != last.get(b)], mine[1:] != mine[:-1]])  # several rows of one n-gram
                    last[b] = mine[-1]
                else:
                    first = np.zeros(len(mine), bool)
                    first[np.unique(mine, return_index=True)[1]] = True
                if first.any():
                    some = mine[first]
                    rows.append((b, task, turn, len(some), int(np.bitwise_xor.reduce(some)), _pack_counts(total[start:stop][first]), None if plain else some.tobytes()))
            held, size, turn = [], 0, turn + 1
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["block", "part", "turn", "n", "checksum", "counts", "hashes"])

        for batch in batches:
            if len(batch):
                held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "block", "total")])
                size += len(batch)
            if size >= _AT_ONCE:
                yield from flush()
        if held:
            yield from flush()

    return pack


def _summed(order: int, min_count: int, alpha: float, parts: int):
    def score(blocks: pa.Table, counted: pa.Table) -> pa.Table:
        """i, n_words, the sum of the logarithms of words without N, and how many words were scored by c(word) / N."""
        block = {name: blocks.column(name)[0].as_py() for name in ("n_words", "lengths", "words", "vocabulary")}
        ids = blocks.column("ids").chunk(0).flatten()
        lengths, hashes, valid = _ngrams(block, order)
        keys = [_with_order(own, n) for n, own in enumerate(hashes, 1)]
        del hashes
        distinct, place = np.unique(np.concatenate([k[ok] for k, ok in zip(keys, valid)]).view(np.int64), return_inverse=True)
        del keys
        rows = sorted(counted.to_pylist(), key=lambda r: (r["part"], r["turn"]))
        counts, named = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), bool)
        for r in rows:
            if r["hashes"] is not None:
                at = np.searchsorted(distinct, np.frombuffer(r["hashes"], np.int64))
                counts[at], named[at] = _unpack_counts(r["counts"], r["n"]), True
        plain = [r for r in rows if r["hashes"] is None]
        totals = np.concatenate([np.zeros(0, np.int64), *[_unpack_counts(r["counts"], r["n"]) for r in plain]])
        found = np.bitwise_xor.reduce(np.array([r["checksum"] for r in plain], np.int64))
        if len(totals) != np.count_nonzero(~named) or found != np.bitwise_xor.reduce(distinct[~named]):
            raise ValueError("a block's n-grams did not all come back")
        by = np.argsort(_partition(distinct.view(np.uint64), parts), kind="stable")
        counts[by[~named[by]]] = totals
        each = np.split(counts[place], np.cumsum([int(ok.sum()) for ok in valid])[:-1])
        logs = singles = below = None
        for n, (ok, have) in enumerate(zip(valid, each), 1):
            at = np.zeros(len(ok), np.int64)
            at[ok] = have
            if n == 1:
                logs, singles = np.log(np.maximum(at, 1)), np.ones(len(at))
            else:
                context = np.concatenate([[1], below[:-1]])[: len(at)]
                seen = ok & (at >= min_count)
                logs = np.where(seen, np.log(np.maximum(at, 1) / np.maximum(context, 1)), np.where(ok, np.log(alpha) + logs, logs))
                singles = np.where(seen, 0.0, singles)
            below = at
        doc = np.repeat(np.arange(len(lengths)), lengths)
        sums = [pa.array(np.bincount(doc, values, len(lengths)).astype(np.float64)) for values in (logs, singles)]
        return pa.Table.from_arrays([ids, pa.array(lengths), *sums], ["i", "n_words", "logs", "singles"])

    return score


def _scored(blocks: DataFrame, counted: DataFrame, order: int, min_count: int, alpha: float, parts: int) -> DataFrame:
    """The rows of :func:`_summed`, from counted n-grams (h, block, total) in any partitions and order."""
    back = counted.mapInArrow(_hand_back(parts), _COUNTS).groupBy("block")
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    return blocks.groupBy("block").cogroup(back).applyInArrow(_summed(order, min_count, alpha, parts), f"i {id_type}, n_words long, logs double, singles double")


def score_documents(docs: DataFrame, order: int = 2, min_count: int = 2, alpha: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_words and score."""
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    parts = int(min(_MOST_PARTS, max(spark.sparkContext.defaultParallelism, input_bytes(docs, text_col) // _PART_BYTES)))
    if not 1 <= order <= 1 << _ORDER_BITS:
        raise ValueError(f"order must be within 1 and {1 << _ORDER_BITS}")
    blocks = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(_blocks, _BLOCK.format(id_type)).repartition(parts, "block")
    # the filter drops nothing: with it both uses have the same plan below the shuffle, and share it
    ngrams = blocks.mapInArrow(_explode(order), "h long, v long").where("h is not null").repartition(parts, "h")
    tables = ngrams.groupBy("h").agg(F.sum(F.col("v").bitwiseAND(F.lit((1 << _TIMES_BITS) - 1))).alias("total"))
    single = F.col("h").bitwiseAND(F.lit((1 << _ORDER_BITS) - 1)) == 0
    tables = tables.where(F.col("total") >= F.when(single, 2).otherwise(min_count))  # a word without a row was counted once
    counted = ngrams.join(tables.hint("merge"), "h", "left").select("h", F.shiftright("v", _TIMES_BITS).alias("block"), F.coalesce("total", F.lit(0)).alias("total"))
    counted = counted.sortWithinPartitions("h")  # the join's own order: no second sort
    summed, _ = materialise(_scored(blocks, counted, order, min_count, alpha, parts), "lm-sums")
    total = summed.agg(F.sum("n_words")).first()[0] or 1
    mean = (F.col("logs") - F.col("singles") * F.log(F.lit(float(total)))) / F.col("n_words")
    return summed.select(F.col("i").alias(id_col), "n_words", F.when(F.col("n_words") > 0, mean).alias("score"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_documents(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", F.round("score", 6).alias("score"))


OP9_SQL = r"""
with docs as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents
), tokens as (
  select r, doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from docs
), pairs as (
  select r, i, w, lag(w) over (partition by r order by i) as v from tokens
), c1 as (select w, count(*) as n from tokens group by w
), c2 as (select v, w, count(*) as n from pairs where v is not null group by v, w
), total as (select count(*) as n from tokens
), logs as (
  select p.r, case when p.v is null then ln(u.n / total.n) when b.n >= 2 then ln(b.n / c.n) else ln(0.4) + ln(u.n / total.n) end as s
  from pairs p cross join total join c1 u on u.w = p.w left join c1 c on c.w = p.v left join c2 b on b.v = p.v and b.w = p.w
)
select any_value(d.doc_id) as doc_id, count(l.s) as n_words, round(avg(l.s), 6) as score
from docs d left join logs l on l.r = d.r group by d.r
"""
