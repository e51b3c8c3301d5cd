"""Media columns over a store of content-defined chunks.

A payload of bytes is stored as an 8-bit mono WAV file. The file is cut where a
rolling gear hash of the last 32 bytes has its upper bits zero, so equal
passages give equal chunks wherever they stand. Chunks are known by SHA-256; a
file is an ordered list of digests.

1. A pass over the payloads finds a filter of repeated digests; a digest that is
   not in it occurs once.
2. Files all of whose chunks occur once, and such chunks of other files, are
   written to the store by the task that cuts them: nothing is shuffled.
3. Other chunks go by their digest to one place, where one copy is kept.
4. Files are read back: lists are joined to the kept chunks by digest, put in
   order, and each file's SHA-256 is verified before its samples are used. Equal
   files are put together once.

Null texts are empty payloads; an empty payload is padded to 64 zero bytes.
Repeated rows and equal texts get equal values. Very long payloads are hashed in
blocks. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import documents, input_bytes, materialise, small_batches

UNIT = 64
LEAST, MEAN_BITS, MOST = 512, 11, 16_384
_WINDOW, _BLOCK = 32, 1 << 22
_GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)
_MASK = np.uint32(((1 << MEAN_BITS) - 1) << (32 - MEAN_BITS))


def pad(data: bytes) -> bytes:
    """With zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def wav(samples: bytes) -> bytes:
    """An 8-bit mono WAV file at 8 kHz."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(samples))
    return head + samples


def samples(media: bytes) -> bytes:
    """The samples of a file of :func:`wav`."""
    riff, size, kind, _, _, _, channels, _, _, _, depth, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, kind, data, channels, depth) != (b"RIFF", b"WAVE", b"data", 1, 8) or len(media) != 44 + n or size != 36 + n:
        raise ValueError("not an 8-bit mono WAV file")
    return media[44:]


def _cut_places(data: np.ndarray) -> np.ndarray:
    """Positions i such that the hash of the bytes up to and with i asks for a cut after it."""
    found = []
    for at in range(0, len(data), _BLOCK):
        first = max(0, at - _WINDOW + 1)
        h = _GEAR[data[first : at + _BLOCK]]
        for step in (1, 2, 4, 8, 16):
            h[step:] += h[:-step] << np.uint32(step)
        found.append(np.flatnonzero((h[at - first :] & _MASK) == 0) + at)
    return np.concatenate(found) if found else np.zeros(0, int)


def chunk_all(files: list[bytes]) -> list[list[bytes]]:
    """The chunks of each file; a chunk has LEAST to MOST bytes but for a file's last."""
    out: list[list[bytes]] = []
    group: list[bytes] = []
    size = 0
    for k, media in enumerate(files):
        group.append(media)
        size += len(media)
        if size >= _BLOCK or k + 1 == len(files):
            places = _cut_places(np.frombuffer(b"".join(group), np.uint8)).tolist()
            base = 0
            for data in group:
                chunks, at, end = [], 0, len(data)
                while at < end:
                    stop = min(at + MOST, end)
                    j = bisect.bisect_left(places, base + at + LEAST - 1)
                    if j < len(places) and places[j] - base < stop:
                        stop = places[j] - base + 1
                    chunks.append(data[at:stop])
                    at = stop
                out.append(chunks)
                base += end
            group, size = [], 0
    return out


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _media(text: str | None) -> bytes:
    return wav(pad((text or "").encode("utf-8")))


def features(media: bytes) -> tuple[int, str, int, int, str, str]:
    """What is computed from a file that was read back."""
    data = samples(media)
    x = np.frombuffer(data, np.uint8)
    said = f"mean={x.mean():.4f};std={x.std():.4f};min={x.min()};max={x.max()};levels={len(np.unique(x))};crossings={int(np.count_nonzero(np.diff((x >= 128).view(np.int8))))}"
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), said


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def verified_features(key: str, chunks: str) -> Column:
    """The features of the file that the ordered chunks make; an error if its digest isn't the key."""

    @F.pandas_udf(_FEATURES)
    def verify(keys: pd.Series, chunks: pd.Series) -> pd.DataFrame:
        rows = []
        for key, parts in zip(keys, chunks):
            media = b"".join(p["bytes"] for p in sorted(parts, key=lambda p: p["pos"]))
            if _digest(media) != bytes(key):
                raise ValueError(f"media {bytes(key).hex()} was not reconstructed")
            rows.append(features(media))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _FEATURES.split(", ")])

    return verify(F.col(key), F.col(chunks))


def _stored(spark: SparkSession, repeated: bloom.Repeats, text: Column) -> Column:
    """struct(n_bytes, key, clean, chunks array<struct(pos, digest, bytes)>); bytes are null for chunks that may repeat."""
    shared = spark.sparkContext.broadcast(repeated)

    @F.pandas_udf("n_bytes long, key binary, clean boolean, chunks array<struct<pos:int,digest:binary,bytes:binary>>")
    def store(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            files = [_media(t) for t in texts]
            rows = []
            for text, media, chunks in zip(texts, files, chunk_all(files)):
                digests = [_digest(c) for c in chunks]
                again = shared.value.has(_hashes(digests)).tolist()
                kept = [{"pos": k, "digest": d, "bytes": None if a else c} for k, (c, d, a) in enumerate(zip(chunks, digests, again))]
                rows.append((len((text or "").encode("utf-8")), _digest(media), not any(again), kept))
            yield pd.DataFrame(rows, columns=["n_bytes", "key", "clean", "chunks"])

    return store(text)


def _repeated(spark: SparkSession, repeated: bloom.Repeats, text: Column) -> Column:
    """array<struct(digest, bytes)> of the chunks that may repeat, each once a batch."""
    shared = spark.sparkContext.broadcast(repeated)

    @F.pandas_udf("array<struct<digest:binary,bytes:binary>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            seen: set[bytes] = set()
            rows = []
            for chunks in chunk_all([_media(t) for t in texts]):
                digests = [_digest(c) for c in chunks]
                row = []
                for c, d, again in zip(chunks, digests, shared.value.has(_hashes(digests)).tolist()):
                    if again and d not in seen:
                        seen.add(d)
                        row.append({"digest": d, "bytes": c})
                rows.append(row)
            yield pd.Series(rows, dtype=object)

    return find(text)


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8")[::4]


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the payloads of ``docs`` as chunks, read them back, and give each row's sizes, digests and features."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))

    def digests(pdf: pd.DataFrame) -> np.ndarray:
        return _hashes([_digest(c) for chunks in chunk_all([_media(t) for t in pdf["t"]]) for c in chunks])

    twice = bloom.repeated(texts.select(F.col("__text").alias("t")), digests, input_bytes(docs, text_col) >> MEAN_BITS)
    lists, _ = materialise(texts.select("__id", _stored(spark, twice, F.col("__text")).alias("__s")).select("__id", "__s.*"), "media-files")
    kept, _ = materialise(
        texts.select(F.explode(_repeated(spark, twice, F.col("__text"))).alias("__c"))
        .groupBy(F.col("__c.digest").alias("digest"))
        .agg(F.first("__c.bytes").alias("kept")),
        "media-chunks",
    )

    alone = lists.where("clean").select("__id", "n_bytes", verified_features("key", "chunks").alias("__f"))
    mixed = lists.where(~F.col("clean"))
    each = mixed.select("key", "chunks").dropDuplicates(["key"]).select("key", F.explode("chunks").alias("__c"))
    each = each.select("key", "__c.*").join(kept, "digest", "left")
    files = each.groupBy("key").agg(F.collect_list(F.struct("pos", F.coalesce("bytes", "kept").alias("bytes"))).alias("chunks"))
    put = files.select("key", verified_features("key", "chunks").alias("__f"))
    joined = mixed.select("__id", "n_bytes", "key").join(put, "key").select("__id", "n_bytes", "__f")
    return alone.unionByName(joined).select(F.col("__id").alias(id_col), "n_bytes", "__f.*")


def op3_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(documents(spark, sf_dir))
