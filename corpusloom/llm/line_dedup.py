"""Line dedup with two Bloom filters.

A line's key is the line without ASCII white space at both ends and with A-Z in
lower case. The first pass runs the keys' hashes through two filters, keys seen
once and keys seen twice; only keys in the second are suspects. Suspects alone
are shuffled, as (128-bit key digest, document) pairs, counted exactly, and those
in enough documents are confirmed. Confirmed keys go back to the documents that
have them; other documents never leave their map task.

Two choices: ``keep_first=False`` drops every line with a confirmed key,
``keep_first=True`` leaves the first of them, in the document with the smallest
id (its first such line).

Null and empty texts are one empty line. Keys shorter than ``min_chars`` code
points are never dropped. A key counts once per document, however often it
stands there; rows with equal ids (also null ids) count as one document. If all
lines go, the text becomes empty. Very long lines are digested whole. Other
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import documents, input_bytes, marked, materialise, small_batches
from .workers import tidy

_SPACE = b" \t\n\x0b\x0c\r"
_BYTES_A_LINE = 128  # for sizing the filters only


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def line_key(line: bytes) -> bytes:
    """A-Z in lower case; bytes of other characters in UTF-8 are never in that range."""
    return line.strip(_SPACE).lower()


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _long_enough(key: bytes, min_chars: int) -> bool:
    """Whether a key has ``min_chars`` code points, of at most four bytes each."""
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def key_digests(text: str | None, min_chars: int) -> list[bytes]:
    """The digests of a document's distinct keys, in order of first appearance."""
    return [_digest(k) for k in dict.fromkeys(map(line_key, _lines(text))) if _long_enough(k, min_chars)]


def _as_hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8")[::2]


def drop_keys(text: str | None, drop: set[bytes], min_chars: int, keep: set[bytes] = frozenset()) -> tuple[str, int, int]:
    """The kept text, the number of lines and of dropped lines; of the keys in ``keep`` the first line stays."""
    lines = _lines(text)
    if not drop:
        return text or "", len(lines), 0
    left, spared = [], set()
    for line in lines:
        key = line_key(line)
        if _long_enough(key, min_chars) and (d := _digest(key)) in drop:
            if d not in keep or d in spared:
                continue
            spared.add(d)
        left.append(line)
    return b"\n".join(left).decode("utf-8", "surrogatepass"), len(lines), len(lines) - len(left)


def _suspects(spark: SparkSession, twice: bloom.Repeats, min_chars: int, text: Column) -> Column:
    """The digests of a text's keys that are in the filter."""
    shared = spark.sparkContext.broadcast(twice)

    @F.pandas_udf("array<binary>")
    @tidy
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            each = [key_digests(t, min_chars) for t in texts]
            flat = [d for ds in each for d in ds]
            hit = iter(shared.value.has(_as_hashes(flat)).tolist())
            yield pd.Series([[d for d in ds if next(hit)] for ds in each], dtype=object)

    return find(text)


def _free(name: str, columns: list[str]) -> str:
    """``name`` with as many _ as no column of ``columns`` has, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def dedup_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All rows and columns of ``docs`` with the text after dropping, then n_lines and n_dropped.

    A caller's columns of these names stay; the added ones then end in _. Reads
    ``docs`` four times. Shuffled: hashes of keys, digests of suspects, and the
    texts of documents that lose a line.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def hashes(pdf: pd.DataFrame) -> np.ndarray:
        return _as_hashes([d for t in pdf["t"] for d in key_digests(t, min_chars)])

    twice = bloom.repeated(docs.select(F.col(text_col).alias("t")), hashes, input_bytes(docs, text_col) // _BYTES_A_LINE)
    row = (F.col(id_col), F.xxhash64(text_col))
    pairs = docs.select(row[0].alias("id"), row[1].alias("h"), F.explode(_suspects(spark, twice, min_chars, F.col(text_col))).alias("key")).distinct()
    pairs, _ = materialise(pairs, "ld-suspects")
    # written, as is each side of the next join: a key that a third of all rows have can then be split
    counted = pairs.groupBy("key").agg(F.count_distinct(F.struct("id")).alias("n"), F.min("id").alias("first"))
    confirmed, _ = materialise(counted.where(F.col("n") >= min_docs).select("key", "first"), "ld-confirmed")
    first = F.when(F.col("id") == F.col("first"), F.col("key")) if keep_first else F.lit(None).cast("binary")
    drops = pairs.join(confirmed, "key").groupBy("id", "h").agg(F.collect_list("key").alias("drop"), F.collect_list(first).alias("keep"))
    drops, _ = materialise(drops, "ld-drops")

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    @tidy
    def apply(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, drop, keep in batches:
            rows = [
                drop_keys(t, set(d) if d is not None else set(), min_chars, set(k) if k is not None else set())
                for t, d, k in zip(texts, drop, keep)
            ]
            yield pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    names = [_free("n_lines", docs.columns), _free("n_dropped", docs.columns)]
    some, others = marked(docs, drops.select("id", "h"), *row)
    drops = drops.select(F.struct("id", "h").alias("__ld_row"), F.struct("drop", "keep").alias("__ld"))
    some = some.withColumn("__ld_key", F.struct(row[0].alias("id"), row[1].alias("h")))
    some = some.join(drops.hint("merge"), F.col("__ld_key") == F.col("__ld_row"), "left")
    some = some.withColumn("__ld_out", apply(F.col(text_col), F.col("__ld.drop"), F.col("__ld.keep")))
    changed = some.select(
        *[F.col("__ld_out.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.col("__ld_out.n_lines").alias(names[0]), F.col("__ld_out.n_dropped").alias(names[1]),
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    same = others.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias(names[0]),
        F.lit(0).cast("long").alias(names[1]),
    )
    return changed.unionByName(same)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP10_SQL = r"""
with lines as (
  select doc_id, i, s, translate(trim(s, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)
), common as (
  select k from lines where length(k) >= 1 group by k having count(distinct doc_id) >= 10
), marked as (
  select l.*, c.k is not null as gone from lines l left join common c on l.k = c.k
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(s, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; n_chars follows."""
    kept = dedup_lines(docs, id_col="doc_id", text_col="text").select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept
