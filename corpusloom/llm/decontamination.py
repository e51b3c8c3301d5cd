"""Benchmark decontamination by template canonicalisation.

A text becomes a row of template tokens: words in lower case, but numbers,
capitalised words inside a sentence (names) and units after a number become
typed placeholders. Windows of ``width`` tokens are hashed. The windows of the
benchmark fill a Bloom filter; a document's window that the filter doesn't have
is in no benchmark item, and never leaves its task. The rest is hash-joined to
the benchmark's windows, which makes the match exact up to 64-bit hashes.

Matches of one document, item and alignment are checked for slot consistency:
each value of the item's placeholders must map to one value in the document, as
when a question is asked again with other numbers or names. Windows of
inconsistent alignments only count if they have no placeholder.

Templates take capitals for names, so text in upper case has few plain words.
Therefore windows of the words themselves, without case and placeholders, are
matched as well, in the same filter and join; each verbatim copy is found.

An item is found in a document if half of its windows are, or ``run`` of them,
by templates or else by words. Template windows with fewer than ``literals``
plain words are not used, and are left to the words' windows, which have no such
bound. An item shorter than a window is one window of its own length; documents
are also cut into windows of each such length that the benchmark has, so an item
of one word is found in each document with that word. Punctuation and signs are
not compared; null and empty texts and texts without words match nothing.
Repeated rows and items give the same row once each per (id, item). Long texts
are read whole; other columns are not read. With no benchmark rows nothing is
found.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import documents, input_bytes, materialise, small_batches, without
from .workers import tidy

_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,:/]\d+)*|[.!?…:;\n\"“”|]")
_WORD, _CAPITAL, _NUMBER, _END, _UNIT = range(5)
#: Units that become a placeholder after a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons lb lbs pound pounds oz ml l litre litres liter liters "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw "
    "mw v a j kj cal kcal n pa kpa mpa bar c f k degree degrees percent dollar dollars euro euros cent cents usd eur gbp kb mb gb tb".split()
)
_CACHE_LIMIT = 150_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    """token -> 61 bits of the hash of its case-folded form, then 3 bits of its kind."""

    def __missing__(self, token: str) -> int:
        low = token.lower()
        if token[0].isdigit():
            kind = _NUMBER
        elif not token[0].isalpha():
            kind = _END
        elif low in UNITS:
            kind = _UNIT
        else:
            kind = _CAPITAL if token[0].isupper() else _WORD
        data = token.casefold().encode("utf-8", "surrogatepass")
        code = ((zlib.crc32(data) << 29 ^ zlib.crc32(data, 0x5BD1E995)) & ((1 << 61) - 1)) << 3 | kind
        if len(self) < _CACHE_LIMIT:
            self[token] = code
        return code


def _template(tokens: list[str], codes: _Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hashes, word hashes, whether each is a placeholder, and the number of the token it comes from."""
    code = np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))
    kind = (code & np.uint64(7)).astype(np.uint8)
    before = np.concatenate([[_END], kind[:-1]]) if len(kind) else kind
    number = kind == _NUMBER
    name = (kind == _CAPITAL) & (before != _END)
    unit = (kind == _UNIT) & (before == _NUMBER)
    hashed = code >> np.uint64(3)
    exact = hashed.copy()
    hashed[number], hashed[name], hashed[unit] = 1, 2, 3
    words = np.flatnonzero(kind != _END)
    return hashed[words], exact[words], (number | name | unit)[words], words


def _windows(hashed: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window."""
    n = len(hashed) - width + 1
    h = np.full(n, np.uint64(width + 1))
    for k in range(width):
        h = (h ^ hashed[k : k + n]) * _MIX
        h ^= h >> np.uint64(31)
    return h


_Row = tuple[int, bool, int, list[str]]


def _window_rows(text: str | None, widths: Sequence[int], literals: int, codes: _Codes, has=None) -> list[_Row]:
    """(hash, exact, place, slots) of a text's windows of each width that are used and pass ``has``.

    A slot is '' or the placeholder's token. Exact windows, those of the words
    themselves, come once each and without place and slots; where a window has no
    placeholder, both kinds have the same hash.
    """
    tokens = _TOKEN.findall(text or "")
    hashed, exact, slot, at = _template(tokens, codes)
    sums = np.concatenate([[0], np.cumsum(slot)])
    rows: list[_Row] = []
    for width in widths:
        if width > len(hashed):
            continue
        h = _windows(hashed, width)
        slots = sums[width:] - sums[:-width]
        use = width - slots >= literals
        words = _windows(exact, width) if slots.any() else h
        same, use_words = slots == 0, np.ones(len(h), bool)
        if has is not None:
            tested = use | same
            tested[tested] = has(h[tested])
            use &= tested
            use_words = tested & same
            if not same.all():
                use_words[~same] = has(words[~same])
        rows += [
            (int(h[i].view(np.int64)), False, int(i), [tokens[at[j]].casefold() if slot[j] else "" for j in range(i, i + width)])
            for i in np.flatnonzero(use)
        ]
        rows += [(int(w), True, 0, []) for w in np.unique(words[use_words]).view(np.int64)]
    return rows


def _item_width(text: str | None, width: int) -> int:
    """The length of an item's windows: its number of words, ``width`` at most; 0 without words."""
    return min(width, sum(t[0].isdigit() or t[0].isalpha() for t in _TOKEN.findall(text or "")))


def _item_rows(text: str | None, width: int, literals: int, codes: _Codes) -> list[_Row]:
    own = _item_width(text, width)
    return _window_rows(text, [own] if own else [], literals, codes)


def _short_widths(benchmark: DataFrame, text: str, width: int) -> list[int]:
    """The lengths below ``width`` that items have: fewer than ``width`` rows come to the driver."""

    @F.pandas_udf("int")
    def own(column: pd.Series) -> pd.Series:
        return pd.Series([_item_width(t, width) for t in column], dtype="int32")

    widths = benchmark.select(own(text).alias("w")).distinct().collect()
    return sorted(r["w"] for r in widths if 0 < r["w"] < width)


def _exploded(df: DataFrame, key: str, text: str, rows_of: Callable[[str | None, _Codes], list[_Row]]) -> DataFrame:
    """A row (k, h, exact, p, slots) for each window; ids of any type, also null ones, stay as they are."""
    schema = f"k {df.schema[key].dataType.simpleString()}, h long, exact boolean, p int, slots array<string>"

    @tidy
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = rows_of(text, codes)
                at += [k] * len(found)
                rows += found
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], ["k", "h", "exact", "p", "slots"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(explode, schema)


def _met(found: DataFrame, items: DataFrame, totals: DataFrame, share: float, run: int, common: int) -> DataFrame:
    """The documents' windows joined to the items': k, p, slots, item, exact, h, item_p and item_slots.

    A window that many items have, such as a benchmark's own boilerplate, would
    join all of them to each document that has it. An item needs some number of
    windows, so if fewer of its windows are common, a document must have one of
    the others: those are joined first, and common windows only for the pairs that
    this finds. Nothing is left out of these pairs.
    """
    often = items.groupBy("h", "exact").agg((F.countDistinct("item") > common).alias("common"))
    rated = items.join(often, ["h", "exact"])
    of_item = rated.groupBy("item", "exact").agg(F.countDistinct(F.when(F.col("common"), F.col("h"))).alias("c"))
    need = F.least(F.ceil(share * F.col("item_windows")), F.lit(run))
    of_item = of_item.join(totals, ["item", "exact"]).select("item", "exact", (F.col("c") < need).alias("has_rare"))
    rated = rated.join(of_item, ["item", "exact"])
    later = F.col("common") & F.col("has_rare")
    columns = ("k", "p", "slots", "item", "exact", "h", "item_p", "item_slots")
    first = found.join(rated.where(~later), ["h", "exact"]).select(*columns)
    candidates = first.select(F.struct("k").alias("key"), "item", "exact").distinct()
    wanted = candidates.join(rated.where(later).drop("common", "has_rare"), ["item", "exact"])
    second = found.withColumn("key", F.struct("k")).join(wanted, ["key", "h", "exact"]).select(*columns)
    return first.unionByName(second)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 8,
    literals: int = 5,
    share: float = 0.5,
    run: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    common: int = 64,
) -> DataFrame:
    """A row for each document and item that is in it: the ids, windows, item_windows and reparameterised.

    The counts are of template windows; of exact ones where only these find the item.
    The Bloom filter is at most 16 MB, however large the benchmark; only windows
    that pass it are shuffled. Reads the documents once and the benchmark three
    times. Windows of more than ``common`` items join no documents to items by
    themselves, unless such windows alone would do for an item.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items, _ = materialise(_exploded(benchmark, item_col, item_text, lambda t, codes: _item_rows(t, width, literals, codes)), "dc-items")

    def hashes(pdf: pd.DataFrame) -> np.ndarray:
        codes = _Codes()
        return np.array([h for t in pdf["t"] for h, *_ in _item_rows(t, width, literals, codes)], np.int64).view(np.uint64)

    bits = bloom.bits_for(input_bytes(benchmark, item_text))
    seen = bloom.filter_of(benchmark.select(F.col(item_text).alias("t")), hashes, bits)
    shared, widths = spark.sparkContext.broadcast(seen), [*_short_widths(benchmark, item_text, width), width]
    found, _ = materialise(_exploded(docs, id_col, text_col, lambda t, codes: _window_rows(t, widths, literals, codes, shared.value.has)), "dc-windows")

    items = items.select(F.col("k").alias("item"), "h", "exact", F.col("p").alias("item_p"), F.col("slots").alias("item_slots"))
    totals = items.groupBy("item", "exact").agg(F.countDistinct("h").alias("item_windows"))
    pairs = _met(found, items, totals, share, run, common)
    changed = F.zip_with("item_slots", "slots", lambda a, b: F.when(a != "", F.struct(a.alias("a"), b.alias("b"))))
    pairs = pairs.select("k", "item", "exact", "h", (F.col("p") - F.col("item_p")).alias("shift"), F.filter(changed, lambda s: s.isNotNull()).alias("slots"))
    # of one alignment: at most as many windows as the item has
    aligned = pairs.groupBy("k", "item", "exact", "shift").agg(
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
        F.collect_set("h").alias("all"),
        F.collect_set(F.when(F.size("slots") == 0, F.col("h"))).alias("plain"),
    )
    sources = F.size(F.array_distinct(F.transform("slots", lambda s: s["a"])))
    consistent = sources == F.size("slots")
    aligned = aligned.select(
        "k", "item", "exact", F.explode(F.when(consistent, F.col("all")).otherwise(F.col("plain"))).alias("h"),
        (consistent & F.exists("slots", lambda s: s["a"] != s["b"])).alias("other"),
    )
    matched = aligned.groupBy("k", "item", "exact").agg(F.countDistinct("h").alias("windows"), F.max("other").alias("reparameterised"))
    matched = matched.join(totals, ["item", "exact"]).where((F.col("windows") >= share * F.col("item_windows")) | (F.col("windows") >= run))
    counts = F.struct("exact", "windows", "item_windows", "reparameterised")
    first = matched.groupBy("k", "item").agg(F.min(counts).alias("r"))  # the templates' counts before the words'
    return first.select(F.col("k").alias(id_col), F.col("item").alias(item_col), "r.windows", "r.item_windows", "r.reparameterised")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item; rows without an id always stay."""
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.select("doc_id").where("doc_id is not null"), F.col("doc_id"))
