"""Packing documents into fixed-length sequences by cutting-stock column generation.

1. Each document becomes its token ids plus one end id; a map cuts off whole
   sequences' worth, so at most one shorter piece a document is left. Only the
   pieces' lengths and checksums go on, never ids.
2. The lengths, rounded up to classes of ``quantum`` tokens, form a histogram of
   at most capacity / quantum rows: all that the driver gets at any corpus size.
3. A linear program over patterns (how many pieces of each class share a
   sequence) minimises the number of sequences. Columns are priced by an
   unbounded-knapsack dynamic program over the duals until none improves it or
   the proven gap is small. Patterns are rounded down; what is left is packed
   best fit, decreasing.
4. Pieces are ranked inside their class, and a rank determines the pattern, the
   sequence and the place there; offsets are sums inside a sequence.

Null and empty texts are documents of the end id alone. Repeated rows are packed
once each. A very long text is tokenized whole and makes many full sequences.
Ties are ordered by id. An empty table packs into an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise, ranked, small_batches, tokenizer_path
from .workers import tidy

_LETTER = r"A-Za-zÀ-ÖØ-öø-įı-ſ"
_OTHER = r"!-/:-@\[-`{-~«»¿¡‘’“”–—…€°"
_UNUSUAL = re.compile(rf"[^ \t\n\r0-9{_LETTER}{_OTHER}]|<\|(?:startoftext|endoftext)\|>")
_PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_LETTER}]+|[0-9]|[{_OTHER}]+")
_CACHE_LIMIT, _CACHED_CHARS, _GROUP_CHARS = 200_000, 64, 1 << 20


class WordTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, as the library gives them.

    Texts of usual characters are cut into the words that the vocabulary's own
    rules cut out, and each new word goes to the library once; texts with other
    characters or special strings go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one thread
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        if suffix:
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """One call for many words with blanks between them, cut after the ids that end a word."""
        if not self.last.any():
            return self._encode(words)
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(ends) != len(words):
            return self._encode(words)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= _GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.words) > _CACHE_LIMIT:
            self.words.clear()
        known = self.words
        cut = [None if _UNUSUAL.search(t) else _PIECES.findall(t.lower()) for t in texts]
        new = list({w for ws in cut if ws is not None for w in ws if w not in known})
        extra = {}
        for word, ids in zip(new, self._encode_words(new)):
            (known if len(word) <= _CACHED_CHARS else extra)[word] = ids
        of = known.__getitem__ if not extra else lambda w: known[w] if w in known else extra[w]
        for text, ws in zip(texts, cut):
            yield self._encode([text])[0] if ws is None else b"".join(map(of, ws))


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def cut_documents(
    docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32 and doc_tokens. A map over the scan."""

    @F.pandas_udf("doc_tokens long, pieces array<struct<start:long,length:long,crc:long>>")
    @tidy
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer, end = _tokenizer(tokenizer_path(vocabulary)), struct.pack("<I", end_id)
        for column in batches:
            tokens, pieces = [], []
            for ids in tokenizer.ids([t or "" for t in column]):
                ids += end
                n = len(ids) // 4
                tokens.append(n)
                pieces.append([
                    {"start": s, "length": min(capacity, n - s), "crc": zlib.crc32(ids[4 * s : 4 * (s + capacity)])}
                    for s in range(0, n, capacity)
                ])
            yield pd.DataFrame({"doc_tokens": np.array(tokens, np.int64), "pieces": pieces})
        tokenizer.words.clear()  # the worker lives on for other tasks

    small_batches(docs.sparkSession)
    found = docs.select(F.col(id_col), cut(F.col(text_col)).alias("__c"))
    found = found.select(id_col, F.col("__c.doc_tokens").alias("doc_tokens"), F.explode("__c.pieces").alias("__p"))
    return found.select(
        id_col, F.col("__p.start").alias("start"), F.col("__p.length").alias("length"), F.col("__p.crc").alias("ids_crc32"), "doc_tokens"
    )


def _knapsack(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best pattern: value[c] is what a piece of c units brings (c from 1; value[0] unused)."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for room in range(1, capacity + 1):
        gains = value[1 : room + 1] + best[room - 1 :: -1] if room > 0 else value[:0]
        c = int(gains.argmax())
        best[room], took[room] = gains[c], c + 1
        if best[room - 1] >= best[room]:
            best[room], took[room] = best[room - 1], 0
    pattern, room = np.zeros(capacity + 1, int), capacity
    while room > 0:
        if took[room]:
            pattern[took[room]] += 1
            room -= took[room]
        else:
            room -= 1
    return float(best[capacity]), pattern


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots; without LAPACK, whose threads can hang beside a JVM."""
    m = len(matrix)
    both = np.hstack([matrix, np.eye(m)])
    for k in range(m):
        pivot = k + int(np.abs(both[k:, k]).argmax())
        both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        rest = both[:, k].copy()
        rest[k] = 0.0
        both -= np.outer(rest, both[k])
    return both[:, m:]


def solve_patterns(demand: dict[int, int], capacity: int, gap: float = 1e-3, patience: int = 600) -> list[tuple[dict[int, int], int]]:
    """Patterns {class: pieces} with multiplicities that cover ``demand`` {class in units: pieces}.

    Revised simplex over the generated columns; a basis of as many rows as
    classes are in use. Ends when the better of Farley's bound and the units that
    there are proves the value within ``gap`` (or half a sequence) of the optimum,
    or when ``patience`` columns in a row have not brought a tenth of that. The
    basis is feasible at every step, so the result always covers the demand.
    """
    classes = sorted(c for c, n in demand.items() if n > 0)
    m = len(classes)
    if not m:
        return []
    need = np.array([demand[c] for c in classes], dtype=float)
    at = np.array(classes)
    basis = np.zeros((m, m))  # a column for each pattern
    fits = capacity // at
    basis[np.arange(m), np.arange(m)] = fits
    inverse = np.diag(1.0 / fits)
    bound = float(need @ at) / capacity
    exact, need = need, need + 1e-3 * np.arange(1, m + 1) / m  # parts ties, on which the simplex could stall
    amounts = need / fits
    least, since, round_ = np.inf, 0, 0
    while True:
        duals = inverse.sum(axis=0)
        value = np.full(capacity + 1, -1.0)
        value[at] = np.maximum(duals, 0.0)
        gain, pattern = _knapsack(value, capacity)
        total = amounts.sum()
        bound = max(bound, total / gain)
        since = 0 if total < least - 0.1 * gap * total else since + 1
        least = total if since == 0 else least
        if gain <= 1 + 1e-9 or total - bound <= max(0.5, gap * total) or since > patience:
            break
        round_ += 1
        column = pattern[at].astype(float)
        direction = inverse @ column
        up = direction > 1e-9
        if not up.any():
            break
        ratios = np.where(up, amounts / np.where(up, direction, 1.0), np.inf)
        out = int(ratios.argmin())
        step = max(0.0, ratios[out])
        amounts = np.maximum(amounts - step * direction, 0.0)
        amounts[out] = step
        basis[:, out] = column
        if round_ % 500 == 0:  # anew, against rounding errors
            inverse = _inverse(basis)
            amounts = np.maximum(inverse @ need, 0.0)
        else:
            row = inverse[out] / direction[out]
            inverse -= np.outer(direction, row)
            inverse[out] = row
    times = np.floor(amounts + 1e-7).astype(np.int64)
    left = exact.astype(np.int64) - np.rint(basis @ times).astype(np.int64)
    found = [({int(at[i]): int(basis[i, k]) for i in np.flatnonzero(basis[:, k])}, int(times[k])) for k in range(m) if times[k] > 0]
    return found + [(p, 1) for p in _best_fit({int(c): int(n) for c, n in zip(at, left) if n > 0}, capacity)]


def _best_fit(pieces: dict[int, int], capacity: int) -> list[dict[int, int]]:
    """Best fit, decreasing, of the few pieces that rounding leaves (at most about classes x pieces a sequence)."""
    open_by_room: dict[int, list[dict[int, int]]] = {}
    done: list[dict[int, int]] = []
    for c in sorted(pieces, reverse=True):
        for _ in range(pieces[c]):
            room = next((r for r in range(c, capacity + 1) if open_by_room.get(r)), None)
            if room is None:
                room, held = capacity, {}
                done.append(held)
            else:
                held = open_by_room[room].pop()
            held[c] = held.get(c, 0) + 1
            open_by_room.setdefault(room - c, []).append(held)
    return done


@dataclass(frozen=True)
class Slots:
    """Where the pieces of each class go, by rank: sorted first ranks, first sequence and pieces a sequence."""

    first_rank: dict[int, np.ndarray]
    first_sequence: dict[int, np.ndarray]
    each: dict[int, np.ndarray]

    @staticmethod
    def of(patterns: list[tuple[dict[int, int], int]]) -> Slots:
        rows: dict[int, list[tuple[int, int, int]]] = {}
        filled: dict[int, int] = {}
        sequence = 0
        for pattern, times in patterns:
            for c, n in pattern.items():
                rows.setdefault(c, []).append((filled.get(c, 0), sequence, n))
                filled[c] = filled.get(c, 0) + n * times
            sequence += times
        column = lambda k: {c: np.array([r[k] for r in rs], np.int64) for c, rs in rows.items()}
        return Slots(column(0), column(1), column(2))

    def sequences(self, classes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ranks), np.int64)
        for c in np.unique(classes):
            here = classes == c
            k = np.searchsorted(self.first_rank[c], ranks[here], side="right") - 1
            out[here] = self.first_sequence[c][k] + (ranks[here] - self.first_rank[c][k]) // self.each[c][k]
        return out


def pack_pieces(pieces: DataFrame, capacity: int = 2048, quantum: int = 8, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to the rows of :func:`cut_documents`.

    ``pieces`` is read three times, so give a materialised table. Two shuffles
    of these narrow rows: by class and rank slot, and by sequence.
    """
    spark = pieces.sparkSession
    classed = pieces.withColumn("__class", F.ceil(F.col("length") / quantum).cast("int"))
    demand = {r["__class"]: r["n"] for r in classed.groupBy("__class").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.sparkContext.broadcast(Slots.of(solve_patterns(demand, capacity // quantum)))

    @F.pandas_udf("long")
    def sequence(classes: pd.Series, ranks: pd.Series) -> pd.Series:
        return pd.Series(slots.value.sequences(classes.to_numpy(), ranks.to_numpy()))

    spread = max(16, sum(demand.values()) // 250_000)
    placed = ranked(classed, ["__class"], [id_col, "start"], "__rank", spread)
    placed = placed.withColumn("sequence_id", sequence(F.col("__class"), F.col("__rank")))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), id_col, "start", "__rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("__class", "__rank")


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 1, quantum: int = 8) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    pieces, _ = materialise(cut_documents(docs, vocabulary, capacity, end_id), "pieces")
    return pack_pieces(pieces, capacity, quantum)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, documents(spark, sf_dir), sf_dir)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "start", "length", "ids_crc32", "sequence_id", "offset", "doc_tokens")
    return pack_documents(docs).select(*columns)
