"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pre-tokens; each starts as one symbol per UTF-8 byte. The
symbols form a doubly linked list and every adjacent pair that has a merge
rank lies in a heap. The lowest rank (leftmost on ties) is popped, its two
symbols become one, and the two new neighbour pairs are pushed, until no
ranked pair is left. The count is the number of initial symbols minus the
number of merges; identifiers are never formed.

Null and empty texts have 0 tokens. The strings of the vocabulary's special
tokens count as one token each, wherever they stand, which is the library's
default. Very long pre-tokens cost O(n log n). Repeated rows are counted
independently; columns other than the id and the text are not read.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches, tokenizer_path

# Characters whose class (letter, digit, space, other) is the same in every
# Unicode version; texts with others are cut by the library's own pre-tokenizer.
_LETTER = r"A-Za-zÀ-ÖØ-öø-įı-ſ"
_OTHER = r"!-/:-@\[-`{-~«»¿¡‘’“”–—…€°"
UNUSUAL = re.compile(rf"[^ \t\n\r0-9{_LETTER}{_OTHER}]")
_PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[0-9]+| ?[{_OTHER}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
_CACHE_LIMIT, _CACHED_CHARS = 200_000, 64


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies, by rule:
    printable Latin-1 bytes stand for themselves, the rest are numbered from 256."""
    out, shift = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(shift))
            shift += 1
    return out


class PairMerger:
    """Counts the symbols that byte-pair merging leaves."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        self.ranks = ranks

    def count(self, symbols: list[str]) -> int:
        n = len(symbols)
        if n < 2:
            return n
        ranks, syms = self.ranks, list(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((syms[i], syms[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if syms[i] is None or j >= n or ranks.get((syms[i], syms[j])) != rank:
                continue  # one of the two has been merged since
            syms[i] += syms[j]
            syms[j] = None
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (r := ranks.get((syms[i], syms[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((syms[h], syms[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return n - merges


class _PieceCounts(dict):
    """Counts by pre-token, computed on first sight."""

    def __init__(self, merger: PairMerger):
        super().__init__()
        self.merger, self.symbols = merger, byte_symbols()

    def __missing__(self, piece: str) -> int:
        symbols = self.symbols
        n = self.merger.count([symbols[b] for b in piece.encode("utf-8")])
        if len(piece) <= _CACHED_CHARS:
            self[piece] = n
        return n


def _require_supported(spec: dict, path: str) -> None:
    """Only byte-level BPE files whose rules the counter follows; another one would be counted wrongly without a word."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    found = {
        "model": model.get("type", "BPE") != "BPE",
        "normalizer": spec.get("normalizer") is not None,
        "pre-tokenizer": cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") is not False or cut.get("use_regex") is False,
        "special strings": any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or not t["content"] for t in spec["added_tokens"]),
    }
    found |= {k: bool(model.get(k)) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")}
    if any(found.values()):
        raise ValueError(f"{path}: not supported: {', '.join(k for k, wrong in found.items() if wrong)}")


class TokenCounter:
    """Counts tokens as the library does for the byte-level BPE file at ``path``; files with other rules are refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as handle:
            spec = json.load(handle)
        _require_supported(spec, path)
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"])
        self.pieces = _PieceCounts(PairMerger({p: i for i, p in enumerate(pairs)}))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.sign = "<" if all("<" in s for s in special) else ""  # in every special string: a quick test of a text
        self.splitter = None

    def _cut(self, text: str) -> Iterable[str]:
        if UNUSUAL.search(text) is None:
            return _PIECES.findall(text)
        if self.splitter is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self.splitter = ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.pieces) > _CACHE_LIMIT:
            self.pieces.clear()
        parts = self.special.split(text) if self.special is not None and self.sign in text else [text]
        of = self.pieces.__getitem__
        return len(parts) - 1 + sum(sum(map(of, self._cut(p))) for p in parts if p)


_counters: dict[str, TokenCounter] = {}


def _counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.json",
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: the id, n_bytes, n_tokens and over_limit.

    A map over the scan of two columns: no shuffle, and memory bounded by an
    Arrow batch and a word cache of fixed size. The vocabulary is read by name
    from each worker's own installation, so nothing is broadcast.
    """

    @F.pandas_udf("n_bytes long, n_tokens long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = _counter(tokenizer_path(vocabulary))
        for texts in batches:
            values = [t or "" for t in texts]
            yield pd.DataFrame({
                "n_bytes": [len(t.encode("utf-8")) for t in values],
                "n_tokens": [counter.count(t) for t in values],
            }, dtype="int64")

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), counts(F.col(text_col)).alias("__c")).select(
        F.col(id_col),
        F.col("__c.n_bytes").alias("n_bytes"),
        F.col("__c.n_tokens").alias("n_tokens"),
        (F.col("__c.n_tokens") > limit).alias("over_limit"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
