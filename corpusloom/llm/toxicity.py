"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of
the hashed words and word beginnings it has; a document's is the noisy-or of its sentences', so one
offending sentence is enough and clean ones don't hide it. Only documents have
labels; the gradient of the document loss reaches the sentences through the
noisy-or, which is what lets the model point at the sentences to blame.

A noisy-or of very many sentences would add up the small probabilities that clean
ones have. Therefore the logistic function is made as steep as it takes for all
sentences of the clean training documents, multiplied to LONG sentences (about
16 MB of text), to leave a document clean; where a sentence's probability is 0.5
doesn't move. The worst sentence's probability before that adds 0.05 at most, so
documents without an offending sentence are ranked by it, whatever their length.

Null and empty texts have no sentence and score 0 (predicted 0). Repeated rows
and ties are scored alike, by their text alone. Very long texts are read whole,
sentence by sentence; other columns are not read. Without labels of both kinds
the model has no words and every document scores near 0.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, hash_share, small_batches

_SENTENCE = re.compile(r"[^.!?…\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_CACHE_LIMIT = 150_000
LONG, LEAK = 200_000, 0.05  # sentences of a clean text, and the noisy-or that they may have together
_TAIL = 0.1


@dataclass(frozen=True)
class ToxicityModel:
    """weights by hashed word (only those that training kept), and the bias and steepness of a sentence's logit."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -20.0
    bits: int = 20
    slope: float = 1.0


def word_features(word: str, bits: int) -> tuple[int, ...]:
    """Hashes of the word and of its first four and five letters, which inflected forms share."""
    mask, data = (1 << bits) - 1, word.encode("utf-8", "surrogatepass")
    whole = zlib.crc32(data) & mask
    if len(word) < 5:
        return (whole,)
    return whole, *(zlib.crc32(word[:n].encode("utf-8", "surrogatepass"), 1) & mask for n in (4, 5))


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """start, end and the words of each sentence."""
    for m in _SENTENCE.finditer(text):
        if words := _WORD.findall(m.group().lower()):
            yield m.start(), m.end(), words


def fit_noisy_or(texts: list[str], labels: list[int], bits: int = 20, least_share: float = 0.003, rounds: int = 150) -> ToxicityModel:
    """Fit twice: on all features that ``least_share`` of the documents have (4 at least),
    then anew on those of weight 1 or more, which leaves out words that only chance ties to a label."""
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(bits=bits)
    features, sentence_of, bag_of = array("I"), array("I"), array("I")
    for d, text in enumerate(texts):
        for _, _, words in sentences(text):
            found = {f for w in words for f in word_features(w, bits)}
            features.extend(found)
            sentence_of.extend([len(bag_of)] * len(found))
            bag_of.append(d)
    features, sentence_of, bag_of = (np.frombuffer(a, np.uint32) for a in (features, sentence_of, bag_of))
    pairs = np.unique((bag_of[sentence_of].astype(np.uint64) << np.uint64(bits)) | features)
    spread = np.bincount(pairs & np.uint64((1 << bits) - 1), minlength=1 << bits)
    keep = np.flatnonzero(spread >= max(4, least_share * len(texts)))
    for times in (1, 2):
        w, b = _fit(features, sentence_of, bag_of, y, keep, bits, times * rounds)
        if times == 1:
            keep = keep[w >= 1.0]
    weight = np.zeros(1 << bits)
    weight[keep] = w
    z = np.bincount(sentence_of, weight[features], len(bag_of)) + b
    return ToxicityModel(dict(zip(keep.tolist(), w.tolist())), b, bits, _steepness(z[y[bag_of] == 0]))


def _steepness(clean: np.ndarray, most: float = 64.0) -> float:
    """The least power of two, ``most`` at most, with which LONG sentences of these logits have a noisy-or of LEAK at most."""
    below, slope = clean[clean < 0], 1.0
    while slope < most and len(below) and np.exp(slope * below).mean() * LONG > LEAK:  # a bound of the sum of probabilities
        slope *= 2
    return slope


def _fit(
    features: np.ndarray, sentence_of: np.ndarray, bag_of: np.ndarray, y: np.ndarray, keep: np.ndarray, bits: int, rounds: int, rate: float = 0.4, decay: float = 1e-5
) -> tuple[np.ndarray, float]:
    """Weights of the features in ``keep`` and the bias, by full-batch Adagrad on the documents' log loss."""
    place = np.full(1 << bits, -1, np.int32)
    place[keep] = np.arange(len(keep), dtype=np.int32)
    used = place[features]
    sentence_of, features = sentence_of[used >= 0].astype(np.int32), used[used >= 0]
    n_sentences, n_docs = len(bag_of), len(y)
    w, b = np.zeros(len(keep)), -6.0
    seen_w, seen_b = np.full(len(keep), 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(sentence_of, w[features], n_sentences) + b
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(bag_of, np.log1p(-np.minimum(p, 1 - 1e-12)), n_docs)  # log of 1 - noisy-or
        toxic = np.maximum(-np.expm1(clean), 1e-12)
        pull = np.where(y == 1, -np.exp(clean) / toxic, 1.0)  # of the loss on each sentence's logit, over p
        g = pull[bag_of] * p
        gw = np.bincount(features, g[sentence_of], len(keep)) / n_docs + decay * w
        gb = g.sum() / n_docs
        seen_w += gw * gw
        seen_b += gb * gb
        w -= rate * gw / np.sqrt(seen_w)
        b -= rate * gb / np.sqrt(seen_b)
    return w, float(b)


class _Weights(dict):
    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        known = self.model.weights
        value = sum(known.get(f, 0.0) for f in word_features(word, self.model.bits))
        if len(self) < _CACHE_LIMIT:
            self[word] = value
        return value


def score_text(text: str | None, model: ToxicityModel, weights: _Weights | None = None) -> tuple[float, list[tuple[int, int, float]]]:
    """The noisy-or, and the sentences (start, end, score) of 0.5 or more, or else the worst one."""
    weights = _Weights(model) if weights is None else weights
    of, clean, found, worst, at = weights.__getitem__, 0.0, [], -np.inf, (0, 0, 0.0)
    for start, end, words in sentences(text or ""):
        z = model.bias + sum(map(of, set(words)))
        p = _probability(model.slope * z)
        clean += np.log1p(-p)
        if p >= 0.5:
            found.append((start, end, p))
        if z > worst:
            worst, at = z, (start, end, p)
    if worst == -np.inf:
        return 0.0, []
    clean += np.log1p(-_TAIL * min(0.5, _probability(worst)))
    return float(-np.expm1(clean)), found or [at]


def _probability(z: float) -> float:
    return math.exp(max(z, -700.0)) if z < -30 else 1.0 / (1.0 + math.exp(-z)) if z < 27 else 1.0 - 1e-12


def toxicity_column(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """struct(score, spans array<struct(start, end, score)>); the broadcast model is at most 2**bits weights."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,score:double>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        weights = _Weights(model)
        for texts in batches:
            rows = [score_text(t, model, weights) for t in texts]
            yield pd.DataFrame({
                "score": [r[0] for r in rows],
                "spans": [[{"start": a, "end": b, "score": p} for a, b, p in r[1]] for r in rows],
            })

    return score(text)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", sample_rows: int = 4000, sample_bytes: int = 8 << 20
) -> ToxicityModel:
    """Fit on a bounded sample of the documents that ``labels`` (key, label) marks.

    About ``sample_rows`` keys of each of the two labels, or all if there are
    fewer, are chosen by a hash and broadcast to the scan, so no text is
    shuffled. ``sample_bytes`` bounds the text that the driver gets for each
    label: where the chosen documents have more, a share of them is taken, whole
    texts, without those longer than a sixteenth of the bound.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key), F.col(label).alias("__y"))

    def shares(sizes: dict[int, int], most: int) -> Column:
        share = F.lit(0.0)
        for y, size in sizes.items():
            share = F.when(F.col("__y") == y, min(1.0, most / max(1, size))).otherwise(share)
        return share

    counts = {r["__y"]: r["count"] for r in marked.groupBy("__y").count().collect()}
    chosen = marked.where(hash_share(F.col(key).cast("string"), shares(counts, sample_rows), salt=1))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("__t"), F.octet_length(text).alias("__b"))
    rows = rows.where(F.col("__b") <= sample_bytes // 16).join(F.broadcast(chosen), key)
    sizes = {r["__y"]: r["b"] for r in rows.groupBy("__y").agg(F.sum("__b").alias("b")).collect()}
    sample = rows.where(hash_share(F.col(key).cast("string"), shares(sizes, sample_bytes), salt=2))
    found = sample.select(F.col(key).cast("string").alias("k"), F.col("__t").alias("t"), F.col("__y").alias("y")).toPandas().sort_values(["k", "t"])
    return fit_noisy_or(list(found["t"]), [int(v) for v in found["y"]])


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, score and the offending spans. A map over the scan."""
    found = toxicity_column(docs.sparkSession, model, F.col(text_col))
    return docs.select(F.col(id_col), found.alias("__t")).select(id_col, "__t.score", "__t.spans")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(fold(F.col("doc_id")) != 0)
    model = fit_toxicity(docs, labels)
    return score_toxicity(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )
