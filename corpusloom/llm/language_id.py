"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed character n-grams (of 2 and 3 code points, lower-cased)
of a bounded, documented sample of labelled texts; the table of smoothed log
probabilities, one row for each language, is broadcast. Scoring adds the rows'
entries at the n-grams that a text has, for a whole Arrow batch at once.

Texts that are null or have no letter get ``und`` with score 0. A text is read
whole; long ones in overlapping blocks, so memory stays bounded. With no
training rows at all every text gets ``und``. Ties go to the language that
sorts first. Repeated rows are scored independently; other columns, also ones
with clashing names, pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, hash_share, small_batches
from .workers import tidy

UNKNOWN = "und"
ORDERS = (2, 3)
_BLOCK = 1 << 21  # code points that are hashed at once
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageModel:
    """languages sorted; log_prob float32 (languages, len(ORDERS) << bits); prior float64."""

    languages: tuple[str, ...]
    log_prob: np.ndarray
    prior: np.ndarray
    bits: int


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _hashed(points: np.ndarray, order: int, slot: int, bits: int) -> np.ndarray:
    """A table index for each n-gram that starts in ``points``."""
    n = len(points) - order + 1
    h = np.zeros(max(n, 0), dtype=np.uint32)
    for k in range(order):
        h = (h ^ points[k : k + len(h)]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - bits)).astype(np.int32) + np.int32(slot << bits)


def _blocks(texts: list[str], orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of about _BLOCK characters, the first place and the end of each text there, and its number.

    n-grams start inside a text; behind it stand as many line ends as the longest
    of them needs, so none reaches the next text. A longer text is cut into
    blocks behind which its own next characters stand.
    """
    reach = max(orders) - 1
    held, starts, ends, owners, size = [], [], [], [], 0

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return _code_points("".join(held)), np.array(starts), np.array(ends), np.array(owners)

    for number, text in enumerate(texts):
        for at in range(0, len(text), _BLOCK):
            part = text[at : at + _BLOCK].lower()
            starts.append(size)
            ends.append(size + len(part))
            owners.append(number)
            held.append(part + (text[at + _BLOCK : at + _BLOCK + reach].lower() + "\n" * reach)[:reach])
            size += len(part) + reach
            if size >= _BLOCK:
                yield block()
                held, starts, ends, owners, size = [], [], [], [], 0
    if held:
        yield block()


def score_texts(texts: list[str], model: LanguageModel) -> np.ndarray:
    """Log likelihoods, (texts, languages); a row depends on its text alone."""
    out = np.tile(model.prior, (len(texts), 1))
    for points, starts, ends, owners in _blocks(texts, ORDERS):
        edges = np.stack([starts, ends], axis=1).ravel()
        for slot, order in enumerate(ORDERS):
            at = _hashed(points, order, slot, model.bits)
            for k in range(len(model.languages)):
                sums = np.add.reduceat(np.append(model.log_prob[k][at], np.float32(0)), edges, dtype=np.float64)[::2]
                np.add.at(out[:, k], owners, sums)
    return out


def fit_language_model(
    rows: DataFrame,
    text: str = "text",
    label: str = "lang",
    key: str = "doc_id",
    sample_bytes: int = 16 << 20,
    bits: int = 16,
    smoothing: float = 0.1,
    most_languages: int = 128,
) -> LanguageModel:
    """Fit on the rows that have a label.

    ``most_languages`` bounds the model: where there are more labels, those with
    the most text are learned (ties by name) and the others are never predicted.
    The driver's table takes 1 MB a language at 16 bits and the broadcast 0.5 MB.

    ``sample_bytes`` bounds the text that is used for each language: where a
    language has more, a share of its rows by a hash of ``key`` is taken, whole
    texts, and rows longer than an eighth of the bound are left out. What
    reaches the driver is one table of counts for each language.
    """
    spark = rows.sparkSession
    usable = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    usable = usable.select(
        F.col(key).cast("string").alias("k"), F.col(label).alias("l"), F.col(text).alias("t"),
        F.octet_length(text).alias("b"),
    ).where(F.col("b") <= sample_bytes // 8)
    largest = usable.groupBy("l").agg(F.sum("b").alias("b")).orderBy(F.desc("b"), "l").limit(most_languages)
    sizes = {r.l: r.b for r in largest.collect()}
    languages = tuple(sorted(sizes))
    width = len(ORDERS) << bits
    if not languages:
        return LanguageModel((), np.zeros((0, width), np.float32), np.zeros(0), bits)
    share = F.element_at(
        F.create_map(*[F.lit(x) for l in languages for x in (l, min(1.0, sample_bytes / max(1, sizes[l])))]), F.col("l")
    )
    sample = usable.where(F.col("l").isin(*languages) & hash_share(F.col("k"), share))

    @tidy
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, texts in pdf.groupby("l")["t"]:
                have = totals.setdefault(lang, np.zeros(width, np.int64))
                for points, starts, ends, _ in _blocks(list(texts), ORDERS):
                    inside = np.zeros(len(points) + 1, np.int8)
                    inside[starts] += 1
                    inside[ends] -= 1
                    inside = np.cumsum(inside, dtype=np.int8) > 0
                    for slot, order in enumerate(ORDERS):
                        at = _hashed(points, order, slot, bits)
                        have += np.bincount(at[inside[: len(at)]], minlength=width)
        for lang, have in totals.items():
            at = np.flatnonzero(have)
            yield pd.DataFrame({"l": lang, "i": at.astype(np.int32), "n": have[at]})

    counts = sample.select("l", "t").mapInPandas(count, "l string, i int, n long").groupBy("l", "i").agg(F.sum("n").alias("n"))
    table = np.zeros((len(languages), width))
    place = {lang: k for k, lang in enumerate(languages)}
    found = counts.toPandas()
    table[found["l"].map(place).to_numpy(int), found["i"].to_numpy(int)] = found["n"].to_numpy(float)
    parts = table.reshape(len(languages), len(ORDERS), 1 << bits) + smoothing
    log_prob = np.log(parts / parts.sum(axis=2, keepdims=True)).reshape(len(languages), width)
    prior = np.full(len(languages), -np.log(len(languages)))
    return LanguageModel(languages, log_prob.astype(np.float32), prior, bits)


def predict_language(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """struct(lang_pred string, score double) for a column of texts.

    The broadcast table holds languages x 2 x 2**bits float32 values: 0.5 MB a
    language at 16 bits, however large the corpus is.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    @tidy
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for column in batches:
            texts = [t or "" for t in column]
            known = np.array([bool(model.languages) and _LETTER.search(t) is not None for t in texts], dtype=bool)
            label = np.full(len(texts), UNKNOWN, dtype=object)
            score = np.zeros(len(texts))
            if known.any():
                logs = score_texts([t for t, k in zip(texts, known) if k], model)
                best = logs.argmax(axis=1)
                odds = np.exp(logs - logs.max(axis=1, keepdims=True))
                label[known] = np.array(model.languages, dtype=object)[best]
                score[known] = 1.0 / odds.sum(axis=1)
            yield pd.DataFrame({"lang_pred": label, "score": score})

    return predict.asNondeterministic()(text)  # so that a filter of the result doesn't compute it a second time


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, lang_pred and score. A map over the scan."""
    found = predict_language(docs.sparkSession, model, F.col(text_col))
    return docs.select(F.col(id_col), found.alias("__p")).select(id_col, "__p.lang_pred", "__p.score")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold(F.col("doc_id")) != 0)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify_languages(docs, fit_language_model(training_rows(docs)))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def _has_letter(text: Column) -> Column:
    @F.pandas_udf("boolean")
    def has(column: pd.Series) -> pd.Series:
        return pd.Series([_LETTER.search(t or "") is not None for t in column], dtype=bool)

    return has(text)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: Sequence[str] | None = None) -> DataFrame:
    """Documents that have a language, of those in ``languages`` if given; those without any letter go.

    The prediction decides, and names the language of documents without one; a
    given ``lang`` stays as it is.
    """
    model = fit_language_model(training_rows(docs))
    if not model.languages:  # no labelled row to learn from: every text would be unknown
        return docs.where(_has_letter(F.col("text")))
    found = docs.withColumn("__lang_pred", predict_language(spark, model, F.col("text"))["lang_pred"])
    found = found.where(F.col("__lang_pred") != UNKNOWN if languages is None else F.col("__lang_pred").isin(*languages))
    return found.withColumn("lang", F.coalesce("lang", "__lang_pred")).select(*docs.columns)
