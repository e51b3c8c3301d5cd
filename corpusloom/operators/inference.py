"""Running prompts through a model: exams, benches and prompts with evidence.

A model is a provider (see :mod:`corpusloom.plans.providers`): a column function
from prompts to struct(response, error). A failed call is an error when the
results are read, as an answer that is missing must not count as wrong.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import prompts as T
from . import rag, scoring
from .lineage import cut

Provider = Callable[[Column], Column]


def answered(rows: DataFrame, prompt: str, provider: Provider, into: str) -> DataFrame:
    """Rows with the model's stripped answer in ``into``; an error when they are read if a call failed.

    Answers are written down once, so no later step asks the model again.
    """
    missing = F.when(F.length(F.coalesce(F.col(prompt), F.lit(""))) == 0, F.raise_error(F.lit("a record has no prompt")).cast("string"))
    said = rows.withColumn(prompt, F.coalesce(missing, F.col(prompt))).withColumn("__said", provider(F.col(prompt)))
    failed = F.raise_error(F.concat(F.lit("the model failed: "), F.coalesce("__said.error", F.lit("no answer")))).cast("string")
    return cut(said.withColumn(into, F.coalesce(P.strip(F.col("__said.response")), failed)).drop("__said"))


def _text(record: str, name: str) -> Column:
    return F.try_variant_get(record, f"$['{name}']", "string")


def _options(record: str) -> Column:
    """The options as an array of struct(key, value): an object's by key, a list's by letter."""
    named = F.transform(F.array_sort(F.map_entries(F.try_variant_get(record, "$.options", "map<string,string>"))), lambda e: F.struct(e["key"], e["value"]))
    listed = F.try_variant_get(record, "$.options", "array<string>")
    lettered = F.transform(listed, lambda v, i: F.struct(F.char(F.lit(65) + i).alias("key"), v.alias("value")))
    return F.coalesce(lettered, named, F.array().cast("array<struct<key:string,value:string>>"))


def exam_run(items: DataFrame, provider: Provider, record: str = "record") -> DataFrame:
    """Exam items (pos, record as variant) with question_number, prompt, raw_response, model_answer, model_analysis and is_correct."""
    kind = F.coalesce(_text(record, "question_type"), F.lit(""))
    content = F.coalesce(_text(record, "question_content"), _text(record, "question"))
    rows = items.withColumns({
        "question_number": F.coalesce(F.try_variant_get(record, "$.question_number", "long"), F.col("pos").cast("long") + 1),
        "question_type": kind, "correct_answer": F.coalesce(_text(record, "correct_answer"), F.lit("")),
        "prompt": T.exam_prompt(_text(record, "prompt"), kind, content, _options(record)),
    })
    return scoring.score_exam(answered(rows, "prompt", provider, "raw_response"))


def exam_report(scored: DataFrame, model: str) -> DataFrame:
    """One row: model, total_questions, total_questions_processed, correct_answers and accuracy."""
    found = scoring.accuracy(scored).withColumn("total_questions_processed", F.col("total_questions"))
    return found.select(F.lit(model).alias("model"), "total_questions", "total_questions_processed", "correct_answers", "accuracy")


def bench_run(items: DataFrame, provider: Provider, local: bool = False, record: str = "record") -> DataFrame:
    """Bench items (pos, record) as pos, instruction, input and output, the model's answer; an item without input is an error."""
    asked = F.coalesce(_text(record, "input"), F.raise_error(F.lit("a bench item has no input")).cast("string"))
    rows = items.select("pos", F.coalesce(_text(record, "instruction"), F.lit("")).alias("instruction"), asked.alias("input"))
    rows = rows.withColumn("__prompt", T.bench_prompt(F.col("instruction"), F.col("input"), local))
    return answered(rows, "__prompt", provider, "output").drop("__prompt")


def rag_run(
    rows: DataFrame, provider: Provider, tokens: Callable[[Column], Column], model: str, prompt: str = "rag_prompt", gold: str | None = None,
    use_rag: bool = True, new_tokens: int = 1024, context: int = 32_768,
) -> DataFrame:
    """Rows with model_path, use_rag, answer, extracted_answer, input_tokens, output_tokens and, with ``gold``, is_correct.

    ``tokens`` counts a prompt's tokens as the model does; one that leaves no room
    for ``new_tokens`` in ``context`` is an error, before the model is asked.
    """
    counted = rag.require_budget(rows.withColumn("input_tokens", tokens(F.col(prompt))), "input_tokens", new_tokens, context)
    out = answered(counted, prompt, provider, "answer").withColumns({
        "model_path": F.lit(model), "use_rag": F.lit(use_rag), "output_tokens": tokens(F.col("answer")), "extracted_answer": P.extract_choice(F.col("answer")),
    })
    if gold is None:
        return out
    right = P.blank_to_null(F.col(gold))
    return out.withColumn("is_correct", F.when(right.isNotNull(), F.coalesce(F.col("extracted_answer") == F.upper(right), F.lit(False))))
