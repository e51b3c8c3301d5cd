"""Scoring of multiple-choice answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P


def score_exam(rows: DataFrame, kind: str = "question_type", prompt: str = "prompt", response: str = "raw_response", gold: str = "correct_answer") -> DataFrame:
    """Add model_answer, model_analysis and is_correct; an empty gold answer is never right."""
    answer = P.extract_answer(F.col(response), P.is_single(F.col(kind), F.col(prompt)))
    right = P.gold_letters(F.coalesce(F.col(gold), F.lit("")))
    return rows.withColumns({
        "model_answer": answer, "model_analysis": P.analysis(F.col(response)), "is_correct": (right != "") & (answer == right),
    })


def score_choice(rows: DataFrame, response: str = "response", gold: str = "correct_answer") -> DataFrame:
    """Add predicted and is_correct; null where there is no gold answer."""
    right = F.upper(P.blank_to_null(F.col(gold)))
    predicted = P.extract_choice(F.col(response))
    return rows.withColumn("predicted", predicted).withColumn("is_correct", F.when(right.isNotNull(), F.coalesce(predicted == right, F.lit(False))))


def accuracy(scored: DataFrame) -> DataFrame:
    """One row: total_questions, correct_answers and accuracy."""
    return scored.agg(
        F.count(F.lit(1)).alias("total_questions"), F.sum(F.col("is_correct").cast("long")).alias("correct_answers"), F.avg(F.col("is_correct").cast("int")).alias("accuracy")
    )
