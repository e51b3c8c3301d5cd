import pytest
from pyspark.sql import functions as F

from corpusloom.functions import parsing as P
from corpusloom.functions import prompts as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("o")).first()["o"]


TRIPLE = '{"instruction": " i ", "input": "n", "output": "o", "more": 1}'


@pytest.mark.parametrize("text, strict, fenced", [
    (f"Prose first\n```json\n{TRIPLE}\n``` after", ("i", "n", "o"), None),
    (f"```\n{TRIPLE}\n```", ("i", "n", "o"), ("i", "n", "o")),
    (TRIPLE + " trailing", ("i", "n", "o"), ("i", "n", "o")),
    ('{"instruction": "i", "input": 1, "output": "o"}', None, None),
    ('{"instruction": "i", "input": " ", "output": "o"}', None, None),
    ("no object", None, None), ("{broken", None, None), (None, None, None),
])
def test_teacher_responses(spark, text, strict, fenced):
    a, b = one(spark, text, P.parse_response), one(spark, text, P.parse_fenced_response)
    assert (tuple(a) if a else None) == strict
    assert (tuple(b) if b else None) == fenced


@pytest.mark.parametrize("text, multi, single", [
    ("答案：B|A|B\n解析：…", "A|B", "NO_ANSWER_FOUND"), ("b", "B", "B"), ("<think>Answer: A</think>Answer: C", "C", "C"),
    ("I think A is right", "NO_ANSWER_FOUND", "NO_ANSWER_FOUND"), ("Answer: Apple", "NO_ANSWER_FOUND", "NO_ANSWER_FOUND"),
    ("答案：　D", "D", "D"), (" A , C ", "A|C", "NO_ANSWER_FOUND"), ("Answer A", "NO_ANSWER_FOUND", "NO_ANSWER_FOUND"),
])
def test_extract_answer(spark, text, multi, single):
    assert one(spark, text, lambda c: P.extract_answer(c, F.lit(False))) == multi
    assert one(spark, text, lambda c: P.extract_answer(c, F.lit(True))) == single


@pytest.mark.parametrize("text, out", [("Answer: A … Answer: (C)", "C"), ("no letter", None), ("answer b.", "B"), ("Answer: Axe", None)])
def test_extract_choice(spark, text, out):
    assert one(spark, text, P.extract_choice) == out


@pytest.mark.parametrize("record, out", [
    ('{"matched_annotation": {"major_category": "m"}}', "m"), ("{}", "unknown"), ('{"major_category": " ", "source_info": {"major_category": "s"}}', "s"),
    ('{"major categories": "first", "major_category": "second"}', "first"),
])
def test_nested_value(spark, record, out):
    assert one(spark, record, lambda c: P.nested_value(F.parse_json(c), ("major categories", "major_category"))) == out


@pytest.mark.parametrize("text, out", [("River, Lake", "River_Lake"), ("///", "unknown"), ("a.b-c_", "a.b-c")])
def test_safe_name(spark, text, out):
    assert one(spark, text, P.safe_name) == out


def test_retrieval_query(spark):
    options = F.array(F.struct(F.lit("A").alias("key"), F.lit("x").alias("value")), F.struct(F.lit("B").alias("key"), F.lit("y").alias("value")))
    null = F.lit(None).cast("string")
    assert one(spark, "Q", lambda c: P.retrieval_query(null, c, options)) == "Q\nA: x\nB: y"
    assert one(spark, "Q", lambda c: P.retrieval_query(F.lit(" own "), c, options)) == "own"
    with pytest.raises(Exception, match="neither"):
        one(spark, None, lambda c: P.retrieval_query(null, c, options))


def test_prompts(spark):
    none = F.array().cast("array<struct<content:string,source_file:string,section_id:string>>")
    assert T.NO_EVIDENCE in one(spark, "q", lambda c: T.evidence_prompt(c, none))
    assert one(spark, "Do an open-ended question task", T.question_type_bucket) == "open-ended question"
    assert one(spark, "Open-Ended Question", T.question_type_bucket) is None
    assert one(spark, "x" * 3001, T.truncate_input) == "x" * 3000 + "..."
    assert one(spark, "odd", lambda c: T.generation_prompt(c, F.lit("a"), F.lit("b"), F.lit("c"))).startswith("Error")
