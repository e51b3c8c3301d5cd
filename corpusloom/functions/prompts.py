"""Prompt building as column expressions. The wording is this library's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: The question types of strict generation, and of example-conditioned generation; what stands for no
#: evidence; the header of a piece of evidence, in :func:`evidence_prompt`.
QUESTION_TYPES = ("factoid_QA", "open-ended_question", "summary_question", "recommendation_question")
EXAMPLE_TYPES = ("question & answer", "open-ended question", "summary question", "reasoning question")
NO_EVIDENCE = "No retrieved evidence was retained."

_TASKS = {
    "factoid_QA": "Ask one question whose answer is a single fact stated in the passage.",
    "open-ended_question": "Ask one question that calls for an explanation grounded in the passage.",
    "summary_question": "Ask for a summary of the passage and give that summary.",
    "recommendation_question": "Ask for advice in a situation that the passage informs, and give it.",
}


def truncate_input(text: Column, most: int = 3000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def generation_prompt(kind: Column, major: Column, sub: Column, text: Column) -> Column:
    """The prompt of a question type; an unknown type gives a text that starts with Error."""
    head = F.concat(F.lit("Category: "), major, F.lit(" / "), sub, F.lit("\nPassage:\n"), truncate_input(text), F.lit("\n\n"))
    tail = F.lit('\nReply with one JSON object with the string fields "instruction", "input" and "output".')
    out = F.concat(F.lit("Error: unknown question type "), kind)
    for name, task in _TASKS.items():
        out = F.when(kind == name, F.concat(head, F.lit(task), tail)).otherwise(out)
    return out


def example_prompt(kind: Column, major: Column, sub: Column, examples: Column) -> Column:
    """A prompt with numbered examples: an array of struct(instruction, input, output)."""
    shown = F.transform(
        examples,
        lambda e, i: F.concat(
            F.lit("Example "), (i + 1).cast("string"), F.lit("\ninstruction: "), e["instruction"], F.lit("\ninput: "), e["input"], F.lit("\noutput: "), e["output"]
        ),
    )
    return F.concat(
        F.lit("Write a new "), kind, F.lit(" sample for "), major, F.lit(" / "), sub, F.lit(".\n\n"), F.array_join(shown, "\n\n"),
        F.lit('\n\nReply with one JSON object with "instruction", "input" and "output".'),
    )


def evidence_prompt(question: Column, docs: Column) -> Column:
    """The question after its numbered evidence: an array of struct(content, source_file, section_id) in rank order."""
    parts = F.transform(
        docs,
        lambda d, i: F.concat(
            F.lit("[Evidence "), (i + 1).cast("string"), F.lit("] source_file="), F.coalesce(d["source_file"], F.lit("")),
            F.lit("; section_id="), F.coalesce(d["section_id"], F.lit("")), F.lit("\n"), d["content"],
        ),
    )
    context = F.coalesce(F.nullif(F.array_join(parts, "\n\n"), F.lit("")), F.lit(NO_EVIDENCE))
    return F.concat(F.lit("Answer with the help of the evidence.\n\n"), context, F.lit("\n\nQuestion:\n"), question)


def exam_prompt(prompt: Column, kind: Column, content: Column, options: Column) -> Column:
    """An item's own prompt, else one from its question and ordered options (array of struct(key, value))."""
    single = F.lower(F.coalesce(kind, F.lit(""))).contains("select one") | F.coalesce(kind, F.lit("")).contains("单选")
    lines = F.array_join(F.transform(options, lambda o: F.concat(o["key"], F.lit(": "), o["value"], F.lit("\n"))), "")
    label = F.when(single, F.lit("单选题")).otherwise(F.lit("多选题"))
    return F.coalesce(F.nullif(strip(prompt), F.lit("")), F.concat(label, F.lit("："), content, F.lit("\n"), lines, F.lit("请以“答案：”开头给出选项字母，再以“解析：”说明。")))


def bench_prompt(instruction: Column, text: Column, local: bool) -> Column:
    return F.concat(F.coalesce(instruction, F.lit("")), F.lit("\n" if local else "\n\n"), text)


def query_text(task: str, query: Column) -> Column:
    """A retrieval query with its instruction; documents get none."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), query)


def question_type_bucket(instruction: Column) -> Column:
    """The first example type whose name is in the instruction, case-sensitively, or null."""
    out = F.lit(None).cast("string")
    for name in reversed(EXAMPLE_TYPES):
        out = F.when(instruction.contains(name), F.lit(name)).otherwise(out)
    return out
