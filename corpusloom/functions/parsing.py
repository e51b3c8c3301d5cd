"""Parsing of model responses, answers and nested records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

TRIPLE = ("instruction", "input", "output")
NO_ANSWER = "NO_ANSWER_FOUND"


def blank_to_null(text: Column) -> Column:
    """The stripped text, null if nothing is left."""
    return let(strip(text), lambda bare: F.when(bare != "", bare))


def string_field(value: Column, name: str) -> Column:
    """A field of a variant if it is a string; numbers aren't turned into text."""
    return let(F.try_variant_get(value, f"$['{name}']", "variant"), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))


def valid_triple(value: Column) -> Column:
    """struct(instruction, input, output), stripped, or null unless all three are non-blank strings."""
    fields = lambda v: F.struct(*[blank_to_null(string_field(v, name)).alias(name) for name in TRIPLE])
    whole = lambda t: F.when(t["instruction"].isNotNull() & t["input"].isNotNull() & t["output"].isNotNull(), t)
    return let(value, lambda v: let(fields(v), whole))


def _object_from_brace(text: Column) -> Column:
    """The variant that starts at the first brace; text after it is ignored, malformed text is null."""
    return let(F.locate("{", text), lambda at: F.when(at > 0, F.try_parse_json(F.substring(text, at, F.length(text)))))


def _fenced(text: Column) -> Column:
    """What the first fence holds, without the word json at its beginning; null if no fence is closed."""
    mark, size = F.lit("```"), F.length(text)

    def held(rest: Column) -> Column:
        inner = let(F.locate("```", rest), lambda end: F.when(end > 0, F.substring(rest, F.lit(1), end - 1)))
        return let(inner, lambda t: strip(F.when(F.lower(F.substring(t, 1, 4)) == "json", F.substring(t, F.lit(5), F.length(t))).otherwise(t)))

    return let(F.locate("```", text), lambda at: F.when(at > 0, held(F.substring(text, at + F.length(mark), size))))


def parse_response(response: Column) -> Column:
    """The triple in a response: in the first fenced block if there is one, else in the whole; what follows it is ignored."""
    return valid_triple(let(strip(response), lambda bare: let(F.coalesce(_fenced(bare), bare), _object_from_brace)))


def parse_fenced_response(response: Column) -> Column:
    """As :func:`parse_response`, but the text must start with the object, or with the fence around it."""
    within = lambda bare: F.when(bare.startswith("```"), F.coalesce(_fenced(bare), bare)).otherwise(bare)
    start = lambda text: F.when(text.startswith("{"), _object_from_brace(text))
    return valid_triple(let(strip(response), lambda bare: let(within(bare), start)))


def nested_value(record: Column, keys: Sequence[str], default: str = "unknown") -> Column:
    """The first non-blank string under ``keys``: in the record, then in its source_info, source_data and matched_annotation."""
    found = [
        blank_to_null(F.try_variant_get(record, f"${inner}['{key}']", "string"))
        for inner in ("", "['source_info']", "['source_data']", "['matched_annotation']")
        for key in keys
    ]
    return F.coalesce(*found, F.lit(default))


def safe_name(text: Column) -> Column:
    """A file name of letters, digits and _ . - only."""
    name = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))


def scalar_or_empty(value: Column) -> Column:
    """A scalar as text; null and NaN are empty."""
    text = value.cast("string")
    return F.when(value.isNull() | (F.lower(text) == "nan"), "").otherwise(text)


def retrieval_query(explicit: Column, question: Column, options: Column) -> Column:
    """The explicit query, else the question with its options (array of struct(key, value)) a line each; an error without either.

    An option without a key is its value alone; blank values are left out.
    """
    lines = F.filter(
        F.transform(options, lambda o: F.when(blank_to_null(o["value"]).isNotNull(), F.concat_ws(": ", blank_to_null(o["key"]), strip(o["value"])))),
        lambda line: line.isNotNull(),
    )
    asked = blank_to_null(question)
    built = F.when(asked.isNotNull(), F.array_join(F.concat(F.array(asked), F.coalesce(lines, F.array().cast("array<string>"))), "\n"))
    return F.coalesce(blank_to_null(explicit), built, F.raise_error(F.lit("a record has neither retrieval_query nor question")).cast("string"))


#: The labels and separators of an answer.
_ANSWER_LABELS = "最终答案|正确答案|答案|final answer|answer"
_ANSWER_LETTERS = r"[A-D](?:[\s|、,，]*[A-D])*"
_CHOICE = r"(?iU)(?:Answer|答案)\s*[:：]?\s*\(?\s*([A-D])\b"


def is_single(kind: Column, prompt: Column) -> Column:
    """Whether an item has one right letter, by its kind or, without a kind, by its prompt."""
    kind = F.coalesce(kind, F.lit(""))
    return F.lower(kind).contains("select one") | kind.contains("单选") | ((kind == "") & F.coalesce(prompt, F.lit("")).contains("单选题"))


def extract_answer(response: Column, single: Column) -> Column:
    """The letters of the last labelled answer, or of a response of letters alone, joined by | in order."""
    text = F.regexp_replace(response, r"(?s)<think>.*?</think>", "")
    labelled = rf"(?iU)(?:{_ANSWER_LABELS})\s*[:：]\s*\**\s*\[?\s*({_ANSWER_LETTERS})(?![A-Za-z])"
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(labelled), F.lit(1)), F.lit(-1))
    alone = F.when(text.rlike(rf"(?iU)^\s*{_ANSWER_LETTERS}\s*$"), text)
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(last, alone)), F.lit("([A-D])"), F.lit(1))))
    ok = (F.size(found) > 0) & (~single | (F.size(found) == 1))
    return F.when(F.coalesce(ok, F.lit(False)), F.array_join(found, "|")).otherwise(NO_ANSWER)


def extract_choice(text: Column) -> Column:
    """The letter of the last labelled choice, in upper case, or null; the colon may be missing."""
    return F.upper(F.try_element_at(F.regexp_extract_all(text, F.lit(_CHOICE), F.lit(1)), F.lit(-1)))


def gold_letters(gold: Column) -> Column:
    """The distinct letters of a gold answer in order, joined by |."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(gold), F.lit("([A-D])"), F.lit(1)))), "|")


def analysis(text: Column) -> Column:
    """What stands after the first analysis label, stripped; empty without one."""
    return F.coalesce(strip(F.regexp_extract(text, r"(?s)解析[：:](.*)$", 1)), F.lit(""))


def fingerprint(*columns: Column | str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def checkpoint_key(major: Column, sub: Column) -> Column:
    """The first 16 hex digits of the digest of a group's names."""
    return F.substring(F.sha2(F.to_json(F.array(major, sub)), 256), 1, 16)
