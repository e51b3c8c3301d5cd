"""Model and network calls behind small interfaces, each with a deterministic stand-in.

A provider is built once per Python worker by its ``load`` function, which is
what is shipped, and called with lists. Real models are plugged in by passing
another ``load``; nothing here needs one.
"""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.workers import tidy

Load = Callable[[], Callable[[list], list]]


def batched(load: Load, returns: str, batch: int = 64) -> Callable[[Column], Column]:
    """A column function that calls a provider with lists of at most ``batch`` values; the model is loaded once a task."""

    @F.pandas_udf(returns)
    def call(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for values in parts:
            listed = list(values)
            yield pd.Series([v for at in range(0, len(listed), batch) for v in model(listed[at : at + batch])], dtype=object)

    return call


def token_lengths(load: Load, batch: int = 64) -> Callable[[Column], Column]:
    """texts -> how many tokens a model's tokenizer makes of them; ``load`` gives a function from texts to lists of tokens."""

    def lengths() -> Callable[[list], list]:
        tokenize = load()
        return lambda texts: [len(tokens) for tokens in tokenize([t or "" for t in texts])]

    return batched(lengths, "long", batch)


def white_space_tokens() -> Callable[[list], list]:
    """Stand-in tokenizer."""
    return lambda texts: [(t or "").split() for t in texts]


def vocabulary_tokens(path: str) -> Load:
    """The tokenizer of a vocabulary file, with its special tokens."""

    def load() -> Callable[[list], list]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in model.encode_batch([t or "" for t in texts])]

    return load


def last_token_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The state (texts, dim) of each text's last real token, of states (texts, tokens, dim) and mask (texts, tokens).

    If every text's last place is a real token, the padding is on the left.
    """
    if mask[:, -1].all():
        return states[:, -1]
    return states[np.arange(len(states)), mask.sum(axis=1) - 1]


def pooled(load: Callable[[], Callable[[list], tuple[np.ndarray, np.ndarray]]]) -> Load:
    """An embedder of a model that gives (hidden states, attention mask) for texts: the last token's state stands for a text."""

    def start() -> Callable[[list], list]:
        model = load()
        return lambda texts: last_token_pool(*model(texts)).tolist()

    return start


def embedder(load: Load, batch: int = 64, tokenizer: Load | None = None, most_tokens: int = 4096) -> Callable[[Column], Column]:
    """texts -> L2-normalised vectors.

    With the model's ``tokenizer``, a text of more than ``most_tokens`` tokens is an error, never cut.
    """

    def normalised() -> Callable[[list], list]:
        model, tokenize = load(), tokenizer() if tokenizer is not None else None

        def run(texts: list) -> list:
            if tokenize is not None and (longest := max(map(len, tokenize([t or "" for t in texts])), default=0)) > most_tokens:
                raise ValueError(f"a text has {longest} tokens, more than {most_tokens}: split it first")
            out = []
            for v in model(texts):
                size = math.sqrt(sum(x * x for x in v)) or 1.0
                out.append([float(x) / size for x in v])
            return out

        return run

    return batched(normalised, "array<float>", batch)


def hashed_bag_of_words(dim: int = 64) -> Load:
    """Stand-in embedder: signed word hashes."""

    def load() -> Callable[[list], list]:
        def run(texts: list) -> list:
            out = []
            for t in texts:
                v = [0.0] * dim
                for w in (t or "").lower().split():
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    v[h % dim] += 1.0 if h >> 63 else -1.0
                out.append(v)
            return out

        return run

    return load


def pair_text(query: str | None, document: str | None) -> str:
    """What a reranker reads of a pair; its tokens are what counts against the limit."""
    return f"<Query>: {query or ''}\n<Document>: {document or ''}"


def reranker(
    load: Callable[[], Callable[[list[tuple[str, str]]], list[tuple[float, float]]]], most_tokens: int = 8192, batch: int = 16,
    tokenizer: Load = white_space_tokens, render: Callable[[str | None, str | None], str] = pair_text,
):
    """(query, document) columns -> the probability of yes, from the model's (no, yes) logits.

    ``load`` gives a function from pairs to logits; pairs whose rendered text has
    more than ``most_tokens`` tokens of ``tokenizer`` are an error, never cut.
    """

    @F.pandas_udf("double")
    def call(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model, tokenize = load(), tokenizer()
        for queries, docs in parts:
            pairs = list(zip(queries, docs))
            if (longest := max(map(len, tokenize([render(q, d) for q, d in pairs])), default=0)) > most_tokens:
                raise ValueError(f"a pair has {longest} tokens, more than {most_tokens}")
            logits = [x for at in range(0, len(pairs), batch) for x in model(pairs[at : at + batch])]
            yield pd.Series([1.0 / (1.0 + math.exp(no - yes)) for no, yes in logits])

    return call


def word_overlap_logits() -> Callable[[list[tuple[str, str]]], list[tuple[float, float]]]:
    """Stand-in reranker: the share of the query's words that the document has."""

    def run(pairs: list[tuple[str, str]]) -> list[tuple[float, float]]:
        out = []
        for q, d in pairs:
            a, b = set((q or "").lower().split()), set((d or "").lower().split())
            out.append((0.0, 4.0 * len(a & b) / max(1, len(a)) - 2.0))
        return out

    return run


def generator(load: Load, parse: Callable[[str], Any] | None = None, tries: int = 3, wait: Callable[[int], float] = lambda n: min(2.0 * n, 10.0)):
    """prompts -> struct(response, error): up to ``tries`` calls; a response that ``parse`` rejects counts as failed.

    Failures don't stop the task; they are rows with an error, and the sink
    decides (see :func:`corpusloom.operators.generation.require_complete`).
    """

    @F.pandas_udf("response string, error string")
    def call(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for prompts in parts:
            rows = []
            for prompt in prompts:
                said, error = None, None
                for n in range(1, tries + 1):
                    try:
                        said = model([prompt])[0]
                        if not said or not said.strip():
                            raise ValueError("the response is empty")
                        if parse is not None:
                            parse(said)
                        error = None
                        break
                    except Exception as failure:  # noqa: BLE001  a provider may raise anything
                        said, error = None, f"{type(failure).__name__}: {failure}"
                        if n < tries:
                            time.sleep(wait(n))
                rows.append((said, error))
            yield pd.DataFrame(rows, columns=["response", "error"])

    return call


def echo_teacher() -> Callable[[list], list]:
    """Stand-in teacher: a valid triple about the digest of its prompt."""

    def run(prompts: list) -> list:
        name = [hashlib.sha256((p or "").encode()).hexdigest()[:12] for p in prompts]
        return [f'```json\n{{"instruction": "Explain {n}", "input": "{n}", "output": "It is {n}."}}\n```' for n in name]

    return run


def digest_student() -> Callable[[list], list]:
    """Stand-in model for exams: a letter that follows from the digest of the prompt, and a reason."""

    def run(prompts: list) -> list:
        letter = ["ABCD"[int(hashlib.sha256((p or "").encode()).hexdigest()[0], 16) % 4] for p in prompts]
        return [f"答案：{x}\n\n解析：it is {x}. Answer: {x}" for x in letter]

    return run


def chat_client(base_url: str, model: str, key_variable: str, timeout: float = 120.0, **options: Any) -> Load:
    """A client of a chat-completion endpoint; cut-off and empty responses are errors. The key is read on the worker."""

    def load() -> Callable[[list], list]:
        import json
        import os
        import urllib.request

        def one(prompt: str) -> str:
            body = json.dumps({"model": model, "messages": [{"role": "user", "content": prompt}], **options}).encode()
            head = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(key_variable, '')}"}
            with urllib.request.urlopen(urllib.request.Request(f"{base_url}/chat/completions", body, head), timeout=timeout) as answer:
                choice = json.load(answer)["choices"][0]
            if choice.get("finish_reason") == "length":
                raise ValueError("the response was cut off")
            if not (choice["message"].get("content") or "").strip():
                raise ValueError("the response is empty")
            return choice["message"]["content"]

        return lambda prompts: [one(p) for p in prompts]

    return load


def language_predictor(load: Load) -> Callable[[Column], Column]:
    """array<string> -> array<struct(label, probability)>, the shape that keep_language takes.

    Counts as not deterministic, else a plan that filters the result predicts twice, in two workers a task.
    """

    @F.pandas_udf("array<struct<label:string,probability:double>>")
    @tidy
    def call(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for rows in parts:
            flat = [p for row in rows for p in row]
            found = iter(model(flat))
            yield pd.Series([[dict(zip(("label", "probability"), next(found))) for _ in row] for row in rows], dtype=object)

    return call.asNondeterministic()


def stop_word_language() -> Callable[[list], list]:
    """Stand-in language model: English if a fifth of the words are English function words."""
    common = {"the", "of", "and", "to", "in", "that", "is", "for", "it", "on", "with", "as", "was", "this", "are", "by", "at", "from"}

    def run(texts: list) -> list:
        out = []
        for t in texts:
            ws = t.lower().split()
            share = sum(w in common for w in ws) / max(1, len(ws))
            out.append(("en", min(1.0, 0.5 + 2.5 * share)) if share >= 0.06 else ("other", 1.0 - share))
        return out

    return run
