"""Memory of Python workers, which live on after a task and stay idle beside those that run the next one."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

_BATCH, _USUAL, _SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of 4 MB, unless the session asks for a size of its own.

    Set-up of the session, made by each operator that needs it and left so: plans
    read it when they run, which is after an operator has returned.
    """
    said = spark.conf.get(_BATCH, None)
    if said is not None and said.rstrip("b") in (str(_USUAL), "64m"):
        spark.conf.set(_BATCH, f"{_SMALL}b")


def few_rows(spark: SparkSession) -> None:
    """Hand at most 1,000 texts to Python at once, unless the session asks for a number of its own; set-up as in :func:`small_batches`."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def give_back() -> None:
    """Return freed memory to the system; allocators keep much of a task's peak otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, which maps a task's batches, and :func:`give_back` once it has ended and its variables are gone."""

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return tidied
