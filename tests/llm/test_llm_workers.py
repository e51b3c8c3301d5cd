"""What operators leave in Python workers, which live on beside the others of their executor."""

import platform
import subprocess
import sys

import numpy as np
import pytest

from corpusloom.llm import bloom, near_dedup

_TASK = """
import re
from corpusloom.llm import workers
import pyarrow as pa

def held():
    with open("/proc/self/smaps_rollup") as file:
        return int(re.search(r"Private_Dirty: +(\\d+)", file.read())[1]) / 1024

def task(batches):
    for n in batches:
        words = [bytes(600 + i % 900) for i in range(n)]  # by malloc, which returns only what lies above the last block in use
        buffers = [pa.allocate_buffer(4096) for _ in range(n // 8)]
        last.append(bytes(700))
        yield len(words) + len(buffers)

last, before = [], held()
assert sum(workers.tidy(task)([100_000])) == 112_500
print(held() - before)
"""


@pytest.mark.skipif(platform.libc_ver()[0] != "glibc", reason="only glibc gives freed memory back on demand")
def test_a_task_gives_its_memory_back():
    said = subprocess.run([sys.executable, "-c", _TASK], capture_output=True, text=True, check=True, timeout=120)
    assert float(said.stdout) < 30  # MB, of about 150 that the task takes


def test_candidates_are_computed_once(spark):
    texts = spark.createDataFrame([(k, f"one two three four five {k}") for k in range(20)], "id long, text string")
    found = bloom.Bits(20)
    some = texts.where("id < 4").selectExpr("xxhash64(id) as h").toPandas()["h"].to_numpy(np.int64)
    found.add(some.view(np.uint64))
    stored = near_dedup._candidates(texts, found)
    assert stored.count() == 4
    assert stored._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1  # each one is a worker more a task
