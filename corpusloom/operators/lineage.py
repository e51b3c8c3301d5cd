"""Cutting lineage in the folder that the cluster shares, and deleting what was written there."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Used only with a local master whose session names no folder (one machine, tests).
LOCAL_SHARED = "file:///tmp/checkpoints/corpusloom"

#: Tables of this process that nobody has deleted yet.
_tables: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the context's checkpoint folder, else spark.checkpoint.dir.

    Without either, a local master gets a folder of this machine; on a cluster
    that is an error, since executors wouldn't see each other's files.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        named = LOCAL_SHARED
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def materialise(df: DataFrame, name: str, rows: int | None = None, least: int = 12) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    A lost executor costs only the tasks that read the written files again.
    Returns the reread frame and its path (see :func:`discard`). ``rows``, where
    about that many are known, keeps narrow tables from being written as many
    tiny files: one for 50,000 rows, but ``least`` of them. Tables that nobody
    discards go at the end of a :func:`scratch` block, or of the process.
    """
    if rows is not None:
        df = df.coalesce(max(least, -(-rows // 50_000)))
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted like a table."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and read back from a written table."""
    return materialise(df, "cut")[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables of :func:`materialise` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _tables.pop(path, None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[str], None]]:
    """Delete at the end all tables written inside but those whose paths the yielded function was called with.

    Operators return lazy frames that may read such tables: use their results,
    or write them, inside the block.
    """
    before, kept = set(_tables), set()
    try:
        yield kept.add
    finally:
        discard(spark, *[p for p in _tables if p not in before and p not in kept])


@atexit.register
def _release() -> None:
    for path, spark in list(_tables.items()):
        with contextlib.suppress(Exception):  # the JVM may be gone
            discard(spark, path)
