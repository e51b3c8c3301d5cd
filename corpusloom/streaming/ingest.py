"""Incremental ingestion of Parquet drops: clean, keep usable texts, drop repeats, append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import clean_text, normalize_whitespace, remove_unprintable


def clean_stream(stream: DataFrame, text: str = "text", min_chars: int = 10) -> DataFrame:
    """Works on streams and tables alike: one row per distinct cleaned text, by its digest."""
    cleaned = stream.withColumn(text, clean_text(remove_unprintable(normalize_whitespace(F.col(text))), min_chars))
    keyed = cleaned.where(F.col(text).isNotNull()).withColumn("text_digest", F.sha2(text, 256))
    return keyed.dropDuplicates(["text_digest"])


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, text: str = "text", min_chars: int = 10, files_per_batch: int = 100) -> StreamingQuery:
    """Read what is new in ``source`` and append it to ``target``; the state of digests lives in the checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return (
        clean_stream(stream, text, min_chars)
        .writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
