"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import zones


def markdown_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files as they arrive: (doc_id: the file's stem, content)."""
    x = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(folder)
    stem = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.md$", 1), "(Copy%20of%20|Copy of )", "")
    return x.select(stem.alias("doc_id"), F.col("value").alias("content"))


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream of its files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, since a stream's path may not be a file


def append_to(chunks: DataFrame, out: str, checkpoint: str):
    """Chunks of a stream of documents appended to a zone (S1); stateless, as each document is whole."""
    return chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(docs: DataFrame, at: str, key: str | list[str] = "file_uuid", delay: str = "1 day") -> DataFrame:
    """Repeats of a key within the watermark suppressed."""
    return docs.withWatermark(at, delay).dropDuplicatesWithinWatermark([key] if isinstance(key, str) else key)


def merged(rows: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch given to a merge, such as that of graph nodes or of postings (S3)."""
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(rows: DataFrame, at: str, keys: list[str], add: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, buckets: int = zones.BUCKETS) -> None:
    """A zone that each micro-batch of the stream is merged into, to the stream's end: only the buckets a batch touches are rewritten (S3).

    A batch has its number as the zone's version, so that one which is run again changes nothing. A stream without new rows leaves the zone as it is.
    """
    merged(rows, lambda batch, i: zones.merge(batch, at, keys, add, i + 1, buckets), checkpoint).awaitTermination()
