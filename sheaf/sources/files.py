"""Readers and writers of the zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id: the stem without "Copy of ", file_name, content) of every *.md below a folder (A1). Empty files give no row, as Spark leaves them out."""
    x = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    name = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1), "%20", " ")
    return x.select(F.regexp_replace(F.regexp_replace(name, r"\.md$", ""), "Copy of ", "").alias("doc_id"), name.alias("file_name"), F.col("value").alias("content"))


def questions(spark: SparkSession, path: str, needed: tuple[str, ...] = ("question", "ground_truth")) -> DataFrame:
    """A CSV of questions; a byte-order mark is dropped and the needed columns must be there (A3)."""
    x = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    x = x.toDF(*[c.lstrip("﻿").strip() for c in x.columns])
    if gone := [c for c in needed if c not in x.columns]:
        raise ValueError(f"columns are missing: {', '.join(gone)}")
    return x


def append(df: DataFrame, path: str) -> None:
    """Bulk append; no rows is no failure (A5)."""
    df.write.mode("append").parquet(path)


def json_per_document(docs: DataFrame, parts: DataFrame, key: str = "file") -> DataFrame:
    """(key, components) with an empty list where a document has none."""
    g = parts.groupBy(key).agg(F.collect_list(F.struct(*[c for c in parts.columns if c != key])).alias("components"))
    return docs.select(key).join(g, key, "left").select(key, F.coalesce("components", F.array()).alias("components"))


def csv(df: DataFrame, path: str) -> None:
    """CSV export, arrays as JSON."""
    cols = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(cols).write.mode("overwrite").csv(path, header=True, escape='"')


def zone(spark: SparkSession, name: str, schema: str, path: str, by: str | None = None) -> DataFrame:
    """The table of a zone, created at path if it isn't there yet (A4)."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet{f' PARTITIONED BY ({by})' if by else ''} LOCATION '{path}'")
    return spark.table(name)
