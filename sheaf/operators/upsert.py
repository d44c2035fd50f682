"""Loads and merges of keyed tables: every function takes and returns DataFrames, without touching storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sheaf.session import written


def numbered(df: DataFrame, *order: str, out: str = "n") -> DataFrame:
    """df with dense numbers from 0 in an order, without a task that sees all rows: rows are sorted in range partitions, numbered within
    each, and moved up by the sizes of the partitions before."""
    x = written(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))
    sizes = x.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return x.join(F.broadcast(before), "_part").withColumn(out, (F.col("_before") + inside - 1).cast("bigint")).drop("_part", "_before")


def batches(chunks: DataFrame, *order: str, size: int = 100, batch_id: str | None = None) -> DataFrame:
    """Chunks with the id of the batch they are loaded in: the given one, or batch_{n} by hundreds."""
    if batch_id is not None:
        return chunks.withColumn("batch_id", F.lit(batch_id))
    return numbered(chunks, *order).withColumn("batch_id", F.concat(F.lit("batch_"), (F.floor(F.col("n") / size) + 1).cast("string"))).drop("n")


def fan_out(chunks: DataFrame, uuid: str = "file_uuid", idx: str = "idx", collections: str = "collections") -> DataFrame:
    """A row for each chunk and collection, collection names in lower case; the id repeats where a chunk is indexed again."""
    each = chunks.withColumn("collection", F.explode(collections)).withColumn("collection", F.lower("collection"))
    return each.withColumn("doc_key", F.concat_ws("_", F.col(uuid).cast("string"), F.col(idx).cast("string"))).drop(collections)


def latest(old: DataFrame, new: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Upsert: for each key the row with the largest seq, new rows winning ties."""
    x = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return x.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(seq, "_new")).alias("r")).select(*keys, "r.*")


def first_created(old: DataFrame, new: DataFrame, key: str, created: str = "created_at", now: Column | None = None) -> DataFrame:
    """Upsert that keeps the time of the first write and replaces the rest."""
    o, n = old.alias("o"), new.alias("n")
    cols = [c for c in old.columns if c not in (key, created)]
    pick = [F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in cols]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *pick, F.coalesce(F.col(f"o.{created}"), now if now is not None else F.col(f"n.{created}")).alias(created))


def new_synonyms(found: DataFrame, known: DataFrame, key: str = "ingredient_id") -> DataFrame:
    """Trimmed synonyms that aren't blank, once for each ingredient, without those already stored (A10)."""
    s = found.select(key, F.explode("synonym").alias("s")).select(key, F.trim("s").alias("synonym")).where("synonym <> ''").dropDuplicates()
    return s.join(known, [key, "synonym"], "left_anti")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't deleted; with the parent's key, the cascade to its children."""
    return rows.join(gone.select(key), key, "left_anti")


def replace_prefix(rows: DataFrame, new: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose key hasn't the prefix, and the new ones."""
    return rows.where(~F.col(key).startswith(prefix)).unionByName(new)
