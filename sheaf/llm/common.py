"""What the operators here share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import BATCH, python_ready  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, k: int) -> Column:
    """crc32(doc_id as text) mod k."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % F.lit(k)


def chance(*by: Column | str) -> Column:
    """A number from 0 to 1 that follows from the values of by: even over different values, the same at every run."""
    return F.pmod(F.xxhash64(*[F.col(b) if isinstance(b, str) else b for b in by], F.lit("chance")), F.lit(1 << 40)) / float(1 << 40)


def sampled(df: DataFrame, n: int, *by: str) -> DataFrame:
    """About n rows of df (all, if fewer), the same at every run: those whose `chance` is below n over the number of rows.

    It is a filter, so no task sees more than its own rows. Rows that agree in `by` are drawn together.
    """
    total = df.count()
    return df if total <= n else df.where(chance(*by) < n / total)


def unused(name: str, df: DataFrame) -> str:
    """name, lengthened until df has no such column: a column of our own beside those of any table."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
