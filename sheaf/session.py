"""Session helpers: building a session, shipping the package, cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def build(app: str = "sheaf", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession | None = None) -> None:
    """Send this package to the Python workers of the session (the active one by default), once per application."""
    spark = spark or SparkSession.active()
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.suffix == ".zip" or not root.is_dir():
        return
    to = Path(tempfile.mkdtemp(prefix="sheaf-")) / "sheaf_package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(str(to))
    _SHIPPED.add(app)


#: Bounds of an Arrow batch. Texts run to megabytes, so the default of 10,000 rows of any size is too much for a Python worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def python_ready(spark: SparkSession | None = None) -> None:
    """Before a plan with Python tasks: ship the package, bound the Arrow batches of the session (by the same numbers for all operators)."""
    spark = spark or SparkSession.active()
    ship(spark)
    for k, v in BATCH.items():
        spark.conf.set(k, v)


#: A Parquet writer looks at every row at how much it holds. It looks after 100 rows first, and later as its rows so far suggest: too late where rows of megabytes follow short ones.
LONG_ROWS = {f"parquet.{of}.size.row.check.{bound}": "1" for of in ("page", "block") for bound in ("min", "max")}


def long_rows_ready(spark: SparkSession) -> None:
    """Before a plan whose rows run to megabytes: bound what the session's Parquet writers hold of them."""
    for k, v in LONG_ROWS.items():
        spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only where it is unset and the session is local, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if at:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(at)
        return at
    if context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(f"file://{os.path.abspath(tempfile.mkdtemp(prefix='sheaf-ckpt-'))}")
    return context.getCheckpointDir()


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt over all tasks by key, whose number adaptive execution leaves alone: for work that costs much more than its input's size tells."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint that survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: for tables that several jobs read."""
    at = folder(df.sparkSession)
    df.write.parquet(at)
    back = df.sparkSession.read.schema(df.schema).parquet(at)
    back._written_at = at
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` made, once everything read from them is itself written."""
    for t in tables:
        if at := getattr(t, "_written_at", None):
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
            t._written_at = None
