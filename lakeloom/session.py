"""Session settings and table loading shared by every query."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(master: str | None = None, app: str = "lakeloom", **conf: str) -> SparkSession:
    """A session with UTC time, ANSI arithmetic and adaptive execution.

    On a cluster leave ``master`` unset: spark-submit supplies it, and shuffle
    partitions are coalesced at run time by adaptive execution.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; nothing is listed or opened outside Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views over the tables, for SQL text."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2,000 rows and 16 MB, for jobs on whole texts; settings the user made stay.

    An application calls this, no operator does. With Spark's defaults the operators work
    too, in more memory.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def local_cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))


def ship(spark: SparkSession) -> None:
    """Put this package on the Python workers' path, once per session, where it is not installed on them."""
    sc = spark.sparkContext
    if getattr(sc, "_lakeloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="lakeloom-")) / "lakeloom.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(to))
    sc._lakeloom_shipped = True
