"""Session factory and the few session-level helpers every operator shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "tidemark", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with UTC, AQE and skew handling on. On a cluster the submitter's settings win."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: the one the cluster names in spark.checkpoint.dir.

    Where none is named, a local master (tests) gets a folder of its own, removed at the end; on a cluster, whose executors
    share no local folder, that is an error.
    """
    context = spark.sparkContext
    directory = context._jsc.sc().getCheckpointDir()
    if directory.isDefined():
        return directory.get()
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written copy."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same as a compressed table: for what is large and read more than once.

    The table lies below the application's checkpoint folder and is removed when the Python process ends.
    """
    spark = df.sparkSession
    folder = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    atexit.register(_removed, spark, folder)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _removed(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended: only a local folder can still be removed
        shutil.rmtree(folder.removeprefix("file:"), ignore_errors=True)


def broadcast_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast of ``df`` only if a bounded count proves it has at most ``max_rows`` rows; else leave it to the optimiser."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` written once, and broadcast where it is joined if it has proved to have at most ``max_rows`` rows."""
    return broadcast_bounded(cut_lineage(df), max_rows)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, wherever they run and whatever their path is."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidemark-ship-")) / "tidemark_package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, Path(root.name) / path.relative_to(root))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)
