"""Session factory and the helpers every operator shares: loading, shared storage, lineage cuts."""

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

#: rows up to which a table may be broadcast whatever Catalyst estimates
SMALL_ROWS = 200_000


def build_session(app: str = "terazi", cores: int | str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A local session with Arrow and adaptive execution on; on a cluster the launcher's own settings are used instead."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, unless they find it where the driver did.

    Local workers find it by PYTHONPATH or the working directory; elsewhere it is sent as a zip by Spark's file server.
    """
    context = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    near = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if context.applicationId == getattr(ship, "done", None):
        return
    ship.done = context.applicationId
    if context.master.startswith("local") and any(p and Path(p).resolve() == root for p in near):
        return
    packed = Path(tempfile.mkdtemp(prefix="terazi-")) / "terazi.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted((root / "terazi").rglob("*.py")):
            out.write(f, f.relative_to(root))
    context.addPyFile(str(packed))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory (a single file or a folder of part files)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from spark.checkpoint.dir. On a local master, as in tests, a temporary one is made where that
    is unset and removed at exit; on a cluster its absence is an error, since no machine's own folder would do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    if not hasattr(shared_dir, "local"):
        folder = tempfile.mkdtemp(prefix="terazi-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        shared_dir.local = "file://" + folder
    return shared_dir.local


def scratch_root(spark: SparkSession) -> str:
    """The application's own folder below the shared one."""
    return f"{shared_dir(spark)}/terazi/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the application's folder."""
    return f"{scratch_root(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage with a table written to the shared folder; it survives the loss of any executor.

    Results are lazy and may be read until the application ends; then the tables it wrote are deleted.
    """
    path = scratch_path(df.sparkSession, what)
    _delete_at_exit(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete_at_exit(spark: SparkSession) -> None:
    """Delete the application's scratch tables when its context is stopped or the driver exits, once per application."""
    context = spark.sparkContext
    if context.applicationId != getattr(_delete_at_exit, "done", None):
        _delete_at_exit.done = context.applicationId
        folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def broadcast_small(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """df, marked for broadcast if by Catalyst's estimate, or else by its number of rows, it is proven small; else as it is."""
    if estimated_bytes(df) <= most:
        return F.broadcast(df)
    rows = df.limit(SMALL_ROWS + 1).count()
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer partitions than there are, as small files do; else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, used to decide whether a side may be broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def tokenizer_dir() -> str:
    """Where the public vocabulary files lie; overridden by TERAZI_TOKENIZERS."""
    return os.environ.get("TERAZI_TOKENIZERS", "/opt/tokenizers")
