"""Session defaults and the shared folder for cutting long lineages."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on. A cluster's own values win over all but the time zone.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call sites in error messages cost several calls into the JVM per column function.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = 8, memory: str = "12g", name: str = "voxframe", shared: str | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own. ``shared``: folder for intermediate tables."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can read and write, as the session names it in ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Later stages then neither recompute its history, also not after a lost executor, nor drag its plan
    along. The folder belongs to the run and can be removed with it.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan with fewer tasks than cores out to all of them; larger scans stay as they are.

    For costly expressions over small files: a file of one row group is otherwise read by one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, for functions that run in Python there."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{root.name}", "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
