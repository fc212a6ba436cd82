"""Session helpers: recommended settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators are written for.  A value somebody set
# on purpose is left alone.
_RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split a hot join partition even where that costs a second exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Arrow batches are cut by bytes too, so wide rows never pile up.
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # A listing task takes many folders instead of one.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
    # Session windows pre-merge on the map side (hot keys).
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the recommended runtime settings to an existing session."""
    explicit = {k for k, _ in spark.sparkContext.getConf().getAll()}
    for key, value in _RECOMMENDED.items():
        if key not in explicit:
            spark.conf.set(key, value)
    return spark


# Folders of local sessions whose cluster names none, by application.
_local_folders: dict[str, str] = {}


def _half_of_memory() -> str:
    """Half of this machine's memory for the one JVM, 16 GB at most."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError):
        return "4g"
    return f"{max(1, min(16, total // (2 << 30)))}g"


def local_session(cores: str = "8", app: str = "shelfmark", **conf) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", _half_of_memory())
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local master may fall back to a fresh temporary folder: on a
    cluster a machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    # The setting can't be changed in a running session: the folder is remembered here.
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_folders[app]


def is_mounted(spark: SparkSession, path: str) -> bool:
    """Is this a path of a file system that every task can open, not of a store that only Spark reads?"""
    scheme, colon, _ = path.partition(":")
    return scheme == "file" if colon else spark.sparkContext.master.startswith("local")


def working_path(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder name under the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    A table rather than an RDD checkpoint: it is columnar, so the readers take
    only the columns and row groups they need, and it survives lost executors.
    """
    path = working_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
