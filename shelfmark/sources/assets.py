"""Asset listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import paths as P


def scan_assets(spark: SparkSession, root: str, exts: Sequence[str] = (), recursive: bool = True,
                with_content: bool = False) -> DataFrame:
    """Files below ``root``, extension matched in any letter case, once each.

    Without ``with_content`` the bytes are never read: the scan's schema is
    path, time and length only.  ``store`` keeps what a path no longer shows:
    the scheme and bucket or host it came from.
    """
    raw = spark.read.format("binaryFile").option(
        "recursiveFileLookup", str(recursive).lower()).load(root)
    columns = [
        P.without_scheme("path").alias("path"), P.store_of("path").alias("store"),
        F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    if with_content:
        columns.append(F.col("content"))
    files = raw.select(*columns)
    if exts:
        wanted = [e.lower() if e.startswith(".") else "." + e.lower() for e in exts]
        files = files.filter(P.suffix_of(P.file_name("path")).isin(*wanted))
    return files.dropDuplicates(["store", "path"])
