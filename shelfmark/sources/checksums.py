"""Checksum journals (S5, S6): ``<md5>  <name>`` lines, the last one counts."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import paths as P


_APPEND = r"/append-(\d+)"


def parse_journal(lines: DataFrame, text: str = "value") -> DataFrame:
    """Journal lines to (md5, name); comments, BOM and ``*name`` tolerated."""
    line = F.trim(F.regexp_replace(F.col(text), "^﻿", ""))
    pattern = r"^(\S+)\s+(.*)$"
    name = F.trim(F.regexp_replace(F.regexp_extract(line, pattern, 2), r"^\*+", ""))
    return (
        lines.withColumn("md5", F.regexp_extract(line, pattern, 1)).withColumn("name", name)
        .filter((line != "") & ~line.startswith("#") & (F.col("name") != "")))


def last_lines(journal: DataFrame) -> DataFrame:
    """The last line per (folder, name); combines on the map side."""
    return journal.groupBy("folder", "name").agg(
        F.max_by("md5", "line_no").alias("md5"), F.max("line_no").alias("line_no"))


def read_checksums(spark: SparkSession, glob: str) -> DataFrame:
    """Current journal lines of every folder the pattern names.

    Later appends win: by the number in their folder's name, or by the file's
    time where another tool wrote it.  Inside a file the order is the line's
    position: the block a row came from, then the row's place in it.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(glob).select(
        "value", P.without_scheme("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.unix_micros("_metadata.file_modification_time").alias("written"))
    run = F.regexp_extract("file", _APPEND, 1).try_cast("long")
    placed = raw.withColumn("line_no", F.struct(
        F.coalesce(run, F.col("written")).alias("run"), "file", "block", F.monotonically_increasing_id().alias("id")))
    rows = parse_journal(placed).withColumn("folder", F.regexp_replace(P.parent("file"), _APPEND + "$", ""))
    return rows.groupBy("folder", "name").agg(F.max_by("md5", "line_no").alias("md5"))


def write_checksums(df: DataFrame, path: str, order: str = "line_no") -> None:
    """Append journal lines, safe beside other writers.

    An append is a folder of its own, named by its time in microseconds; it
    holds one line a name, the last by ``order``, so that the order of its
    part files never matters.
    """
    latest = df.groupBy("name").agg(F.max_by("md5", order).alias("md5"))
    latest.select(F.concat_ws("  ", "md5", "name").alias("value")).write.text(f"{path}/append-{time.time_ns() // 1000}")
