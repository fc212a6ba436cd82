"""Sinks (S7, S9): run summaries and plans."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import fixed_values as fv
from shelfmark import skew
from shelfmark.functions import paths as P
from shelfmark.operators import report


def run_summary(results: DataFrame, keys: Sequence[str] = ("entry",),
                limit: int = fv.SUMMARY_MAX_FAILURES, file: str = "src",
                detail: str = "detail") -> DataFrame:
    """One summary per run entry with its first failures, as people read it.

    The list is a view of ``limit`` lines with a flag, for an entry may have more
    failures than a document should hold; ``run_failures`` has all of them.
    """
    keys = list(keys)
    totals = report.status_counts(results, keys)
    failed = results.filter(report.is_failure()).select(
        *keys, F.struct(F.col(file).alias("file"), F.col(detail).alias("reason")).alias("failure"))
    shown = skew.sampled_list(failed, keys, "failure", limit, "failures")
    return totals.join(shown, keys, "left").select(
        *keys, (F.col("ok") + F.col("copied")).alias("ok"),
        F.col("overwrite").alias("overwritten"), "skipped", F.col("error").alias("errors"),
        F.coalesce("failures", F.array().cast("array<struct<file:string,reason:string>>"))
        .alias("failures"),
        (F.col("error") > limit).alias("failures_truncated"))


def run_failures(results: DataFrame, keys: Sequence[str] = ("entry",), file: str = "src",
                 detail: str = "detail") -> DataFrame:
    """Every failure of every entry, a row each."""
    return results.filter(report.is_failure()).select(
        *keys, F.col(file).alias("file"), F.col(detail).alias("reason"))


def write_summary(df: DataFrame, path: str, failures: DataFrame | None = None) -> None:
    """Summaries as JSON lines, all failures as a table beside them."""
    df.write.mode("overwrite").json(path)
    if failures is not None:
        failures.write.mode("overwrite").parquet(f"{path.rstrip('/')}-failures")


def write_plan(df: DataFrame, path: str, dest: str = "dest", shards: int = 64) -> None:
    """A plan in Parquet, laid out by destination folder.

    A library has far more folders than a table should have directories, so
    folders are hashed to a fixed number of shards and files sorted by folder:
    a filter on ``dest_dir`` skips row groups, one on ``dest_shard`` files.
    The rebalance hint splits a shard one hot folder fills and merges small
    ones.
    """
    (df.withColumn("dest_dir", P.parent(dest))
        .withColumn("dest_shard", F.pmod(F.xxhash64("dest_dir"), F.lit(shards)).cast("int"))
        .hint("rebalance", "dest_shard")
        .sortWithinPartitions("dest_shard", "dest_dir")
        .write.mode("overwrite").partitionBy("dest_shard").parquet(path))


def write_files(df: DataFrame, folder: str, name: str, text: str) -> int:
    """Each row's text and a line end as a file of its own, ``name`` below a folder of a mounted file system; how many.

    Spark's text writer starts a process or two for every file and folder it
    makes there.  A file gets its name when it is whole, so a task that runs
    again writes the same files.
    """
    root = unquote(urlsplit(folder).path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            for below, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = os.path.join(root, below)
                parent = os.path.dirname(path)
                if parent not in made:
                    os.makedirs(parent, exist_ok=True)
                    made.add(parent)
                partial = os.path.join(parent, f".{uuid.uuid4().hex}")
                with open(partial, "wb") as file:
                    file.write((value or "").encode() + b"\n")
                os.replace(partial, path)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    written = df.select(F.col(name).alias("name"), F.col(text).alias("text")).mapInArrow(write, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
