"""Metadata records from JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RAW = (
    "SourceFile string, Relation string, Description string, Software string, "
    "HistoryParameters string, CreatorTool string, ImageWidth int, ImageHeight int, Error string")


def scalar_or_list(text) -> Column:
    """A field that is one value or a JSON list, as an array.

    A scalar is ONE value: it is never split at commas.
    """
    value = F.col(text) if isinstance(text, str) else text
    listed = F.from_json(value, "array<string>")
    return (
        F.when(value.isNull(), F.lit(None).cast("array<string>"))
        .when(F.substring(F.trim(value), 1, 1) == "[", F.coalesce(listed, F.array(value)))
        .otherwise(F.array(value)))


def normalise_meta(raw: DataFrame) -> DataFrame:
    """Typed records with list fields as arrays; an Error means unread."""
    return (
        raw.withColumn("Relation", scalar_or_list("Relation"))
        .withColumn("HistoryParameters", scalar_or_list("HistoryParameters"))
        .withColumn("read_ok", F.col("Error").isNull()))


def read_meta(spark: SparkSession, path: str, assets: DataFrame | None = None,
              multiline: bool = True) -> DataFrame:
    """Records, left-joined to the assets asked about.

    A file without an answer stays, with ``read_ok`` false: "could not be read"
    is never "carries nothing".
    """
    raw = spark.read.schema(_RAW).option("multiLine", multiline).json(path)
    records = normalise_meta(raw).filter(F.col("SourceFile").isNotNull())
    if assets is None:
        return records
    joined = assets.join(records, assets["path"] == records["SourceFile"], "left")
    return joined.withColumn("read_ok", F.coalesce("read_ok", F.lit(False)))
