"""Manifest files (S3, and the writing half of S4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import skew
from shelfmark.functions import paths as P
from shelfmark.operators.manifest import BASE_COLUMNS, OPTION_COLUMNS

_LOOKS_LIKE_HEADER = {"destination", "mode", "direction"}
#: A path from a root, a drive, a share or a store.
_ABSOLUTE = r"^(?:/|\\\\|[A-Za-z]:[\\/]|[A-Za-z][A-Za-z0-9+.-]*://)"


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S3: (rows, errors) of one manifest CSV.

    ``row_no`` counts the lines of all files in order, blank ones left out.  BOM
    tolerated; rows with an empty or commented Source are comments; a
    file's first row is a header only when it names Destination, Mode or Direction; an
    unknown column, a ``..`` in a path, a fractional mode or a quoted cell that is
    still open at the line's end is an error row and refuses the file.  Relative
    paths are those of the file's own folder.
    """
    raw = (
        spark.read.text(path)
        .select(F.regexp_replace("value", "^﻿", "").alias("value"), F.col("_metadata.file_path").alias("_file"),
                F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
        .filter(F.trim("value") != ""))
    lines = skew.global_rank(raw, ["_file", "_block", "_id"], "_at")
    # A manifest of several files has a header in each; one line a file.
    cells_of = F.transform(F.split("head", ","), lambda c: F.lower(F.trim(F.regexp_replace(c, '"', ""))))
    heads = lines.groupBy("_file").agg(F.min_by("value", "_at").alias("head"), F.min("_at").alias("_first")).withColumn(
        "is_header", F.arrays_overlap(cells_of, F.array(*[F.lit(c) for c in sorted(_LOOKS_LIKE_HEADER)])))
    named_by = [r["head"] for r in heads.filter("is_header").groupBy("head").agg(F.min("_first").alias("at")).orderBy("at").limit(2).collect()]
    names = [c.strip().strip('"') for c in named_by[0].split(",")] if named_by else list(BASE_COLUMNS)
    known = {c.lower(): c for c in BASE_COLUMNS + OPTION_COLUMNS}
    unknown = [c for c in names if c.lower() not in known]
    schema = ", ".join(f"_c{i} string" for i in range(len(names)))
    bodies = lines.join(heads.select("_file", "_first", "is_header"), "_file").filter(
        ~F.col("is_header") | (F.col("_at") > F.col("_first")))
    parsed = bodies.withColumn(
        "_row", F.from_csv("value", schema, {"mode": "PERMISSIVE"}))
    cells = [
        F.trim(F.coalesce(F.col(f"_row._c{i}"), F.lit(""))).alias(known[c.lower()])
        for i, c in enumerate(names) if c.lower() in known]
    present = F.create_map(*[
        x for c in OPTION_COLUMNS
        for x in (F.lit(c), F.lit(c.lower() in {n.lower() for n in names}))])
    own_folder = P.parent(P.without_scheme("_file"))  # like the paths of an asset listing
    rows = parsed.select(F.col("_at").alias("row_no"), *cells, present.alias("present"), own_folder.alias("_folder"))
    for column in BASE_COLUMNS + OPTION_COLUMNS:
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit("").cast("string"))
    rows = rows.filter((F.col("Source") != "") & ~F.col("Source").startswith("#"))
    for column in ("Source", "Destination"):
        relative = (F.col(column) != "") & ~F.col(column).rlike(_ABSOLUTE)
        rows = rows.withColumn(column, F.when(relative, P.join_path(F.regexp_replace("_folder", "/$", ""), column)).otherwise(F.col(column)))
    rows = rows.drop("_folder")
    number = F.nullif(F.col("Mode"), F.lit("")).try_cast("double")
    bad_mode = (F.col("Mode") != "") & F.coalesce(
        number.isNull() | (number != F.floor(number)) | ~number.between(0, 8), F.lit(True))
    dotted = (
        F.col("Source").rlike(r"(^|[/\\])\.\.([/\\]|$)")
        | F.col("Destination").rlike(r"(^|[/\\])\.\.([/\\]|$)"))
    errors = rows.select("row_no", F.explode(F.array_compact(F.array(
        F.when(dotted, F.struct(F.lit("Source").alias("column"),
                                F.lit("parent folder in path").alias("message"))),
        F.when(bad_mode, F.struct(F.lit("Mode").alias("column"),
                                  F.lit("mode out of range or fractional").alias("message")))))).alias("e")
    ).select("row_no", "e.column", "e.message")
    # A cell may hold no line break: its row would be read as two, each with half of a path.
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    errors = errors.unionByName(parsed.filter(quotes % 2 == 1).select(
        F.col("_at").alias("row_no"), F.lit("Source").alias("column"), F.lit("line break inside quotes").alias("message")))
    if len(named_by) > 1:
        unknown.append("files with different headers")
    if unknown:
        named = spark.createDataFrame(
            [(0, c, "unknown column") for c in unknown],
            "row_no bigint, column string, message string")
        errors = errors.unionByName(named)
    return rows, errors


def write_manifest(rows: DataFrame, path: str) -> None:
    """A generated manifest, optional columns present and empty."""
    out = rows
    for column in OPTION_COLUMNS:
        if column not in out.columns:
            out = out.withColumn(column, F.lit(""))
    (out.select(*BASE_COLUMNS, *OPTION_COLUMNS).orderBy("Source")
        .write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path))
