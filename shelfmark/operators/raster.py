"""Rasters as row-block tiles: tiling, comparison, digests, colour."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import fixed_values as fv
from shelfmark.functions.scalars import curve_forward, curve_inverse, psnr


def tile_rasters(df: DataFrame, block_rows: int = fv.TILE_ROWS, payload: str = "payload",
                 keys=("image_id",)) -> DataFrame:
    """Row-block tiles of raw rasters, one row per block.

    ``payload`` is binary (big-endian above 8 bits) or an array of samples.  A
    payload whose length is not width x height x channels (x bytes) gives one
    reject row instead of tiles.
    """
    is_array = dict(df.dtypes)[payload].startswith("array")
    unit = F.lit(1) if is_array else F.when(F.col("depth") > 8, 2).otherwise(1)
    row = F.col("width") * F.col("channels") * unit
    length = F.size(payload) if is_array else F.length(payload)
    whole = F.coalesce((length == row * F.col("height")) & (F.col("height") > 0), F.lit(False))
    starts = F.when(whole, F.sequence(F.lit(0), F.col("height") - 1, F.lit(block_rows))).otherwise(
        F.array(F.lit(-1)))
    exploded = df.select("*", whole.alias("_whole"), row.alias("_row"), F.explode(starts).alias("y0"))
    rows = F.least(F.lit(block_rows), F.col("height") - F.col("y0"))
    first, count = F.col("y0") * F.col("_row") + 1, rows * F.col("_row")
    piece = F.slice(payload, first, count) if is_array else F.substring(F.col(payload), first, count)
    return exploded.select(
        *keys, F.when(F.col("_whole"), F.col("y0")).alias("y0"),
        F.when(F.col("_whole"), rows).alias("rows"), "width", "channels", "depth",
        F.when(F.col("_whole"), piece).alias("samples"),
        F.when(~F.col("_whole"), F.lit("length does not match the shape")).alias("reject"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _unpack(raw: pd.Series, depth: pd.Series) -> pd.Series:
    return pd.Series([
        None if b is None else np.frombuffer(b, dtype=">u2" if d > 8 else "u1").astype(np.int32)
        for b, d in zip(raw, depth)])


def unpack_samples(tiles: DataFrame, col: str = "samples") -> DataFrame:
    """Binary tiles to arrays of samples (bulk, Arrow batches)."""
    return tiles.withColumn(col, _unpack(F.col(col), F.col("depth")))


def _wide(samples: Column, depth: Column) -> Column:
    return F.when(depth <= 8, F.transform(samples, lambda x: x * 257)).otherwise(samples)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def compare_rasters(a: DataFrame, b: DataFrame, lossless: bool = False, keys=("image_id",)) -> DataFrame:
    """Does ``b`` hold what ``a`` held?  One verdict row per image.

    Tiles meet on their place, never on the image alone, so one huge raster is
    spread over the cluster; exact sums per tile, then per image.  8-bit tiles
    are widened.  A tile present on one side only is a shape mismatch.
    """
    place = [*keys, "y0", "width", "channels"]
    left = a.select(*place, _wide(F.col("samples"), F.col("depth")).alias("_a"))
    right = b.select(*place, _wide(F.col("samples"), F.col("depth")).alias("_b"))
    joined = left.join(right, place, "full_outer")
    paired = (
        F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.size("_a") == F.size("_b")))
    squares = F.zip_with("_a", "_b", lambda x, y: (x - y).cast("long") * (x - y).cast("long"))

    def exact(values: Column) -> Column:
        return F.sum(F.when(paired, values).cast("decimal(20,0)"))

    sums = joined.groupBy(*keys).agg(
        F.count_if(~F.coalesce(paired, F.lit(False))).alias("_odd"),
        exact(F.size("_a").cast("long")).alias("_n"), exact(_sum(F.col("_a"))).alias("_sa"),
        exact(_sum(F.col("_b"))).alias("_sb"), exact(_sum(squares)).alias("_sq"))
    n = F.col("_n").cast("double")
    mean_a, mean_b = F.col("_sa").cast("double") / n, F.col("_sb").cast("double") / n
    ratio = F.when(mean_a > 0, mean_b / F.when(mean_a > 0, mean_a)).otherwise(
        F.when(mean_b == 0, 1.0).otherwise(0.0))
    stats = sums.select(
        *keys, "_odd", "_n", mean_a.alias("mean_a"), mean_b.alias("mean_b"),
        (F.col("_sq").cast("double") / n).alias("mse"), ratio.alias("ratio"), "_sq")
    stats = stats.withColumn("psnr", psnr("mse"))
    usable = (F.col("_odd") == 0) & (F.col("_n") > 0)
    if lossless:
        verdict = F.when(F.col("_sq") == 0, F.lit("ok")).otherwise(F.lit("not identical"))
    else:
        verdict = (
            F.when(~F.col("ratio").between(fv.MEAN_RATIO_FLOOR, 1.0 / fv.MEAN_RATIO_FLOOR),
                   F.lit("brightness"))
            .when(F.col("psnr") < fv.PSNR_FLOOR_DB, F.lit("below the PSNR floor"))
            .otherwise(F.lit("ok")))
    return stats.select(
        *keys, "mean_a", "mean_b", "mse", "ratio", "psnr",
        F.when(F.coalesce(usable, F.lit(False)), verdict).otherwise(F.lit("shape mismatch"))
        .alias("verdict"))


def _bundle(df: DataFrame, keys, order: list[str], digest: str) -> DataFrame:
    ordered = F.transform(
        F.sort_array(F.collect_list(F.struct(*order, digest))), lambda x: x[digest])
    return df.groupBy(*keys).agg(F.md5(F.array_join(ordered, "").cast("binary")).alias(digest))


def raster_digest(tiles: DataFrame, keys=("image_id",), tile_no: str = "tile_no",
                  page: str = "page", fan: int = 1024) -> DataFrame:
    """A19: '<pages>:<md5>' over an image's tiles, a tree digest.

    The md5 of each tile (shape, depth and samples), then of runs of ``fan``
    consecutive tiles, then of runs of runs: no step gathers more than ``fan``
    values per level below the last, and partitioning never shows.
    """
    keys = list(keys)
    text = F.concat_ws(
        "|", F.concat_ws("x", "width", "rows", "channels"), F.col("depth").cast("string"),
        F.array_join(F.col("samples").cast("array<string>"), ","))
    leaves = tiles.select(
        *keys, page, F.col(tile_no).cast("long").alias("_t"), F.md5(text.cast("binary")).alias("_d"))
    runs = _bundle(leaves.withColumn("_r", F.floor(F.col("_t") / fan)),
                   [*keys, page, "_r"], ["_t"], "_d")
    spans = _bundle(runs.withColumn("_s", F.floor(F.col("_r") / fan)),
                    [*keys, page, "_s"], ["_r"], "_d")
    return _bundle(spans, [*keys, page], ["_s"], "_d").groupBy(*keys).agg(
        F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.md5(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct(page, "_d"))), lambda x: x["_d"]), "")
            .cast("binary"))).alias("digest"))


def convert_pixels(df: DataFrame, source, target, matrix, rgb=("r", "g", "b")) -> DataFrame:
    """F10 in columnar form: 16-bit RGB columns from one profile into another.

    ``source`` and ``target`` are (kind, parameters) curves shared by the three
    channels; ``matrix`` is 3 x 3, linear source RGB to linear target RGB.
    """
    linear = [curve_forward(F.col(c) / F.lit(65535.0), *source) for c in rgb]
    out = df
    names = []
    for i, c in enumerate(rgb):
        mixed = sum((linear[j] * F.lit(float(matrix[i][j])) for j in range(1, 3)),
                    linear[0] * F.lit(float(matrix[i][0])))
        clipped = F.least(F.greatest(mixed, F.lit(0.0)), F.lit(1.0))
        coded = curve_inverse(clipped, *target)
        level = F.floor(F.least(F.greatest(coded, F.lit(0.0)), F.lit(1.0)) * 65535.0 + 0.5)
        names.append(f"_new_{c}")
        out = out.withColumn(names[-1], level.cast("int"))
    for c, new in zip(rgb, names):
        out = out.withColumn(c, F.col(new)).drop(new)
    return out


def convert_colour(tiles: DataFrame, source, target, matrix) -> DataFrame:
    """F10 for whole tiles: sample arrays of RGB or RGBA pixels, alpha copied; other tiles as they are.

    The same curves as ``convert_pixels``, applied to array elements.
    """
    channels, samples = F.col("channels"), F.col("samples")

    def linear(i):
        at = lambda k: F.get(samples, i * channels + k)
        return F.array(*[curve_forward(at(k) / F.lit(65535.0), *source) for k in range(3)], at(3).cast("double"))

    def coded(pixel):
        levels = []
        for weights in matrix:
            mixed = sum((F.get(pixel, F.lit(j)) * F.lit(float(weights[j])) for j in range(1, 3)), F.get(pixel, F.lit(0)) * F.lit(float(weights[0])))
            value = curve_inverse(F.least(F.greatest(mixed, F.lit(0.0)), F.lit(1.0)), *target)
            levels.append(F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * 65535.0 + 0.5).cast("int"))
        return F.slice(F.array(*levels, F.get(pixel, F.lit(3)).cast("int")), F.lit(1), channels)

    pixels = F.transform(F.sequence(F.lit(0), F.floor(F.size(samples) / channels).cast("int") - 1), linear)
    fits = channels.isin(3, 4) & (F.size(samples) >= channels)
    return tiles.withColumn("samples", F.when(fits, F.flatten(F.transform(pixels, coded))).otherwise(samples))
