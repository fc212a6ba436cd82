"""Rasters out of the embedding vectors: 64 numbers are an 8 x 8 tile."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import raster
from workload.q_records import GAMMA, SRGB
from workload.registry import query

LEVELS = "[CAST(round_even((CAST(x AS DOUBLE) + 1) / 2 * 65535, 0) AS INT) FOR x IN embedding]"


def levels(col="embedding"):
    return F.transform(col, lambda x: F.bround((x.cast("double") + 1) / 2 * 65535, 0).cast("int"))


def tiles(s, shift: int = 0):
    """One tile per vector; ``shift`` names the place of the tile before it."""
    return s.embeddings.select(
        "label", (F.col("vec_id") - shift).alias("y0"), F.lit(8).alias("width"), F.lit(8).alias("rows"),
        F.lit(1).alias("channels"), F.lit(16).alias("depth"), levels().alias("samples"), "vec_id")


@query("tile_rasters", "S8", f"""
    WITH s AS (SELECT vec_id, {LEVELS} AS samples, CASE WHEN label = 3 THEN 9 ELSE 8 END AS width FROM embeddings),
    t AS (SELECT *, unnest([0, 3, 6]) AS y0 FROM s WHERE width = 8)
    SELECT vec_id, y0, CAST(least(3, 8 - y0) AS INT) AS rows,
        CAST(list_sum(samples[y0 * 8 + 1 : (y0 + least(3, 8 - y0)) * 8]) AS BIGINT) AS total, NULL AS reject FROM t
    UNION ALL SELECT vec_id, -1, -1, -1, 'length does not match the shape' FROM s WHERE width = 9""")
def tile_rasters(s):
    rows = s.embeddings.select(
        "vec_id", F.when(F.col("label") == 3, 9).otherwise(8).alias("width"), F.lit(8).alias("height"),
        F.lit(1).alias("channels"), F.lit(16).alias("depth"), levels().alias("payload"))
    total = F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return raster.tile_rasters(rows, 3, keys=("vec_id",)).select(
        "vec_id", F.coalesce("y0", F.lit(-1)).alias("y0"), F.coalesce("rows", F.lit(-1)).alias("rows"),
        F.coalesce(total, F.lit(-1)).alias("total"), "reject")


@query("tile_binary_rasters", "S8", f"""
    WITH s AS (SELECT vec_id, {LEVELS} AS samples FROM embeddings), t AS (SELECT *, unnest([0, 5]) AS y0 FROM s)
    SELECT vec_id, y0, CAST(list_sum(samples[y0 * 8 + 1 : least(8, y0 + 5) * 8]) AS BIGINT) AS total FROM t""")
def tile_binary_rasters(s):
    big_endian = F.unhex(F.array_join(F.transform(levels(), lambda x: F.lpad(F.hex(x), 4, "0")), ""))
    rows = s.embeddings.select(
        "vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("channels"),
        F.lit(16).alias("depth"), big_endian.alias("payload"))
    cut = raster.unpack_samples(raster.tile_rasters(rows, 5, keys=("vec_id",)))
    return cut.select("vec_id", "y0", F.aggregate(
        "samples", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("compare_rasters", "A18", f"""
    WITH t AS (SELECT vec_id, label, {LEVELS} AS s FROM embeddings),
    p AS (SELECT a.label, unnest(a.s) AS x, unnest(b.s) AS y FROM t a JOIN t b ON b.vec_id = a.vec_id + 1),
    m AS (SELECT label, avg(x) AS mean_a, avg(y) AS mean_b, avg(CAST(x - y AS DOUBLE) * (x - y)) AS mse FROM p GROUP BY label)
    SELECT label, round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b, round(mse, 2) AS mse, round(mean_b / mean_a, 6) AS ratio,
        round(10 * log10(65535.0 * 65535.0 / mse), 4) AS psnr,
        CASE WHEN mean_b / mean_a NOT BETWEEN 0.7 AND 1 / 0.7 THEN 'brightness'
        WHEN 10 * log10(65535.0 * 65535.0 / mse) < 20 THEN 'below the PSNR floor' ELSE 'ok' END AS verdict FROM m""")
def compare_rasters(s):
    a, b = tiles(s), tiles(s, 1)
    last = s.embeddings.agg(F.max("vec_id")).scalar()
    # Vector i against i + 1, by the label of the first; the ends have no partner.
    place = a.select("y0", F.col("label").alias("_label"))
    left = a.filter(F.col("y0") < last)
    right = b.drop("label").join(place, "y0").withColumnRenamed("_label", "label")
    out = raster.compare_rasters(left, right, keys=("label",))
    return out.select("label", F.round("mean_a", 4).alias("mean_a"), F.round("mean_b", 4).alias("mean_b"),
                      F.round("mse", 2).alias("mse"), F.round("ratio", 6).alias("ratio"),
                      F.round("psnr", 4).alias("psnr"), "verdict")


@query("compare_rasters_lossless", "A18", """
    SELECT vec_id, CASE WHEN label = 1 THEN 'not identical' WHEN label = 2 THEN 'shape mismatch' ELSE 'ok' END AS verdict
    FROM embeddings""")
def compare_rasters_lossless(s):
    a = tiles(s)
    b = a.filter("label <> 2").withColumn("samples", F.when(
        F.col("label") == 1, F.transform("samples", lambda x: F.when(x > 33000, x + 1).otherwise(x - 1)))
        .otherwise(F.col("samples")))
    return raster.compare_rasters(a, b, lossless=True, keys=("vec_id",)).select("vec_id", "verdict")


@query("raster_digest", "A19", f"""
    WITH t AS (SELECT label, vec_id, md5('8x8x1|16|' || array_to_string({LEVELS}, ',')) AS d FROM embeddings),
    r AS (SELECT label, vec_id // 4 AS r, md5(string_agg(d, '' ORDER BY vec_id)) AS d FROM t GROUP BY label, vec_id // 4),
    s AS (SELECT label, r // 4 AS s, md5(string_agg(d, '' ORDER BY r)) AS d FROM r GROUP BY label, r // 4),
    p AS (SELECT label, md5(string_agg(d, '' ORDER BY s)) AS d FROM s GROUP BY label)
    SELECT label, '1:' || md5(d) AS digest FROM p""")
def raster_digest(s):
    return raster.raster_digest(
        tiles(s).withColumn("page", F.lit(0)), keys=("label",), tile_no="vec_id", fan=4)


# --- fixed values: linear sRGB to linear Adobe RGB (D65) -------------------------
MATRIX = ((0.7151256, 0.2848744, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0411619, 0.9588381))


def _sql_pixel(i: int) -> str:
    lin = ["(CASE WHEN {0} / 65535.0 >= 0.04045 THEN pow(({0} / 65535.0 + 0.055) / 1.055, 2.4) "
           "ELSE {0} / 65535.0 / 12.92 END)".format(c) for c in ("r", "g", "b")]
    mix = " + ".join(f"{lin[j]} * {MATRIX[i][j]}" for j in range(3))
    return (f"CAST(floor(least(greatest(pow(least(greatest({mix}, 0), 1), 1 / 1.8), 0), 1) * 65535 + 0.5) AS INT)")


@query("convert_pixels", "F10", f"""
    WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        CAST(l_quantity * 1310 AS INT) AS r, CAST(l_partkey % 65536 AS INT) AS g, CAST(l_suppkey * 600 % 65536 AS INT) AS b
        FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {_sql_pixel(0)} AS r, {_sql_pixel(1)} AS g,
        {_sql_pixel(2)} AS b FROM p""")
def convert_pixels(s):
    pixels = s.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        (F.col("l_quantity") * 1310).cast("int").alias("r"), (F.col("l_partkey") % 65536).cast("int").alias("g"),
        (F.col("l_suppkey") * 600 % 65536).cast("int").alias("b"))
    return raster.convert_pixels(pixels, SRGB, GAMMA, MATRIX)


@query("convert_tiles", "F10")
def convert_tiles(s):
    """Whole tiles as 16 RGBA pixels each, in Arrow batches."""
    rgba = tiles(s).select("label", "y0", F.lit(4).alias("width"), F.lit(4).alias("rows"),
                           F.lit(4).alias("channels"), "depth", "samples")
    out = raster.convert_colour(rgba, SRGB, GAMMA, MATRIX)
    return out.groupBy("label").agg(F.sum(F.aggregate(
        "samples", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("total"), F.count(F.lit(1)).alias("tiles"))
