"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1, a line through
knots.  Its integral, scaled to the source's target, is the number of words
the mix has asked of the source by a time; the inverse of that function at the
words a document has before it is the document's training position.  Sorted by
position (a range partitioned sort), documents stand in training order.

A source is read in a pseudo-random but fixed order: by the digest of the
document's id.  Its documents are taken whole, as many full passes as fit into
the target and then one part of a pass up to half a document of the rest.
Running totals of a source go in two levels, inside slices of the order and over
slice totals, so a source with a third of all rows is spread over many tasks.

Null sources are one source, last in order.  A null text has no words and is
never taken.  Repeated rows are taken like any others.  No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import WORD, stored
from shelfmark.skew import global_rank

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: (time, relative weight) knots, in turn for the sources in order: early, even, late.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Rows in a slice of a source's order.
SLICE = 5000


def position_of(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which ``share`` (0..1) of a source's demand has been asked for."""
    area, done = 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        done.append(area)
        area += (t1 - t0) * (w0 + w1) / 2
    out = F.lit(float(knots[-1][0]))
    asked = share * F.lit(area)
    for k in reversed(range(len(done))):
        (t0, w0), (t1, w1) = knots[k], knots[k + 1]
        slope = (w1 - w0) / (t1 - t0)
        rest = F.greatest(asked - F.lit(done[k]), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        here = F.lit(t0) + F.when(rest == 0, 0.0).otherwise(2 * rest / (F.lit(w0) + root))
        end = done[k + 1] if k + 1 < len(done) else float("inf")
        out = F.when(asked < F.lit(end), F.least(here, F.lit(t1))).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """One row per source: size, rows, place in order, weight and target words.

    Sources share ``share`` of all words by weight; none takes more than
    ``most`` times its own, and the excess is shared again by weight.  Only
    sums over the sources reach the driver.
    """
    by_source = sizes.groupBy("source").agg(
        F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    ranked = global_rank(by_source.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "place").drop("_null")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(most)), "sources")
    unit, full, total = 0.0, None, ranked.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    while True:  # at most one turn per source: each but the last fills one at least
        is_full = F.col("weight") * F.lit(unit) > F.col("most")
        x = ranked.agg(F.sum(F.when(is_full, F.col("most")).otherwise(0.0)).alias("taken"),
                       F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))).alias("w"),
                       F.sum(is_full.cast("int")).alias("n")).first()
        if not x["w"] or x["n"] == full:
            break
        full, unit = x["n"], (share * total - x["taken"]) / x["w"]
    return ranked.withColumn("target", F.least(F.col("most"), F.col("weight") * F.lit(unit))).drop("most")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
                    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id and source of each row with size, source_size, target, uses, taken and position (of the first use; null if
    never used).  ``keep``: more columns that stay; texts need not be among them."""
    sized = docs.select("doc_id", "source", *keep, *_measures())
    return _placed(stored(sized, "sized"), weights, share, most, schedules)


def _measures() -> list[Column]:
    return [F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_order")]


def _placed(sized: DataFrame, weights, share, most, schedules) -> DataFrame:
    targets = source_targets(sized, weights, share, most)
    fraction = F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / float(1 << 32)
    slices = F.ceil(F.col("source_rows") / float(SLICE))
    facts = targets.withColumnRenamed("source", "_source")
    rows = sized.join(facts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn(
        "_slice", F.floor(fraction * slices).cast("long"))
    across = Window.partitionBy("place").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (rows.groupBy("place", "_slice").agg(F.sum("size").alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(across), F.lit(0))).drop("_n"))
    ties = [c for c in ("_row",) if c in rows.columns]
    inside = Window.partitionBy("place", "_slice").orderBy("_order", "doc_id", "size", *ties).rowsBetween(
        Window.unboundedPreceding, -1)
    rows = (rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(before, ["place", "_slice"])
            .withColumn("_start", F.col("_inside") + F.col("_before")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("_passes", passes.cast("long"))
    rest = F.col("target") - F.col("_passes") * F.col("source_size")
    part = (F.col("size") > 0) & (F.col("_start") + F.col("size") / 2.0 <= rest)
    uses = F.when(F.col("size") > 0, F.col("_passes") + part.cast("long")).otherwise(F.lit(0))
    rows = rows.withColumn("uses", uses.cast("long")).withColumn("taken", F.col("size") * F.col("uses"))
    return rows.withColumn("_schedule", (F.col("place") % len(schedules)).cast("int")).withColumn(
        "position", F.when(F.col("uses") > 0, use_position(F.lit(0), schedules)))


def use_position(use: Column, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> Column:
    """Training position of a document's use number ``use`` (from 0)."""
    asked = F.least((F.col("_start") + F.col("size") / 2.0 + use * F.col("source_size")) / F.col("target"), F.lit(1.0))
    out = position_of(asked, schedules[0])
    for k, knots in enumerate(schedules[1:], 1):
        out = F.when(F.col("_schedule") == k, position_of(asked, knots)).otherwise(out)
    return F.round(out, 9)


def training_order(docs: DataFrame, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, **options) -> DataFrame:
    """One row for each use of a document, range-sorted by training position.

    Rows are placed without their texts: only ids, sizes and a hash of the row go
    through the running totals.  The uses then meet the rows again, by id and
    hash; equal rows are one there and have a use each here.
    """
    columns = docs.columns
    # A null id has a key of its own through the hash, which includes it.
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").try_cast("long"), F.lit(0).cast("long")), "_row": F.xxhash64(F.col("doc_id").isNull(), *columns)})
    placed = mixed_documents(keyed, schedules=schedules, keep=("_id", "_row"), **options).filter(F.col("uses") > 0)
    uses = placed.withColumn("_use", F.explode(F.sequence(F.lit(0), (F.col("uses") - 1).cast("int"))))
    uses = stored(uses.select("_id", "_row", "_order", use_position(F.col("_use"), schedules).alias("position")), "uses")
    rows = keyed.dropDuplicates(["_id", "_row"]).join(uses, ["_id", "_row"])
    return rows.orderBy("position", "_order", "_row").select(*columns)


def mix(docs: DataFrame) -> DataFrame:
    """One row per document, in training order; those never taken stand last."""
    rows = mixed_documents(docs)
    return rows.select("doc_id", "size", "source_size", "target", "taken", "position", "uses").orderBy(
        F.asc_nulls_last("position"), "doc_id")
