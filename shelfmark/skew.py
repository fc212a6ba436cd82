"""Per-group work that survives a hot group.

A single folder, group or content id may hold a large share of all rows, so no
operator in this package orders or collects an unbounded group inside one
task.  The helpers below are the only ways groups are handled:

* ``group_facts`` + ``attach`` -- aggregate with a map-side combine, then join
  the one-row-per-group facts back through an exchange the adaptive optimizer
  can split when a partition turns out to be hot; ``attach_each`` for several tables;
* ``top_rows`` -- the first k rows per group, limited on the map side;
* ``running_total`` / ``previous_value`` -- ordered scans in two levels, over
  chunks of the group and over the (few) chunk totals;
* ``global_rank`` -- positions in a total order from a range-partitioned sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import materialise

_SHARD = "_shard"


def _shard(keys: Sequence[str]) -> Column:
    # Determined by the keys, so it never changes what matches.  It is part of
    # the join key only to give both sides their own exchange: the adaptive
    # skew rule splits a hot partition when both join inputs are exchanges,
    # which the output of an aggregate on the same keys would not be.
    # Never NULL, so no "is not null" check on it is inferred and pushed around.
    return F.shiftrightunsigned(F.xxhash64(*[F.col(k) for k in keys]), 44)


def attach(df: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join one-row-per-group ``facts`` back to ``df``; hot groups are split.

    Keys compare null-safely on nothing: a row with a NULL key keeps NULL
    facts, exactly like an ordinary equi-join.  The shard is the first key: it
    is what the rows are sorted by, and paths that begin alike are compared
    letter by letter only where it ties.
    """
    keys = list(keys)
    left = df.withColumn(_SHARD, _shard(keys))
    right = facts.withColumn(_SHARD, _shard(keys))
    return left.join(right, [_SHARD] + keys, how).drop(_SHARD)


def attach_each(df: DataFrame, tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """``attach`` of several tables by the same keys: ``df`` is exchanged once for all of them."""
    keys = list(keys)
    out = df.withColumn(_SHARD, _shard(keys))
    for facts in tables:
        out = out.join(facts.withColumn(_SHARD, _shard(keys)), [_SHARD] + keys, "left")
    return out.drop(_SHARD)


def group_facts(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """One row per group.  Every aggregate used here combines on the map side.

    Text and list aggregates sort their rows; as in ``attach``, by the shard first.
    """
    return df.withColumn(_SHARD, _shard(keys)).groupBy(_SHARD, *keys).agg(*aggs).drop(_SHARD)


def with_group_facts(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """``df`` plus per-group aggregates, without a window over the group."""
    return attach(df, group_facts(df, keys, *aggs), keys)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
             rank: str = "_rank") -> DataFrame:
    """The first ``k`` rows of each group.

    The rank filter sits directly on the window, so Spark places a group limit
    before the exchange: at most k rows per group and map task are shuffled.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def sampled_list(df: DataFrame, keys: Sequence[str], value: str, k: int, name: str) -> DataFrame:
    """One row per group with its ``k`` smallest values as a sorted array."""
    return (
        top_rows(df.select(*keys, value), keys, [F.col(value)], k)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(value)).alias(name))
    )


def running_total(df: DataFrame, keys: Sequence[str], chunk: Sequence[str], order: Sequence[str],
                  value: Column, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` per group in (chunk, order) order.

    ``chunk`` is an order-preserving coarse prefix of the ordering; the rows of
    one (group, chunk) are what a task sorts.  Chunk totals are combined on the
    map side and scanned per group.
    """
    parts = list(keys) + list(chunk)
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*parts).agg(F.sum(value).alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(across), F.lit(0)))
        .drop("_total")
    )
    return (
        attach(df.withColumn("_inside", F.sum(value).over(inside)), offsets, parts)
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset")
    )


def previous_value(df: DataFrame, keys: Sequence[str], chunk: Sequence[str], order: Sequence[str],
                   value: str, name: str) -> DataFrame:
    """``value`` of the preceding row of the group in (chunk, order) order."""
    parts = list(keys) + list(chunk)
    inside = Window.partitionBy(*parts).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(*chunk)
    position = F.struct(*[F.col(c) for c in order])
    carried = (
        df.groupBy(*parts).agg(F.max_by(F.col(value), position).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(across))
        .drop("_last")
    )
    return (
        attach(
            df.withColumn("_first", F.row_number().over(inside) == 1)
            .withColumn("_previous", F.lag(value).over(inside)),
            carried, parts)
        .withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_previous")))
        .drop("_first", "_previous", "_carry")
    )


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """0-based position of every row in the total order of ``order``.

    A range-partitioned sort, then per-partition counts (one row per
    partition) turned into offsets.  The sorted rows are checkpointed so that
    both uses see the same partition boundaries, even after a lost executor.
    """
    bits = 33  # monotonically_increasing_id keeps the row's position in its low bits
    placed = materialise(
        df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_id", bits)).withColumn(
        "_pos", F.col("_id").bitwiseAND(F.lit((1 << bits) - 1)))
    starts = (
        placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)))
        .drop("_n")
    )
    return (
        placed.join(starts, "_part")
        .withColumn(name, F.col("_start") + F.col("_pos"))
        .drop("_part", "_pos", "_start", "_id")
    )
