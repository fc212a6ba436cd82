"""Processing lineage: generations, merged histories, steps, best copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import fixed_values as fv
from shelfmark import skew
from shelfmark.functions import records as R
from shelfmark.functions.numbers import recorded_number
from shelfmark.functions.recipes import parse_recipe
from shelfmark.operators.policy import classify_reencode


def reconcile_gen(df: DataFrame, text: str = "text") -> DataFrame:
    """A8 per record text: stored, counted and reconciled generations."""
    return (
        df.withColumn("stored", R.stored_gen(text))
        .withColumn("counted", R.counted_gen(text))
        .withColumn("gen", F.greatest("stored", "counted")))


def reconcile_gen_rows(chain: DataFrame, keys: Sequence[str], d: str = "d",
                       stored: str | None = None) -> DataFrame:
    """A8 over an exploded chain: partial counts combine on the map side."""
    lossy = F.count_if(F.col(d) > 0)
    known = F.coalesce(F.max(stored), F.lit(0)) if stored else F.lit(0)
    return (
        chain.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("entries"), lossy.alias("counted"), known.alias("stored"))
        .withColumn("gen", F.greatest("counted", "stored")))


def merge_lineage(df: DataFrame, description="description", software="software",
                  history="history") -> DataFrame:
    """Up to three records of one asset folded into one history."""
    staged = R.with_merged_chain(df, description, software, history, "_merged")
    stored = R.merged_stored_gen(F.col(description), F.col(software), F.col(history))
    counted = F.size(F.filter(
        "_merged", lambda x: F.coalesce(recorded_number(x["d"]) > 0, F.lit(False))))
    text = F.array_join(F.transform("_merged", lambda x: F.concat(
        F.lit("cjxl d="), x["d"], F.lit(" e="), x["e"])), " | ")
    return (
        staged.withColumn("merged", text).withColumn("entries", F.size("_merged"))
        .withColumn("gen", F.greatest(stored, counted)).drop("_merged"))


def latest_record(history: DataFrame, keys: Sequence[str], pos: str = "pos",
                  text: str = "text") -> DataFrame:
    """W3 over exploded history rows: the newest entry that settles the question.

    A deliberate "no encode record" entry stops the walk; entries that say
    nothing are passed over.
    """
    settles = R.is_no_record(text) | F.col(text).rlike(fv.BLOCK_PATTERN)
    rated = history.withColumn("_pos", F.when(settles, F.col(pos)))
    newest = rated.groupBy(*keys).agg(
        F.max_by(text, "_pos").alias("_text"), F.max("_pos").alias("record_pos"))
    known = F.col("record_pos").isNotNull() & ~R.is_no_record("_text")
    return newest.select(
        *keys, "record_pos",
        F.when(known, R.record_of("_text")).otherwise(F.lit("")).alias("record"))


def chain_generations(chain: DataFrame, keys: Sequence[str], chunk: Sequence[str],
                      order: Sequence[str], d: str = "d") -> DataFrame:
    """Lossy generations so far, entry by entry."""
    return skew.running_total(
        chain, keys, chunk, order, (F.col(d) > 0).cast("long"), "generation")


def chain_steps(chain: DataFrame, keys: Sequence[str], chunk: Sequence[str],
                order: Sequence[str], d: str = "d", e: str = "e",
                floor: float = fv.DISTANCE_FLOOR) -> DataFrame:
    """Each step against the one before it, classified like a request."""
    paired = chain.withColumn("_de", F.struct(F.col(d).alias("d"), F.col(e).alias("e")))
    steps = skew.previous_value(paired, keys, chunk, order, "_de", "_prev")
    return (
        steps.withColumn("prev_d", F.col("_prev.d")).withColumn("prev_e", F.col("_prev.e"))
        .withColumn("step", F.when(
            F.col("_prev").isNotNull(),
            classify_reencode("prev_d", "prev_e", F.col(d), F.col(e), floor)))
        .drop("_de", "_prev"))


def best_derivative(labels: DataFrame, master: str = "master", label: str = "label",
                    path: str = "path") -> DataFrame:
    """Per master, recipe and distance, the copy with the best encode rank."""
    parsed = labels.withColumn("_r", parse_recipe(label)).select(
        master, path, label, F.col("_r.recipe").alias("recipe"), F.col("_r.d").alias("d"),
        F.col("_r.rank").alias("encode_rank"))
    return skew.top_rows(
        parsed, [master, "recipe", "d"],
        [F.col("encode_rank").desc_nulls_last(), F.col(path)], 1).drop("_rank")
