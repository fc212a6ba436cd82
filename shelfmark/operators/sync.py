"""What is already up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import skew
from shelfmark.config import PolicyConfig
from shelfmark.operators.policy import page_output_name


def sync_status(exists: Column, src_mtime: Column, out_mtime: Column, overwrite: str) -> Column:
    """write / skip / overwrite; a time that cannot be read counts as stale."""
    if overwrite == "never":
        done = F.lit(True)
    elif overwrite == "always":
        done = F.lit(False)
    else:
        done = F.coalesce(src_mtime <= out_mtime, F.lit(False))
    return F.when(~exists, F.lit("write")).when(done, F.lit("skip")).otherwise(F.lit("overwrite"))


def sync_plan(plan: DataFrame, existing: DataFrame, overwrite: str = "smart", dest: str = "dest",
              mtime: str = "mtime", beside: Sequence[DataFrame] = ()) -> DataFrame:
    """Join the plan to the existing outputs and decide per row.

    ``existing`` has one row per ``dest`` with ``out_mtime``; both join inputs
    are plain exchanges, so a destination many sources share is split.
    ``beside``: more tables with one row per ``dest``, met on the same exchange.
    """
    found = existing.withColumn("_found", F.lit(True))
    joined = skew.attach_each(plan, [*beside, found], [dest])
    exists = F.coalesce(F.col("_found"), F.lit(False))
    return joined.withColumn(
        "sync", sync_status(exists, F.col(mtime), F.col("out_mtime"), overwrite)).drop("_found")


def due(plan: DataFrame, existing: DataFrame, overwrite: str = "smart", dest: str = "dest",
        mtime: str = "mtime") -> DataFrame:
    """J1, only the rows a run has to do: an anti-join on the up-to-date outputs."""
    if overwrite == "always":
        return plan
    settled = existing.select(dest, F.col("out_mtime").alias("_out"))
    if overwrite == "never":
        return plan.join(settled, dest, "left_anti")
    p, s = plan.alias("p"), settled.alias("s")
    return p.join(
        s, (F.col(f"p.{dest}") == F.col(f"s.{dest}")) & (F.col(f"p.{mtime}") <= F.col("s._out")),
        "left_anti")


def sync_groups(entries: DataFrame, existing: DataFrame, overwrite: str = "smart",
                dest: str = "dest", mtime: str = "mtime", ours: str | None = None) -> DataFrame:
    """The newest member of a group decides for the whole group.

    With ``ours`` (a flag of ``existing``), an output that is not this
    catalogue's own is refused instead of skipped or replaced.
    """
    groups = entries.groupBy(dest).agg(
        F.max(mtime).alias("newest"), F.count(F.lit(1)).alias("members"))
    decided = sync_plan(groups, existing, overwrite, dest, "newest")
    if ours is None or overwrite == "always":
        return decided
    foreign = ~F.coalesce(F.col(ours), F.lit(False)) & (F.col("sync") != "write")
    if overwrite == "never":
        return decided
    return decided.withColumn("sync", F.when(foreign, F.lit("refused")).otherwise(F.col("sync")))


def same_bytes(plan: DataFrame, meta: DataFrame, dest: str = "dest",
               content: str = "content_id") -> DataFrame:
    """A newer source with the bytes its output was made from is up to date.

    ``meta`` has (dest, srcsum, read_ok); an unread or missing record proves
    nothing and the row stays due.
    """
    proofs = (
        meta.filter(F.col("read_ok") & F.col("srcsum").isNotNull())
        .select(dest, F.col("srcsum").alias(content), F.lit(True).alias("_same")))
    joined = plan.join(proofs.dropDuplicates([dest, content]), [dest, content], "left")
    proven = F.coalesce(F.col("_same"), F.lit(False)) & (F.col("sync") == "overwrite")
    return (
        joined.withColumn("same_bytes", proven)
        .withColumn("sync", F.when(proven, F.lit("skip")).otherwise(F.col("sync")))
        .drop("_same"))


def changed_since(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """Sources whose size or time moved, or that are gone."""
    verdicts = changed_paths(before, after, key)
    return skew.attach(before, verdicts, [key]).withColumn("changed", F.coalesce("changed", F.lit(True)))


def changed_paths(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """J20, one row per path of ``before``.

    A path listed in several states has changed unless the same states are
    listed again: states are counted per path and never paired.
    """
    states = [rows.select(key, "size", "mtime", F.lit(bit).cast("long").alias("_side")) for rows, bit in ((before, 1), (after, 2))]
    each = states[0].unionByName(states[1]).filter(F.col(key).isNotNull()).repartition(F.col(key)).groupBy(key, "size", "mtime").agg(
        F.bit_or("_side").alias("_side"))
    return each.groupBy(key).agg(F.bit_or("_side").alias("_any"), F.bit_and("_side").alias("_all")).filter("_any <> 2").select(
        key, (F.col("_all") != 3).alias("changed"))


def layout_guard(pages: DataFrame, existing: DataFrame, overwrite: str = "smart",
                 cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Keep the page layout an archived source already has.

    ``pages``: path, stem, dest_dir, page, is_thumb, mtime.  ``existing``: dest,
    out_mtime and optionally ``same_bytes``.  One row per source; ``keep_thumbs``
    is NULL when this run rewrites the main output and may decide freely.
    """
    keys = ["path"]
    facts = pages.groupBy(*keys).agg(
        F.count_if(~F.col("is_thumb")).alias("_real"),
        F.count_if(F.col("is_thumb")).alias("_thumbs"),
        F.min(F.when(~F.col("is_thumb"), F.col("page"))).alias("_first_real"),
        F.min("page").alias("_first"))
    rows = skew.attach(pages, facts, keys)
    total = F.col("_real") + F.col("_thumbs")
    with_name = page_output_name(
        "stem", "page", "is_thumb", (total == 1) & ~F.col("is_thumb"), cfg.thumbnail_suffix)
    without_name = F.when(~F.col("is_thumb"), page_output_name(
        "stem", "page", F.lit(False), F.col("_real") == 1, cfg.thumbnail_suffix))
    lead = F.coalesce(F.col("_first_real"), F.col("_first"))
    main = (F.col("page") == lead) & (~F.col("is_thumb") | (F.col("_real") == 0))
    named = rows.select(
        "path", "mtime", "dest_dir", with_name.alias("_with"), without_name.alias("_without"),
        main.alias("_main"))
    candidates = named.select(
        "path", "mtime", "dest_dir",
        F.explode(F.array(
            F.struct(F.col("_with").alias("name"), F.col("_main").alias("main"),
                     (F.coalesce(F.col("_with") != F.col("_without"), F.lit(True))).alias("extra")),
            F.struct(F.col("_without").alias("name"), F.col("_main").alias("main"),
                     F.lit(False).alias("extra")))).alias("c"),
    ).select("path", "mtime", F.concat_ws("/", "dest_dir", "c.name").alias("dest"),
             "c.main", "c.extra", F.col("c.name").isNotNull().alias("_named")).filter("_named")
    proof = F.col("same_bytes") if "same_bytes" in existing.columns else F.lit(False)
    found = existing.select("dest", "out_mtime", proof.alias("_same"), F.lit(True).alias("_found"))
    joined = candidates.join(found, "dest", "left")
    there = F.coalesce(F.col("_found"), F.lit(False))
    stale = F.col("main") & there & (F.col("mtime") > F.col("out_mtime")) & ~F.col("_same")
    verdict = joined.groupBy(*keys).agg(
        F.coalesce(F.max(F.col("main") & there), F.lit(False)).alias("_archived"),
        F.coalesce(F.max(stale), F.lit(False)).alias("_stale"),
        F.count_if(F.col("extra")).alias("_extra"),
        F.count_if(F.col("extra") & there).alias("_extra_there"))
    kept = (F.col("_extra") > 0) & (F.col("_extra") == F.col("_extra_there"))
    rewrites = F.col("_stale") if overwrite == "smart" else F.lit(overwrite == "always")
    return verdict.select(
        *keys, F.when(F.col("_archived") & ~rewrites, kept).alias("keep_thumbs"))
