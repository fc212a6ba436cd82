"""Whole-plan checks, totals, previews and comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import fixed_values as fv
from shelfmark import skew
from shelfmark.functions import paths as P


def _any_word(text: Column, words) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def duplicate_destinations(plan: DataFrame, dest: str = "dest", src: str = "path",
                           sample: int = 4, fold_case: bool = False) -> DataFrame:
    """A1: destinations more than one source would write.

    Counting and sampling are separate: counts combine on the map side and the
    sample is limited there, so a destination shared by very many sources never
    gathers them.
    """
    key = F.lower(F.col(dest)) if fold_case else F.col(dest)
    rows = plan.filter(F.col(dest).isNotNull()).select(key.alias(dest), F.col(src).alias("source"))
    counts = rows.groupBy(dest).agg(F.count(F.lit(1)).alias("sources")).filter("sources > 1")
    samples = skew.sampled_list(rows, [dest], "source", sample, "sample")
    return counts.join(samples, dest).withColumn(
        "more", F.greatest(F.col("sources") - sample, F.lit(0)))


def collision_report(plan: DataFrame, limit: int = 10, **kwargs) -> DataFrame:
    """A1 as shown to a person: the first ten collisions by destination."""
    return duplicate_destinations(plan, **kwargs).orderBy("dest").limit(limit)


def refuse_on_collision(plan: DataFrame, dest: str = "dest", src: str = "path") -> DataFrame:
    """A1 as a gate: one row saying whether the whole run is refused."""
    return duplicate_destinations(plan, dest, src).agg(
        F.count(F.lit(1)).alias("collisions"),
        F.coalesce(F.sum("sources"), F.lit(0)).alias("colliding_sources"),
        (F.count(F.lit(1)) > 0).alias("refused"))


def is_failure(status: str = "status") -> Column:
    """A result that is an error: said to be, or of a status no run knows."""
    good = [s for s in fv.COUNTED_STATUSES if s != "error"]
    return ~F.coalesce(F.col(status).isin(*good), F.lit(False))


def status_counts(results: DataFrame, keys: Sequence[str] = (), status: str = "status") -> DataFrame:
    """A10: totals per counted status; an unknown status is an error, never silence."""
    known = [F.count_if(F.col(status) == s).alias(s) for s in fv.COUNTED_STATUSES if s != "error"]
    odd = ~F.coalesce(F.col(status).isin(*fv.COUNTED_STATUSES), F.lit(False))
    return results.groupBy(*keys).agg(
        *known, F.count_if((F.col(status) == "error") | odd).alias("error"),
        F.count_if(odd).alias("uncounted"), F.count(F.lit(1)).alias("total"))


def sum_maps(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Label -> count maps added up, one row per label."""
    return (
        df.select(*keys, F.explode(col).alias("label", "value"))
        .groupBy(*keys, "label").agg(F.sum("value").alias("total")))


def summed_map(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """A12 as one map per key; labels are the (few) counters a run knows."""
    totals = sum_maps(df, col, keys).filter("total <> 0")
    return totals.groupBy(*keys).agg(F.map_from_entries(
        F.sort_array(F.collect_list(F.struct("label", "total")))).alias(col))


def gate_counts(decisions: DataFrame, verdict: str = "verdict", reason: str = "reason") -> DataFrame:
    """Kept and removable sources by reason."""
    return decisions.groupBy(verdict, reason).agg(F.count(F.lit(1)).alias("sources"))


def gate_cube(decisions: DataFrame, reason: str = "reason",
              direction: str = "direction") -> DataFrame:
    """The recap cube over reason and direction."""
    return decisions.cube(reason, direction).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("sources"))


def notice_counts(plan: DataFrame, run_distance: float, reason: str = "scan_reason",
                  distance: str = "distance") -> DataFrame:
    """Assets encoded at another distance than the run's, by reason."""
    return (
        plan.filter(F.col(distance) != F.lit(float(run_distance)))
        .groupBy(F.coalesce(F.col(reason), F.lit("8-bit")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("assets")))


def notice_folders(plan: DataFrame, run_distance: float, folder: str = "folder",
                   reason: str = "scan_reason", distance: str = "distance") -> DataFrame:
    """Where the guessed ones are; who shows them picks how many."""
    return (
        plan.filter((F.col(distance) != F.lit(float(run_distance))) & (F.col(reason) == "guessed"))
        .groupBy(folder).agg(F.count(F.lit(1)).alias("assets")))


def profile_stats(df: DataFrame, mode: str = "auto", keys: Sequence[str] = ()) -> DataFrame:
    """Illuminant patch statistics from audited profiles.

    ``df``: profile_sha, d50_exact, d50_near, profile_bytes.
    """
    near, exact = F.col("d50_near"), F.col("d50_exact")
    patch = {"on": F.lit(True), "off": F.lit(False)}.get(mode, near)
    fits = F.col("profile_bytes") >= 80
    applied = patch & fits
    return df.groupBy(*keys).agg(
        F.count_if(applied).alias("applied"),
        F.count_if(~applied).alias("skipped"),
        F.count_if(exact).alias("already_correct"),
        F.count_if(~applied & (patch | near)).alias("skipped_needed"),
        F.count_if(~patch & ~exact & ~near).alias("other_illuminant"),
        F.count_distinct(F.when(applied & ~exact, F.col("profile_sha"))).alias("profiles_touched"))


def profile_stats_approx(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A15 with an approximate distinct count, for very many profiles."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("assets"), F.approx_count_distinct("profile_sha").alias("profiles"))


def worst_ratio(samples: DataFrame, keys: Sequence[str] = (), ratio: str = "ratio") -> DataFrame:
    """The worst sampled ratio, never the mean."""
    return samples.groupBy(*keys).agg(
        F.max(ratio).alias("worst_ratio"), F.count(ratio).alias("samples"))


def largest_groups(df: DataFrame, size: str, k: int = 2) -> DataFrame:
    """L3: the k largest groups."""
    return df.orderBy(F.desc(size), *[c for c in df.columns if c != size]).limit(k)


def space_preflight(plan: DataFrame, ratios: DataFrame, volumes: DataFrame,
                    minimum: int = fv.PREFLIGHT_MIN_BYTES) -> DataFrame:
    """Does the projected output fit each destination volume?

    ``plan``: volume, dest_dir, src, size, at_run_distance.  ``ratios``: ratio
    samples of the run.  ``volumes``: volume, free.  A source counts once per
    destination folder however many pages it has; sources at another distance
    count at their full size.  ``staging_peak`` is the two largest folders;
    ``below_minimum`` says that the whole run is too small to be asked about.
    """
    sources = plan.select("volume", "dest_dir", "src", "size", "at_run_distance").dropDuplicates(
        ["volume", "dest_dir", "src"])
    folders = sources.groupBy("volume", "dest_dir").agg(
        F.sum(F.when(F.col("at_run_distance"), F.col("size")).otherwise(0)).alias("_ratioed"),
        F.sum(F.when(F.col("at_run_distance"), 0).otherwise(F.col("size"))).alias("_full"))
    # Run-wide numbers are scalar subqueries: one value each, never a join.
    ratio = ratios.agg(F.max("ratio")).scalar()
    total = folders.agg(F.sum(F.col("_ratioed") + F.col("_full"))).scalar()
    scaled = folders.withColumn("need", F.col("_ratioed") * ratio + F.col("_full"))
    peak = largest_groups(scaled.select("need", "volume", "dest_dir"), "need").agg(
        F.sum("need")).scalar()
    per_volume = scaled.groupBy("volume").agg(F.sum("need").alias("need"))
    return (
        per_volume.join(volumes, "volume", "left")
        .withColumn("staging_peak", peak)
        .withColumn("below_minimum", total < minimum)
        .withColumn("verdict", F.when(F.col("free").isNull(), F.lit("unknown"))
                    .when(F.col("free") <= F.col("need"), F.lit("not enough"))
                    .otherwise(F.lit("ok"))))


def audit_totals(audit: DataFrame, state: str = "state") -> DataFrame:
    """Containers by audit state."""
    return audit.groupBy(state).agg(
        F.count(F.lit(1)).alias("containers"),
        F.count_if(F.col("layout_problem").isNotNull()).alias("layout_problems"))


def recommend_mode(assets: DataFrame, marker: str = fv.EXPORT_MARKER, root: str = "/",
                   keys: Sequence[str] = (), col: str = "path") -> DataFrame:
    """Which mode suits a folder tree.

    Marker folders: 6 (or 7 when exactly one subfolder sits below them); a tree
    deeper than one level: 3; several folders: 2; one folder: 0.
    """
    dirs = P.folder_parts(col)
    anchor = P.marker_anchor(dirs, root, marker)
    facts = assets.select(
        *keys, P.parent(col).alias("_dir"), F.size(P.below_root(dirs, root)).alias("_depth"),
        anchor.isNotNull().alias("_marked"), F.get(dirs, anchor + 1).alias("_below"),
    ).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), F.count_distinct("_dir").alias("folders"),
        F.max("_depth").alias("depth"), F.max("_marked").alias("has_marker"),
        F.min("_below").alias("_low"), F.max("_below").alias("_high"))
    return facts.withColumn(
        "mode", F.when(F.col("has_marker"), F.when(F.col("_low") == F.col("_high"), 7).otherwise(6))
        .when(F.col("depth") > 1, 3).when(F.col("folders") > 1, 2).otherwise(0)).drop("_low", "_high")


def size_stats(df: DataFrame, keys: Sequence[str], size: str = "size",
               digit_bits: int = 20) -> DataFrame:
    """Exact median and middle 80 % of an integer size per group.

    A histogram first (map-side combined), then cumulative counts in two
    levels over the high and low digits of the size; a group of any size is
    scanned as at most 2**20 distinct values at a time.
    """
    keys = list(keys)
    histogram = df.groupBy(*keys, size).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_high", F.shiftright(F.col(size), digit_bits))
    placed = skew.running_total(histogram, keys, ["_high"], [size], F.col("_n"), "_upto")
    totals = histogram.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    ranked = skew.attach(placed, totals, keys)

    def at(p: float, upper: bool) -> Column:
        position = F.lit(p) * (F.col("_all") - 1)
        index = (F.ceil(position) if upper else F.floor(position)).cast("long")
        return F.min(F.when(F.col("_upto") > index, F.col(size)))

    def name(p: float) -> str:
        return f"_p{int(p * 100)}"

    picks = []
    for p in (0.1, 0.5, 0.9):
        picks += [at(p, False).alias(name(p) + "_lo"), at(p, True).alias(name(p) + "_hi")]
    stats = ranked.groupBy(*keys).agg(F.max("_all").alias("assets"), *picks)

    def value(p: float) -> Column:
        position = F.lit(p) * (F.col("assets") - 1)
        lo, hi = F.col(name(p) + "_lo"), F.col(name(p) + "_hi")
        return lo + (hi - lo) * (position - F.floor(position))

    return stats.select(
        *keys, "assets", value(0.5).alias("median"), value(0.1).alias("low"),
        value(0.9).alias("high"))


def discarded_pages(pages: DataFrame, plan: DataFrame, key: str = "path") -> DataFrame:
    """Pages a policy leaves out, per source; a lost real page keeps the source.

    ``pages``: path, page, is_thumb; ``plan``: path, page.
    """
    dropped = pages.join(plan.select(key, "page").distinct(), [key, "page"], "left_anti")
    return dropped.groupBy(key).agg(
        F.count_if(~F.col("is_thumb")).alias("real_dropped"),
        F.count_if(F.col("is_thumb")).alias("thumbs_dropped"),
    ).withColumn("undeletable", F.col("real_dropped") > 0)


def plan_impact(plan: DataFrame, deletes: bool = False, delete_skipped: bool = False) -> DataFrame:
    """What a plan would do before anything runs."""
    status = F.col("sync")
    reaches_gate = status.isin("write", "overwrite")
    if delete_skipped:
        reaches_gate = reaches_gate | (status == "skip")
    return plan.agg(
        F.count_if(status == "write").alias("would_write"),
        F.count_if(status == "overwrite").alias("would_replace"),
        F.count_if(status == "skip").alias("would_skip"),
        F.coalesce(F.max(reaches_gate), F.lit(False)).alias("any_for_gate"),
        (F.count_if(reaches_gate) if deletes else F.lit(0).cast("long")).alias("would_delete"),
        (F.count_if(~reaches_gate) if deletes else F.count(F.lit(1))).alias("would_keep"))


def failure_signature(detail) -> Column:
    """What kind of failure a message describes."""
    text = F.col(detail) if isinstance(detail, str) else detail
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(_any_word(text, fv.MEMORY_ERROR_WORDS), F.lit("out of memory"))
        .when(low.rlike(r"refus|belongs to another|different source"), F.lit("refused"))
        .when(low.rlike(r"corrupt|truncated|no readable pages|unreadable"), F.lit("unreadable"))
        .otherwise(F.lit("error")))


def failure_signatures(results: DataFrame, detail: str = "detail") -> DataFrame:
    """Failures by signature."""
    return results.groupBy(failure_signature(detail).alias("signature")).agg(
        F.count(F.lit(1)).alias("failures"))


def spread_sample(df: DataFrame, k: int = fv.SAMPLE_COUNT, size: str = "size",
                  path: str = "path") -> DataFrame:
    """K evenly spaced picks over the size distribution, first and last included."""
    unique = df.select(path, size).dropDuplicates([path])
    ranked = skew.global_rank(unique, [size, path], "_rank")
    count = ranked.agg(F.count(F.lit(1)).alias("_n"))
    steps = max(k - 1, 1)
    position = F.bround(F.col("_i") * (F.col("_n") - 1) / F.lit(float(steps)), 0).cast("long")
    # k positions, one row of input: a handful of rows by construction.
    targets = count.select(
        "_n", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("_i")).select(
            F.when(F.col("_n") <= k, F.least(F.col("_i"), F.col("_n") - 1)).otherwise(position)
            .alias("_rank")).distinct()
    return ranked.join(F.broadcast(targets), "_rank").select(path, size)


def order_plan(df: DataFrame, col: str = "path") -> DataFrame:
    """L1: the deterministic order of a plan."""
    return df.orderBy(col)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """L2: the first k rows per key and how many more there are."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    shown = skew.top_rows(df, keys, order, k, "position")
    return (
        skew.attach(shown, counts, list(keys))
        .withColumn("more", F.greatest(F.col("_n") - k, F.lit(0))).drop("_n"))


def layout_diff(present: DataFrame, planned: DataFrame) -> DataFrame:
    """Pages present but not planned, and planned but not present."""
    columns = present.columns
    # Both differences are the sign of one count: rows cross one exchange, as one row per value and task.
    both = present.withColumn("_n", F.lit(1)).unionByName(planned.select(*columns).withColumn("_n", F.lit(-1)))
    return (
        both.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
        .select(*columns, F.when(F.col("_n") > 0, F.lit("stale")).otherwise(F.lit("missing")).alias("side")))


def union_plans(*plans: DataFrame) -> DataFrame:
    """The plans of several routes as one, before the shared collision check."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), plans)


def unread(asked: DataFrame, answered: DataFrame, key: str = "path") -> DataFrame:
    """Which asked paths were answered, which were not."""
    asked, answered = asked.select(key), answered.select(key)
    return (
        asked.intersect(answered).withColumn("state", F.lit("answered"))
        .unionByName(asked.subtract(answered).withColumn("state", F.lit("unread"))))


def snapshot_diff(a: DataFrame, b: DataFrame, key: str, ignore: Sequence[str] = ()) -> DataFrame:
    """Added, removed and changed rows of two catalogues.

    Masked columns are ignored; NULLs compare equal to each other.
    """
    compared = [c for c in a.columns if c != key and c not in ignore]
    left = a.select(key, F.struct(*compared).alias("_a"))
    right = b.select(key, F.struct(*compared).alias("_b"))
    joined = left.join(right, key, "full_outer")
    changed = F.array_join(F.array_compact(F.array(*[
        F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in compared])), ",")
    return (
        joined.withColumn("change", F.when(F.col("_a").isNull(), F.lit("added"))
                          .when(F.col("_b").isNull(), F.lit("removed"))
                          .when(changed != "", F.lit("changed")))
        .withColumn("columns", F.when(F.col("change") == "changed", changed).otherwise(F.lit("")))
        .filter(F.col("change").isNotNull()).select(key, "change", "columns"))
