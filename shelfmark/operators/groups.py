"""Multi-page documents: assembly, completeness, conflicts, vetoes.

Members of one document share (folder, group_id); the folder is always part of
the key, because two copies of a split carry the same id.  ``entries`` columns:
path, folder, group_id, page, is_thumb, declared, content_id, subfiletype.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import skew
from shelfmark.functions import paths as P

KEYS = ["folder", "group_id"]
_MEMBER = ["folder", "group_id", "page", "is_thumb"]


def demote_duplicates(entries: DataFrame) -> DataFrame:
    """One entry per page and role stays, by path; the others stand alone.

    A demoted thumbnail becomes a full page: it loses its role and the
    reduced-size file type that only described that role.
    """
    # An entry alone in its place stays; only places with more entries send their first one back to the rows.
    keep = skew.group_facts(
        entries.filter(F.col("group_id").isNotNull()), _MEMBER, F.min("path").alias("_keeper"), F.count(F.lit(1)).alias("_n"))
    marked = skew.attach(entries, keep.filter("_n > 1").drop("_n"), _MEMBER)
    placed = F.lit(True)
    for key in _MEMBER:
        placed &= F.col(key).isNotNull()
    alone = F.col("group_id").isNull() | (F.col("path") != F.when(placed, F.coalesce("_keeper", "path")))
    demoted_thumb = alone & F.col("is_thumb")
    return (
        marked.withColumn("standalone", F.coalesce(alone, F.lit(True)))
        .withColumn("subfiletype", F.when(
            demoted_thumb & (F.col("subfiletype") == 1), F.lit(0)).otherwise(F.col("subfiletype")))
        .withColumn("is_thumb", F.when(alone, F.lit(False)).otherwise(F.col("is_thumb")))
        .drop("_keeper"))


def _members(entries: DataFrame) -> DataFrame:
    return entries.filter(~F.col("standalone")) if "standalone" in entries.columns else entries


def main_page(entries: DataFrame) -> DataFrame:
    """The page a document is named after, one row per group.

    Real page 0, else the lowest real page, else the lowest page.
    """
    return skew.group_facts(_members(entries), KEYS, *_main_page())


def _main_page() -> list[Column]:
    order = F.struct("is_thumb", "page", "path")
    return [F.min_by("path", order).alias("main_path"), F.min_by("page", order).alias("main_page"),
            F.min_by("is_thumb", order).alias("main_is_thumb")]


def _naming_path(grouped, extension: str | None = None):
    """Strip a page suffix the split itself generated, never one of the original name."""
    stem = P.stem_of(P.file_name("main_path"))
    parsed = P.parse_page_name(stem)
    generated = (
        ((F.col("main_page") > 0) & (parsed["page"] == F.col("main_page")))
        | (parsed["is_thumb"] & F.col("main_is_thumb")))
    tail = F.regexp_extract(P.file_name("main_path"), r".(\.[^.]+)$", 1)
    bare = P.join_path(P.parent("main_path"), F.concat(parsed["stem"], tail))
    return F.when(grouped & generated & (parsed["stem"] != ""), bare).otherwise(F.col("main_path"))


def assemble_groups(entries: DataFrame) -> DataFrame:
    """A2: every member with its document's main page, name and size.

    Rows, not lists: page order is the ``page`` column, so a document with
    very many members is never gathered into one value.
    """
    members = _members(entries)
    return skew.attach(members, documents(members), KEYS)


def documents(members: DataFrame, *more: Column) -> DataFrame:
    """A2, one row per document: its main page, size and naming path, and ``more`` aggregates."""
    facts = skew.group_facts(members, KEYS, *_main_page(), F.count(F.lit(1)).alias("members"), *more)
    return facts.withColumn("naming_path", _naming_path(F.col("members") > 1)).drop("main_page", "main_is_thumb")


def group_status(entries: DataFrame) -> DataFrame:
    """A3: complete / truncated / inconsistent / fragment / overfull per group.

    A gap in the page numbers alone is not a missing page.
    """
    facts = _members(entries).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("members"), *status_facts())
    return facts.select(
        *KEYS, "members", F.when(F.col("_low") == F.col("_high"), F.col("_high")).alias("declared"),
        status_of().alias("status"))


def status_facts() -> list[Column]:
    """The aggregates that A3 decides on, beside the number of ``members``."""
    declared = F.nullif(F.col("declared"), F.lit(0))
    return [F.min(declared).alias("_low"), F.max(declared).alias("_high"), F.min("page").alias("_first")]


def status_of() -> Column:
    return (
        F.when(F.col("_low") != F.col("_high"), F.lit("inconsistent"))
        .when(F.col("members") < F.col("_high"), F.lit("truncated"))
        .when(F.col("members") > F.col("_high"), F.lit("overfull"))
        .when(F.col("_high").isNull() & (F.col("members") == 1) & (F.col("_first") != 0),
              F.lit("fragment"))
        .otherwise(F.lit("complete")))


def split_by_content(entries: DataFrame) -> DataFrame:
    """A4: settle groups that hold more members than the split recorded.

    Exactly one content bucket of the recorded size, no page repeated: its
    members are the group, the rest are orphans.  Otherwise the whole group is
    a conflict and every member stands alone.
    """
    members = _members(entries)
    declared = F.nullif(F.col("declared"), F.lit(0))
    buckets = members.groupBy(*KEYS, "content_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("page", "is_thumb").alias("_pages"),
        F.min(declared).alias("_low"), F.max(declared).alias("_high"))
    groups = buckets.groupBy(*KEYS).agg(
        F.sum("_n").alias("_members"), F.min("_low").alias("_low"), F.max("_high").alias("_size"),
        F.count_if(F.col("content_id").isNull()).alias("_blind"))
    over = (F.col("_low") == F.col("_size")) & (F.col("_members") > F.col("_size"))
    groups = groups.filter(over)  # all others are members whatever their buckets say
    full = (F.col("_n") == F.col("_size")) & F.col("content_id").isNotNull()
    complete = (
        skew.attach(buckets.select(*KEYS, "content_id", "_n", "_pages"), groups, KEYS, "inner")
        .groupBy(*KEYS).agg(
            F.max("_members").alias("_members"), F.max("_size").alias("_size"),
            F.min("_low").alias("_low"), F.max("_blind").alias("_blind"),
            F.count_if(full).alias("_full"),
            F.max(F.when(full, F.col("content_id"))).alias("_kept"),
            F.max(F.when(full, F.col("_pages") == F.col("_n"))).alias("_clean")))
    joined = skew.attach(members, complete, KEYS)
    settled = (F.col("_blind") == 0) & (F.col("_full") == 1) & F.col("_clean")
    role = (
        F.when(~F.coalesce(over, F.lit(False)), F.lit("member"))
        .when(~F.coalesce(settled, F.lit(False)), F.lit("conflict"))
        .when(F.col("content_id") == F.col("_kept"), F.lit("member"))
        .otherwise(F.lit("orphan")))
    return (
        joined.withColumn("role", role)
        .drop("_members", "_size", "_low", "_blind", "_full", "_kept", "_clean"))


def mixed_versions(entries: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """A5: truncated groups that together are one complete split.

    Several truncated groups in one folder and stem, one content id
    throughout, disjoint pages, together exactly the recorded size.
    One row per (folder, stem) cluster.
    """
    members = _members(entries)
    status = group_status(entries) if statuses is None else statuses
    stem = P.parse_page_name(P.stem_of(P.file_name("path")))["stem"]
    named = members.withColumn("stem", stem)
    stems = skew.group_facts(named, KEYS, F.min("stem").alias("_a"), F.max("stem").alias("_b"))
    usable = (
        status.filter((F.col("status") == "truncated") & F.col("declared").isNotNull())
        .select(*KEYS, F.col("declared").alias("_size"))
        .join(stems.filter(F.col("_a") == F.col("_b")), KEYS).select(*KEYS, "_size"))
    inside = skew.attach(named, usable, KEYS, "inner")
    clusters = inside.groupBy("folder", "stem").agg(
        F.count_distinct("group_id").alias("groups"), F.count(F.lit(1)).alias("pages"),
        F.count_distinct("page", "is_thumb").alias("_distinct"),
        F.min("_size").alias("_low"), F.max("_size").alias("declared"),
        F.min("content_id").alias("_first"), F.max("content_id").alias("_last"),
        F.count_if(F.col("content_id").isNull()).alias("_blind"))
    return clusters.filter(
        (F.col("groups") >= 2) & (F.col("_low") == F.col("declared"))
        & (F.col("_blind") == 0) & (F.col("_first") == F.col("_last"))
        & (F.col("_distinct") == F.col("pages")) & (F.col("pages") == F.col("declared"))
    ).select("folder", "stem", "groups", "pages", "declared")


def group_content_id(entries: DataFrame, digest: str = "digest") -> DataFrame:
    """Identity of a document's bytes, from its pages' digests in page order.

    One entry per page and role takes part (W1), so the gathered list is
    bounded by the page numbers a document can have, not by how many copies of
    its pages exist.
    """
    members = _members(entries)
    pages = members.groupBy(*KEYS, "page", "is_thumb").agg(F.min_by(digest, "path").alias("_d"))
    ordered = F.transform(
        F.sort_array(F.collect_list(F.struct("page", "is_thumb", "_d"))), lambda x: x["_d"])
    return pages.groupBy(*KEYS).agg(
        F.substring(F.sha2(F.unhex(F.array_join(ordered, "")), 256), 1, 16)
        .alias("group_content_id"), F.count(F.lit(1)).alias("pages"))


def split_group_id(plan: DataFrame, key: str = "path") -> DataFrame:
    """The id of a split, from its source and the page set it produces."""
    pages = plan.select(key, "page", "is_thumb").distinct()
    label = F.concat(
        F.col("page").cast("string"), F.when(F.col("is_thumb"), F.lit("t")).otherwise(F.lit("")))
    listed = F.transform(
        F.sort_array(F.collect_list(F.struct("page", "is_thumb", label.alias("label")))),
        lambda x: x["label"])
    return skew.group_facts(
        pages, [key], F.substring(F.sha2(F.concat(
            F.col(key), F.lit("|"), F.array_join(listed, ",")), 256), 1, 16).alias("split_id"))


def inherit_profile(pages: DataFrame, key: str = "path", profile: str = "profile") -> DataFrame:
    """A page without its own profile uses page 0's and says so."""
    first = pages.groupBy(key).agg(
        F.max(F.when(F.col("page") == 0, F.col(profile))).alias("_first"))
    own = F.col(profile)
    return (
        skew.attach(pages, first, [key])
        .withColumn("effective_profile", F.when(F.col("page") == 0, own)
                    .otherwise(F.coalesce(own, F.col("_first"))))
        .withColumn("inherited", own.isNull() & (F.col("page") != 0) & F.col("_first").isNotNull())
        .drop("_first"))


def group_veto(df: DataFrame, flag: str, name: str = "group_ok", keys=None) -> DataFrame:
    """Is a flag true for every member?  Rows outside a group decide alone."""
    keys = keys or KEYS
    facts = df.filter(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(
        F.min(F.coalesce(F.col(flag), F.lit(False))).alias(name))
    return skew.attach(df, facts, keys).withColumn(
        name, F.coalesce(F.col(name), F.col(flag), F.lit(False)))


def hold_groups(plan: DataFrame) -> DataFrame:
    """In place, one page that is not re-encoded holds its whole document."""
    runs = F.col("action").isin("convert", "copy")
    judged = plan.withColumn("_runs", runs)
    in_place = judged.filter(F.col("in_place") & F.col("group_id").isNotNull())
    facts = in_place.groupBy(*KEYS).agg(F.min("_runs").alias("_all_run"))
    held = (
        F.col("in_place") & F.col("_runs") & ~F.coalesce(F.col("_all_run"), F.lit(True)))
    return (
        skew.attach(judged, facts, KEYS)
        .withColumn("held", held)
        .withColumn("action", F.when(held, F.lit("skip")).otherwise(F.col("action")))
        .drop("_runs", "_all_run"))


def complete_sources(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Sources whose every planned output was written by this run."""
    # Planned and written outputs are told apart by bits and folded together: one exchange, no join.
    known = F.col("src").isNotNull() & F.col("dest").isNotNull()
    written = results.filter(F.col("status").isin("ok", "overwrite") & known)
    sides = plan.select("src", "dest", F.lit(1).alias("_side")).unionByName(written.select("src", "dest", F.lit(2).alias("_side")))
    return (
        sides.groupBy("src", "dest").agg(F.bit_or("_side").alias("_sides")).filter("_sides <> 2")
        .groupBy("src").agg(F.count_if(F.col("_sides") == 1).alias("_open"))
        .filter(F.col("_open") == 0).select("src"))


def stale_pages(assets: DataFrame, plan: DataFrame, results: DataFrame) -> DataFrame:
    """Pages an earlier split left beside an archive this run rewrote.

    ``assets``: output files with path, src_id, group_id, is_thumb (their
    records).  ``plan``: src, src_id, dest.  A leftover is named like a page of
    a completely written source, is not in the new layout, records this source
    and a group id the new pages do not have.
    """
    done = complete_sources(plan, results)
    current = skew.attach(plan, done, ["src"], "inner")
    owners = (
        current.select(
            "src", F.col("src_id"), P.parent("dest").alias("folder"),
            F.lower(P.stem_of(P.file_name("src"))).alias("stem")).distinct())
    left_over = skew.attach(
        assets.filter(F.col("group_id").isNotNull()), current.select(F.col("dest").alias("path")), ["path"], "left_anti")
    left_over = (
        left_over.withColumn("folder", P.parent("path"))
        .withColumn("stem", F.lower(P.parse_page_name(P.stem_of(P.file_name("path")))["stem"])))
    candidates = skew.attach(left_over, owners, ["folder", "stem", "src_id"], "inner")
    new_ids = (
        skew.attach(current, assets.select(F.col("path").alias("dest"), "group_id"), ["dest"], "inner")
        .filter(F.col("group_id").isNotNull()).select("src", "group_id").distinct())
    return (
        skew.attach(candidates, new_ids, ["src", "group_id"], "left_anti")
        .select("src", "path", "group_id",
                F.when(F.col("is_thumb"), F.lit("remove")).otherwise(F.lit("keep"))
                .alias("verdict")))


def adopt_group_ids(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """Which id the pages of a split must carry so an archive stays whole.

    ``plan``: one row per planned page with src, folder, stem, page, is_thumb,
    legacy_id, split_id, content_id.  ``existing``: path, group_id, srcsum,
    read_ok, pages.  Siblings must agree on one id and lie inside the planned
    page set; a moved split also needs its content proven.
    """
    role = F.struct("page", "is_thumb")
    sources = skew.group_facts(
        plan, ["src"], F.min("folder").alias("folder"), F.min(F.lower("stem")).alias("stem"),
        F.min("legacy_id").alias("_legacy"), F.min("split_id").alias("_split"),
        F.min("content_id").alias("_content"), F.collect_set(role).alias("_planned"))
    parsed = P.parse_page_name(P.stem_of(P.file_name("path")))
    # One row per (folder, stem) before the join, so many sources sharing a
    # name never meet many pages sharing it.
    siblings = (
        existing.withColumn("_p", parsed)
        .select(P.parent("path").alias("folder"), F.lower("_p.stem").alias("stem"),
                F.col("_p.page").alias("page"), F.col("_p.is_thumb").alias("is_thumb"),
                "group_id", "srcsum", "read_ok", "pages"))
    siblings = skew.group_facts(
        siblings, ["folder", "stem"],
            F.count(F.lit(1)).alias("siblings"), F.collect_set(role).alias("_present"),
            F.count_if(F.col("group_id").isNull()).alias("_unmarked"),
            F.min("group_id").alias("_low"), F.max("group_id").alias("_high"),
            F.count_if(~F.coalesce("read_ok", F.lit(False)) | F.col("srcsum").isNull())
            .alias("_unproven"),
            F.min("srcsum").alias("_sum_low"), F.max("srcsum").alias("_sum_high"),
            F.min("pages").alias("_pages_low"), F.max("pages").alias("_pages_high"))
    joined = skew.attach(sources, siblings, ["folder", "stem"], "inner")
    inside = F.size(F.array_except("_present", "_planned")) == 0
    agreed = inside & (F.col("_unmarked") == 0) & (F.col("_low") == F.col("_high"))
    proven = (
        (F.col("_unproven") == 0) & (F.col("_sum_low") == F.col("_sum_high"))
        & (F.col("_sum_low") == F.col("_content")))
    count = F.size("_planned")
    whole = F.col("_pages_low").isNull() | (
        (F.col("_pages_low") == count) & (F.col("_pages_high") == count))
    legacy = agreed & (F.col("_low") == F.col("_legacy"))
    moved = agreed & ~legacy & (F.col("_low") != F.col("_split")) & proven & whole
    return joined.filter(legacy | moved).select(
        "src", "siblings", F.col("_low").alias("group_id"),
        F.when(legacy, F.lit("legacy")).otherwise(F.lit("moved")).alias("why"))
