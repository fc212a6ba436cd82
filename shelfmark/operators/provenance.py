"""Who made which output, and what that proves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import fixed_values as fv
from shelfmark import skew
from shelfmark.functions.recipes import quality_recipe_changed, rederive_reason


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _same(a: Column, b: Column) -> Column:
    return F.coalesce((a == b) & (a != ""), F.lit(False))


def matches(src, srcsum, path_id, content_id, mode: str = "path") -> Column:
    """The output records this source -- by location, or by bytes as well."""
    located = _same(_col(src), _col(path_id))
    if mode != "content":
        return located
    return located | _same(_col(srcsum), _col(content_id))


def proves(src, srcsum, path_id, content_id, mode: str = "path") -> Column:
    """J4 and the recorded bytes equal the source as it is now."""
    return matches(src, srcsum, path_id, content_id, mode) & _same(_col(srcsum), _col(content_id))


def provenance_ok(pairs: DataFrame, mode: str = "path") -> DataFrame:
    """J4 over (source, output) pairs already joined on the destination."""
    return pairs.withColumn(
        "provenance_ok", matches("src", "srcsum", "path_id", "content_id", mode))


def proves_archive(pairs: DataFrame, mode: str = "path") -> DataFrame:
    """The pairs whose output proves the source's current bytes."""
    return pairs.filter(proves("src", "srcsum", "path_id", "content_id", mode))


def guard_verdict(mode: str, strict, guard, has_jbrd: Column, broken: Column) -> Column:
    """The J6 decision as 'verdict|reason' over joined record columns."""
    marked = (F.coalesce(F.col("src"), F.lit("")) != "") | (
        F.coalesce(F.col("srcsum"), F.lit("")) != "")
    unread = ~F.coalesce(F.col("read_ok"), F.lit(False))
    ok = matches("src", "srcsum", "path_id", "content_id", mode)
    strict = F.lit(strict) if isinstance(strict, bool) else strict
    guard = F.lit(guard) if isinstance(guard, bool) else guard
    adopt = F.lit(mode == "adopt")

    def refuse(reason: str) -> Column:
        return F.concat(F.lit("refuse|"), F.when(broken, F.lit("damaged output")).otherwise(
            F.lit(reason)))

    plain = (
        F.when(marked & ok, F.lit("allow|"))
        .when(marked & ~guard, F.lit("warn|different source"))
        .when(marked, refuse("different source"))
        .when(unread & guard, refuse("record unread"))
        .when(has_jbrd, refuse("lossless archive"))
        .when(unread, F.lit("warn|record unread"))
        .otherwise(F.lit("allow|")))
    tight = (
        F.when(ok, F.lit("allow|"))
        .when(unread, refuse("record unread"))
        .when(~marked & adopt, F.lit("verify|unmarked output"))
        .when(~marked, refuse("unmarked output"))
        .otherwise(refuse("different source")))
    return F.when(strict, tight).otherwise(plain)


def judge_overwrites(joined: DataFrame, mode: str = "path", strict: bool | Column = False,
                     guard: bool = True) -> DataFrame:
    """J6 over a plan already joined to its outputs' records on the destination."""
    strict_col = F.lit(strict) if isinstance(strict, bool) else strict
    judged = (F.col("sync") != "write") & (strict_col | (F.col("sync") == "overwrite"))
    verdict = guard_verdict(
        mode, strict_col, guard, F.coalesce(F.col("has_jbrd"), F.lit(False)),
        F.coalesce(F.col("broken"), F.lit(False)))
    both = F.split(F.when(judged, verdict).otherwise(F.lit("allow|")), r"\|")
    return (
        joined.withColumn("_both", both)
        .withColumn("verdict", F.get("_both", F.lit(0)))
        .withColumn("reason", F.nullif(F.get("_both", F.lit(1)), F.lit("")))
        .drop("_both"))


def overwrite_guard(plan: DataFrame, meta: DataFrame, boxes: DataFrame | None = None,
                    mode: str = "path", strict: bool | Column = False,
                    guard: bool = True) -> DataFrame:
    """May a planned write land on what exists at its destination?

    ``plan``: dest, path_id, content_id, sync.  ``meta``: dest, src, srcsum,
    read_ok.  ``boxes``: dest, has_jbrd, broken; left out when ``meta`` has
    them.  Rows that write nothing are only judged by the strict form, which
    certifies every existing output.
    """
    if boxes is None:
        joined = plan.join(
            meta.select("dest", "src", "srcsum", "read_ok", "has_jbrd", "broken"), "dest", "left")
    else:
        joined = (
            plan.join(meta.select("dest", "src", "srcsum", "read_ok"), "dest", "left")
            .join(boxes.select("dest", "has_jbrd", "broken"), "dest", "left"))
    return judge_overwrites(joined, mode, strict, guard)


def judge_derivatives(joined: DataFrame, wanted, check_encode: bool = True,
                      lower_effort: bool = False, by_quality: bool = False) -> DataFrame:
    """J7 over a plan already joined to its outputs' labels (derived, read_ok)."""
    wanted = F.lit(wanted) if isinstance(wanted, str) else wanted
    found = F.col("sync") != "write"
    foreign = ~F.coalesce(F.col("read_ok"), F.lit(False)) | F.col("derived").isNull()
    why = (
        F.when(quality_recipe_changed("derived", wanted), F.lit("derivative recipe changed"))
        if by_quality else rederive_reason("derived", wanted, check_encode, lower_effort))
    return (
        joined.withColumn("_why", why)
        .withColumn("verdict", F.when(found & foreign, F.lit("refuse"))
                    .when(found & F.col("_why").isNotNull(), F.lit("rederive"))
                    .otherwise(F.col("sync")))
        .withColumn("reason", F.when(found & foreign, F.lit("not a derived copy"))
                    .when(found, F.col("_why")))
        .drop("_why"))


def derivative_guard(plan: DataFrame, labels: DataFrame, wanted, check_encode: bool = True,
                     lower_effort: bool = False, by_quality: bool = False) -> DataFrame:
    """A derived copy only ever replaces a derived copy.

    ``labels``: dest, derived, read_ok for existing outputs.
    """
    joined = plan.join(labels.select("dest", "derived", "read_ok"), "dest", "left")
    return judge_derivatives(joined, wanted, check_encode, lower_effort, by_quality).drop("read_ok")


def restamp_moved(plan: DataFrame, meta: DataFrame) -> DataFrame:
    """Outputs whose recorded location is stale but whose bytes agree.

    ``plan``: path, dest, path_id, content_id (first source per destination is
    judged); only existing outputs (rows of ``meta``) take part.
    """
    first = skew.top_rows(plan, ["dest"], [F.col("path")], 1).drop("_rank")
    joined = first.join(meta.select("dest", "src", "srcsum", "read_ok"), "dest")
    marked = F.col("src").isNotNull() | F.col("srcsum").isNotNull()
    state = (
        F.when(_same(F.col("src"), F.col("path_id")), F.lit("already"))
        .when(~F.coalesce(F.col("read_ok"), F.lit(False)), F.lit("unread"))
        .when(~marked, F.lit("unmarked"))
        .when(_same(F.col("srcsum"), F.col("content_id")), F.lit("restamp"))
        .otherwise(F.lit("differs")))
    return joined.withColumn("state", state)


def restamp_counts(restamped: DataFrame) -> DataFrame:
    return restamped.groupBy("state").agg(F.count(F.lit(1)).alias("outputs"))


def checksum_binding(pairs: DataFrame, journal: DataFrame, need_self_hash: bool = True) -> DataFrame:
    """Is the journal line for an archive the proof of this very file?

    ``pairs``: folder, name, source_md5, archive_md5.  ``journal``: folder,
    name, md5, already reduced to the line that counts (the last one).
    """
    lines = journal.select("folder", "name", F.col("md5").alias("journal_md5"))
    selves = (
        journal.filter(F.col("name").endswith(fv.SELF_HASH_SUFFIX))
        .select("folder",
                F.expr(f"substring(name, 1, length(name) - {len(fv.SELF_HASH_SUFFIX)})").alias("name"),
                F.col("md5").alias("self_md5")))
    joined = pairs.join(lines, ["folder", "name"], "left").join(selves, ["folder", "name"], "left")
    state = (
        F.when(F.col("journal_md5").isNull(), F.lit("not recorded"))
        .when(~_same(F.col("journal_md5"), F.col("source_md5")), F.lit("source differs")))
    if need_self_hash:
        state = (
            state.when(F.col("self_md5").isNull(), F.lit("archive not recorded"))
            .when(~_same(F.col("self_md5"), F.col("archive_md5")), F.lit("archive replaced")))
    return joined.withColumn("binding", state.otherwise(F.lit("proven")))


def edited_since(meta: DataFrame, digests: DataFrame, key: str = "dest") -> DataFrame:
    """Does a restored file still hold the pixels that were written?

    ``meta``: dest, pixsum ('<pages>:<md5>'), read_ok.  ``digests``: dest,
    page_count, digest of the first recorded pages.  Without a recorded sum the
    file is judged as before it existed; anything unreadable counts as edited.
    """
    joined = meta.join(digests, key, "left")
    pages = F.get(F.split(F.col("pixsum"), ":"), F.lit(0)).try_cast("int")
    why = (
        F.when(~F.coalesce(F.col("read_ok"), F.lit(False)), F.lit("record unread"))
        .when(F.col("pixsum").isNull(), F.lit(None).cast("string"))
        .when(F.col("digest").isNull(), F.lit("pixels unread"))
        .when(F.coalesce(pages < 1, F.lit(True)) | (F.col("page_count") < pages),
              F.lit("page count changed"))
        .when(F.col("digest") != F.col("pixsum"), F.lit("pixels changed")))
    return joined.withColumn("edited", why)
