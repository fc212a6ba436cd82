"""Lossless transcodes, recoveries and conversions in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.config import layout_for
from shelfmark.functions import paths as P
from shelfmark.operators import layout, policy, provenance, report
from shelfmark.functions.recipes import quality_recipe_changed
from shelfmark.plans.archive import meet_outputs

EXACT, LOSSY = ("lossless", "recover"), ("convert", "decode")
#: What the records of existing outputs tell; an output that has none was not looked at.
RECORDS = {"src": "string", "srcsum": "string", "read_ok": "boolean", "out_jbrd": "boolean", "broken": "boolean", "derived": "string"}


def rules(provenance_mode: str = "path", guard: bool = True, label: str | None = None) -> list[tuple[tuple[str, ...], str, Column, Column]]:
    """The ordered checks of every route: (routes, verdict, reason, condition).  The first that holds decides; none: allow.

    Bit-exact routes are bound by the checksum journal (J11).  Conversions are
    guarded like any other output (J6); with ``label``, a derived copy only ever
    replaces a derived copy (J7).
    """
    over, found = F.col("sync") == "overwrite", F.col("sync") != "write"
    bound = F.col("binding")
    unread = ~F.coalesce("read_ok", F.lit(False))
    out = [(EXACT, "refuse", bound, over & bound.isin("source differs", "archive replaced")),
           (EXACT, "verify", bound, over & (bound == "not recorded"))]
    if label is not None:
        return out + [
            (LOSSY, "refuse", F.lit("not a derived copy"), found & (unread | F.col("derived").isNull())),
            (LOSSY, "rederive", F.lit("derivative recipe changed"), found & F.coalesce(
                quality_recipe_changed("derived", F.lit(label)), F.lit(True)))]
    judged = F.split(provenance.guard_verdict(
        provenance_mode, False, guard, F.coalesce("out_jbrd", F.lit(False)), F.coalesce("broken", F.lit(False))), r"\|")
    return out + [(LOSSY, verdict, F.get(judged, F.lit(1)), over & (F.get(judged, F.lit(0)) == verdict)) for verdict in ("refuse", "warn")]


def decided(plan: DataFrame, checks: list[tuple[tuple[str, ...], str, Column, Column]]) -> DataFrame:
    """``plan`` with verdict and reason of the first check that holds for a row's route."""
    hits = [(F.col("route").isin(*routes) & F.coalesce(test, F.lit(False)), verdict, reason) for routes, verdict, reason, test in checks]
    pick = lambda value: reduce(
        lambda rest, hit: F.when(hit[0], value(hit)).otherwise(rest), reversed(hits), F.lit(None).cast("string"))
    return plan.withColumns({"verdict": F.coalesce(pick(lambda h: F.lit(h[1])), F.lit("allow")), "reason": pick(lambda h: h[2])})


def _route_plan(routed: DataFrame, routes: tuple[str, ...], direction: str, mode, root: str,
                rename: tuple[str, str] | None) -> DataFrame:
    where = layout_for(direction, root=root)
    picked = routed.filter(F.col("route").isin(*routes)).withColumn("direction", F.lit(direction))
    if direction == "encode":
        picked = picked.filter(~P.is_excluded(P.folder_parts("path"), where.skip_names, root))
    planned = layout.planned_destinations(picked, mode, where)
    if rename is not None:
        # A bit-exact recovery keeps the original name.
        convert = F.col("route").isin("convert", "decode")
        renamed = P.join_path(P.parent("dest"), P.apply_rename(P.file_name("dest"), *rename))
        planned = planned.withColumn(
            "dest", F.when(convert, renamed).otherwise(F.col("dest")))
    return planned


def plan_transcode(assets: DataFrame, boxes: DataFrame, existing: DataFrame, journal: DataFrame,
                   mode, root: str = "/", deletes: bool = False, decode_asked: bool = False,
                   force: str | None = None, overwrite: str = "smart",
                   rename: tuple[str, str] | None = None, guard: bool = True,
                   label: str | None = None) -> DataFrame:
    """Every route planned, united, checked and synced.

    ``assets``: path, ext, mtime, md5 (and content_id).  ``boxes``: path, has_jbrd.
    ``existing``: dest, out_mtime, out_md5 and what is known of the outputs: src,
    srcsum, read_ok, out_jbrd, broken, derived.  What is missing of these was not
    read.  ``journal``: folder, name, md5.  ``label``: the recipe of derived copies.
    """
    for name, kind in RECORDS.items():
        if name not in existing.columns:
            existing = existing.withColumn(name, F.lit(None).cast(kind))
    routed = policy.route_assets(assets, boxes, force)
    plan = report.union_plans(
        _route_plan(routed, ("lossless", "convert"), "encode", mode, root, rename),
        _route_plan(routed, ("recover", "decode"), "decode", mode, root, rename))
    plan = policy.one_direction(plan, deletes, decode_asked)
    plan = meet_outputs(plan, existing, overwrite)
    # The journal lies beside the archive: the output when encoding, else the source.
    encodes: Column = F.col("direction") == "encode"
    archive = F.when(encodes, F.col("dest")).otherwise(F.col("path"))
    pairs = (
        plan.withColumn("folder", P.parent(archive)).withColumn("name", P.file_name(archive))
        .withColumn("source_md5", F.when(encodes, F.col("md5")).otherwise(F.col("out_md5")))
        .withColumn("archive_md5", F.when(encodes, F.col("out_md5")).otherwise(F.col("md5"))))
    bound = provenance.checksum_binding(pairs, journal)
    content = F.col("content_id") if "content_id" in bound.columns else F.lit(None).cast("string")
    known = bound.withColumns({"path_id": P.path_id("path"), "content_id": content})
    return decided(known, rules("content" if "content_id" in bound.columns else "path", guard, label)).select(
        "path", "route", "direction", "dest", "collides", "sync", "verdict", "reason")
