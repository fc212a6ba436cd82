"""Kinds, targets, page plans, actions, routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.config import DeriveConfig, PolicyConfig
from shelfmark.functions import records as R
from shelfmark.operators import groups, policy, report
from workload.registry import query

FACTS = """
    f AS (SELECT path, max(CASE WHEN page = 0 THEN software END) AS software,
        max(CASE WHEN page = 0 THEN icc_class END) AS icc, COALESCE(max(CASE WHEN page = 0 THEN bits END), 0) AS bits,
        COALESCE(bool_or(page = 0 AND camera), FALSE) AS camera,
        bool_or(subfiletype = 4 OR (samples IN (1, 2, 4) AND samples <> 1 AND extras NOT IN ('1', '2,0'))) AS ir,
        bool_or(page > 0 AND ((width = 160 AND height = 120) OR (width = 120 AND height = 160))) AS dcf
        FROM v_pages GROUP BY path),
    k AS (SELECT *, CASE WHEN contains(lower(COALESCE(software, '')), 'silverfast') THEN 'software' WHEN ir THEN 'ir'
        WHEN COALESCE(software, '') <> '' OR camera THEN NULL WHEN dcf THEN 'camera' ELSE 'guessed' END AS reason FROM f),
    kinds AS (SELECT *, CASE WHEN reason IN ('software', 'ir', 'guessed') THEN
        CASE WHEN ir OR icc = 'scnr' OR (icc IS NULL AND bits >= 16) THEN 'raw' ELSE 'final' END END AS kind FROM k)"""


def pages(s):
    return s.v_pages.withColumn(
        "extrasamples", F.transform(
            F.filter(F.split("extras", ","), lambda x: x != ""), lambda x: x.cast("int"))).withColumn(
                "is_thumb", F.col("subfiletype") == 1)


@query("thumbnail_pages", "P11", """
    SELECT path, page FROM v_pages WHERE page > 0 AND greatest(width, height) <= 160""")
def thumbnail_pages(s):
    return s.v_pages.filter(policy.is_thumbnail_page("page", "width", "height")).select("path", "page")


@query("source_reason", "P12", f"WITH {FACTS} SELECT path, reason AS scan_reason FROM kinds")
def source_reason(s):
    return policy.source_reason(pages(s))


@query("source_kind", "P13", f"WITH {FACTS} SELECT path, reason AS scan_reason, kind, bits FROM kinds")
def source_kind(s):
    return policy.source_kind(pages(s)).select("path", "scan_reason", "kind", "bits")


@query("assign_distance", "P15", f"""
    WITH {FACTS} SELECT path,
        CASE WHEN kind IS NOT NULL THEN 0.0 WHEN bits BETWEEN 1 AND 8 THEN 0.0 ELSE 0.1 END AS auto_distance,
        CASE WHEN kind = 'raw' THEN 0.02 WHEN kind IS NULL AND bits BETWEEN 1 AND 8 THEN 0.7 ELSE 1.0 END AS raw_distance
    FROM kinds""")
def assign_distance(s):
    kinds = policy.source_kind(pages(s))
    auto = PolicyConfig(distance=0.1)
    raw = PolicyConfig(distance=1.0, scan_distance=0.02, scan_scope="raw", eight_bit=0.7)
    return kinds.select("path", policy.assign_distance("kind", "bits", auto).alias("auto_distance"),
                        policy.assign_distance("kind", "bits", raw).alias("raw_distance"))


@query("kept_thumbnails_auto", "P16", f"""
    WITH {FACTS} SELECT path, page FROM v_pages JOIN kinds USING (path)
    WHERE subfiletype = 1 AND photometric IN (1, 2)
      AND NOT contains(lower(COALESCE(kinds.software, '')), 'capture one')""")
def kept_thumbnails_auto(s):
    return policy.kept_thumbnails(pages(s), PolicyConfig(thumbnail_mode="auto")).select("path", "page")


@query("kept_thumbnails_scans", "P16", f"""
    WITH {FACTS} SELECT path, page FROM v_pages JOIN kinds USING (path)
    WHERE subfiletype = 1 AND photometric IN (1, 2) AND kind IS NOT NULL""")
def kept_thumbnails_scans(s):
    return policy.kept_thumbnails(pages(s), PolicyConfig(thumbnail_mode="scans")).select("path", "page")


def _planned_sql(chosen: str) -> str:
    return f"""
    c AS ({chosen}),
    n AS (SELECT *, count(*) OVER (PARTITION BY path) AS planned,
                 bool_or(thumb) OVER (PARTITION BY path) AS any_thumb FROM c)
    SELECT path, page, thumb AS is_thumb, stem || CASE WHEN planned = 1 AND NOT any_thumb THEN ''
        ELSE CASE WHEN page > 0 THEN '_page' || CAST(page AS VARCHAR) ELSE '' END
             || CASE WHEN thumb THEN '_thumbnail' ELSE '' END END || '.jxl' AS output_name FROM n"""


def _planned(s, **cfg):
    return policy.plan_pages(pages(s), PolicyConfig(**cfg)).select("path", "page", "is_thumb", "output_name")


@query("plan_pages_split", "P17", f"""
    WITH {_planned_sql('SELECT path, page, stem, subfiletype = 1 AS thumb FROM v_pages')}""")
def plan_pages_split(s):
    return _planned(s, page_mode="split")


@query("plan_pages_scans", "P17", f"""
    WITH {FACTS}, {_planned_sql('''SELECT path, page, stem, subfiletype = 1 AS thumb FROM v_pages JOIN kinds USING (path)
        WHERE subfiletype <> 1 OR (kind IS NOT NULL AND photometric IN (1, 2))''')}""")
def plan_pages_scans(s):
    return _planned(s, page_mode="split", thumbnail_mode="scans")


@query("plan_pages_skip", "P17", f"""
    WITH q AS (SELECT *, subfiletype = 1 AS thumb, count(*) FILTER (subfiletype <> 1) OVER (PARTITION BY path) AS reals
        FROM v_pages), {_planned_sql('''SELECT path, page, stem, thumb FROM q
        WHERE (reals = 1 AND NOT thumb) OR (reals = 0 AND page = 0)''')}""")
def plan_pages_skip(s):
    return _planned(s, page_mode="skip")


@query("plan_pages_ignore", "P17", """
    SELECT path, page, FALSE AS is_thumb, stem || '.jxl' AS output_name FROM v_pages WHERE page = 0""")
def plan_pages_ignore(s):
    return _planned(s, page_mode="ignore")


@query("discarded_pages", "A23", """
    SELECT path, count(*) FILTER (subfiletype <> 1) AS real_dropped,
        count(*) FILTER (subfiletype = 1) AS thumbs_dropped, count(*) FILTER (subfiletype <> 1) > 0 AS undeletable
    FROM v_pages WHERE page > 0 GROUP BY path""")
def discarded_pages(s):
    every = pages(s)
    kept = policy.plan_pages(every, PolicyConfig(page_mode="ignore"))
    return report.discarded_pages(every, kept)


@query("split_group_ids", "A7", """
    SELECT path, left(sha256(path || '|' || string_agg(CAST(page AS VARCHAR)
        || CASE WHEN subfiletype = 1 THEN 't' ELSE '' END, ',' ORDER BY page)), 16) AS split_id
    FROM v_pages GROUP BY path""")
def split_group_ids(s):
    return groups.split_group_id(policy.plan_pages(pages(s), PolicyConfig()))


@query("inherit_profile", "W9", """
    WITH p AS (SELECT path, page, CASE WHEN page = 0 THEN icc_class WHEN photometric = 6 THEN 'own' END AS profile
               FROM v_pages),
    z AS (SELECT path, max(CASE WHEN page = 0 THEN profile END) AS first FROM p GROUP BY path)
    SELECT path, page, COALESCE(profile, CASE WHEN page > 0 THEN first END) AS effective_profile,
        profile IS NULL AND page > 0 AND first IS NOT NULL AS inherited
    FROM p JOIN z USING (path)""")
def inherit_profile(s):
    own = (F.when(F.col("page") == 0, F.col("icc_class"))
           .when(F.col("photometric") == 6, "own"))
    return groups.inherit_profile(s.v_pages.select("path", "page", own.alias("profile"))).select(
        "path", "page", "effective_profile", "inherited")


@query("unarchivable_content", "P41", """
    WITH t AS (SELECT path, page, CASE samples WHEN 1 THEN 37724 WHEN 2 THEN 50001 WHEN 4 THEN 34377 ELSE 100 END AS code,
        width * 10 AS size, CASE WHEN photometric = 6 THEN 32 ELSE bits END AS depth FROM v_pages),
    f AS (SELECT path, page, CASE WHEN code = 37724 THEN 0 WHEN code = 50001 AND size > 4096 THEN 1
        WHEN depth = 32 THEN 2 END AS step FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY page, step) AS rn FROM f WHERE step IS NOT NULL)
    SELECT path, ['layers', 'private tag too large', 'sample depth'][step + 1] AS unarchivable FROM r WHERE rn = 1""")
def unarchivable_content(s):
    code = (F.when(F.col("samples") == 1, 37724).when(F.col("samples") == 2, 50001)
            .when(F.col("samples") == 4, 34377).otherwise(100))
    depth = F.when(F.col("photometric") == 6, 32).otherwise(F.col("bits"))
    return policy.unarchivable(s.v_pages.select(
        "path", "page", code.alias("code"), F.lit(7).alias("type"), (F.col("width") * 10).alias("size"),
        F.array(F.lit(16), depth).alias("bits_per_sample")))


@query("output_depth", "P40", """
    SELECT path, 16 AS forced, COALESCE(depth, 16) AS original, CASE WHEN is_thumb AND depth = 8 THEN 8 ELSE 16 END
        AS thumbnails FROM v_entries""")
def output_depth(s):
    return s.v_entries.select(
        "path", policy.output_depth("depth", "is_thumb", "force16").alias("forced"),
        policy.output_depth("depth", "is_thumb", "preserve_original").alias("original"),
        policy.output_depth("depth", "is_thumb").alias("thumbnails"))


CLASSIFY = """CASE WHEN l_returnflag = 'R' THEN 'unknown'
        WHEN l_discount = 0 AND l_tax = 0 THEN CASE WHEN l_suppkey % 9 + 1 > l_linenumber THEN 'ok' ELSE 'downgrade' END
        WHEN CASE WHEN l_tax = 0 THEN 0 ELSE greatest(l_tax, 0.05) END
           > CASE WHEN l_discount = 0 THEN 0 ELSE greatest(l_discount, 0.05) END THEN 'ok' ELSE 'downgrade' END"""
ROW = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
ROWS = ROW.split(", ")


def _classified(s):
    d = F.when(F.col("l_returnflag") != "R", F.col("l_discount"))
    category = policy.classify_reencode(d, F.col("l_linenumber"), F.col("l_tax"), F.col("l_suppkey") % 9 + 1)
    return s.lineitem.withColumn("category", category)


@query("classify_reencode", "P19", f"SELECT {ROW}, {CLASSIFY} AS category FROM lineitem")
def classify_reencode(s):
    return _classified(s).select(*ROWS, "category")


ACTIONS = f"""
    c AS (SELECT *, {CLASSIFY} AS category, l_partkey % 5 = 0 AS jbrd, l_linenumber % 3 AS gen,
        CASE l_linestatus WHEN 'F' THEN 'jpeg' ELSE 'tiff16' END AS origin,
        CASE WHEN l_quantity > 40 THEN 'raw' WHEN l_quantity > 30 THEN 'final' END AS kind FROM lineitem),
    a AS (SELECT *, CASE WHEN jbrd THEN 'copy' WHEN category = 'ok' THEN 'convert' WHEN category = 'downgrade' THEN 'ask'
            ELSE 'convert' END AS base,
        CASE WHEN gen + CASE origin WHEN 'jpeg' THEN 1 ELSE 0 END >= 2 AND l_tax > 0 THEN 'ask' END AS regen,
        CASE WHEN kind = 'raw' AND l_tax > 0 THEN 'skip' END AS scan FROM c),
    acted AS (SELECT *, CASE WHEN scan = 'skip' THEN 'skip' WHEN base = 'copy' THEN 'copy'
        WHEN base = 'ask' OR regen = 'ask' THEN 'ask' ELSE 'convert' END AS action FROM a)"""


def _acted(s, **cfg):
    rows = _classified(s).withColumns({
        "has_jbrd": F.col("l_partkey") % 5 == 0, "gen": F.col("l_linenumber") % 3,
        "origin": F.when(F.col("l_linestatus") == "F", "jpeg").otherwise("tiff16"),
        "kind": F.when(F.col("l_quantity") > 40, "raw").when(F.col("l_quantity") > 30, "final")})
    return policy.resolve_action(
        rows, DeriveConfig(on_scan="skip", scan_scope="raw", **cfg), distance=F.col("l_tax"))


@query("resolve_action", "P20", f"""
    WITH {ACTIONS} SELECT {ROW}, action, array_to_string(list_filter([CASE WHEN jbrd THEN 'jbrd' END,
        CASE WHEN regen IS NOT NULL THEN 'regeneration' END, CASE WHEN scan IS NOT NULL THEN 'scan' END],
        lambda x: x IS NOT NULL), '+') AS guards FROM acted""")
def resolve_action(s):
    return _acted(s).select(*ROWS, "action", "guards")


@query("settle_actions", "P21", f"""
    WITH {ACTIONS} SELECT {ROW}, CASE action WHEN 'ask' THEN 'skip' ELSE action END AS action FROM acted""")
def settle_actions(s):
    return policy.settle_actions(_acted(s)).select(*ROWS, "action")


@query("settle_derived_actions", "P21", f"""
    WITH {ACTIONS} SELECT {ROW}, CASE WHEN l_discount > 0.08 THEN 'skip'
        WHEN action IN ('ask', 'copy', 'skip') AND NOT (action = 'skip' AND scan = 'skip' AND base <> 'copy'
            AND base <> 'ask' AND regen IS NULL) THEN 'skip' ELSE 'convert' END AS action FROM acted""")
def settle_derived_actions(s):
    # A derived copy is never held back as a film scan.
    rows = _acted(s, label="sRGB/d1e7").withColumn("thumb", F.col("l_discount") > 0.08)
    return policy.settle_actions(rows, derived=True, is_thumb="thumb").select(*ROWS, "action")


EXT = "['.tif', '.jpg', '.JPEG', '.png', '.jxl'][doc_id % 5 + 1]"


def routed(s):
    ext = F.element_at(F.array(*[F.lit(e) for e in (".tif", ".jpg", ".JPEG", ".png", ".jxl")]),
                       (F.col("doc_id") % 5 + 1).cast("int"))
    assets = s.documents.select("doc_id", "source", "lang", ext.alias("ext"), F.col("doc_id").alias("path"))
    boxes = s.labels.select(F.col("doc_id").alias("path"), (F.col("quality") == 1).alias("has_jbrd"))
    return assets, boxes


@query("route_assets", "P26", f"""
    SELECT doc_id, CASE lower({EXT}) WHEN '.jpg' THEN 'lossless' WHEN '.jpeg' THEN 'lossless' WHEN '.png' THEN 'convert'
        WHEN '.jxl' THEN CASE WHEN COALESCE(quality, 0) = 1 THEN 'recover' ELSE 'decode' END ELSE 'error' END AS route
    FROM documents LEFT JOIN labels USING (doc_id)""")
def route_assets(s):
    return policy.route_assets(*routed(s)).select("doc_id", "route")


@query("route_forced", "P26", f"""
    SELECT doc_id, CASE {EXT} WHEN '.jxl' THEN 'recover' ELSE 'lossless' END AS transcode,
        CASE {EXT} WHEN '.jxl' THEN 'decode' ELSE 'convert' END AS convert FROM documents""")
def route_forced(s):
    assets, boxes = routed(s)
    first = policy.route_assets(assets, boxes, "transcode").withColumnRenamed("route", "transcode")
    return policy.route_assets(first, None, "convert").select(
        "doc_id", "transcode", F.col("route").alias("convert"))


@query("one_direction", "P39", f"""
    SELECT doc_id, 'deleting' AS run FROM documents WHERE {EXT} <> '.jxl'
    UNION ALL SELECT doc_id, 'decode' FROM documents WHERE {EXT} = '.jxl'
    UNION ALL SELECT doc_id, 'jpeg' FROM documents WHERE {EXT} <> '.png'""")
def one_direction(s):
    plan = policy.route_assets(*routed(s))
    runs = {
        "deleting": policy.one_direction(plan, True),
        "decode": policy.one_direction(plan, True, only="from_jxl"),
        "jpeg": policy.one_direction(plan, False, only="from_jpeg")}
    return report.union_plans(*[
        df.select("doc_id", F.lit(name).alias("run")) for name, df in runs.items()])


@query("union_routes", "X3", f"""
    SELECT route, count(*) AS assets, count(DISTINCT source) AS sources FROM (SELECT source, CASE lower({EXT}) WHEN '.jpg' THEN 'lossless'
        WHEN '.jpeg' THEN 'lossless' WHEN '.png' THEN 'convert' WHEN '.jxl' THEN CASE WHEN COALESCE(quality, 0) = 1 THEN 'recover'
        ELSE 'decode' END ELSE 'error' END AS route FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY route""")
def union_routes(s):
    """Every route's plan, with the columns it has; one without a column brings NULL."""
    plan = policy.route_assets(*routed(s))
    parts = [plan.filter(F.col("route") == r) for r in ("lossless", "convert", "recover", "decode", "error")]
    parts[1] = parts[1].drop("lang").withColumn("quality_asked", F.lit(90))
    return report.union_plans(*parts).groupBy("route").agg(
        F.count(F.lit(1)).alias("assets"), F.count_distinct("source").alias("sources"))


@query("decode_is_lossy", "P37", """
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'animation' WHEN '2-HIGH' THEN 'float samples'
        WHEN '3-MEDIUM' THEN CASE WHEN o_orderstatus = 'F' THEN '24-bit samples' END END AS reduced,
        CASE o_orderpriority WHEN '2-HIGH' THEN 'float samples'
        WHEN '3-MEDIUM' THEN CASE WHEN o_orderstatus = 'F' THEN '24-bit samples' END END AS reduced_with_frames
    FROM orders""")
def decode_is_lossy(s):
    p = F.col("o_orderpriority")
    info = (
        F.when(p == "1-URGENT", F.concat(F.lit("box\nJPEG XL animation, 10x10, lossy, 8-bit RGB")))
        .when(p == "2-HIGH", "JPEG XL image, 10x10, lossless, 32-bit float RGB")
        .when((p == "3-MEDIUM") & (F.col("o_orderstatus") == "F"), "JPEG XL image, 9x9, 24-bit Gray\nmore")
        .when(p == "3-MEDIUM", "JPEG XL image, 9x9, 16-bit Gray")
        .otherwise("no answer, 32-bit float"))
    return s.orders.select("o_orderkey", policy.decode_is_lossy(info).alias("reduced"),
                           policy.decode_is_lossy(info, True).alias("reduced_with_frames"))


@query("keep_reasons", "P38", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE
        WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'lossy jpeg decode'
             WHEN l_linenumber < 4 THEN 'png below 16 bits' WHEN l_tax > 0.05 THEN 'reduced samples' END
        WHEN l_returnflag = 'A' AND l_suppkey % 3 <> 0 AND l_discount > 0.05 THEN 'gain map not carried' END AS keep
    FROM lineitem""")
def keep_reasons(s):
    from_jxl, png = F.col("l_returnflag") == "R", F.col("l_linestatus") != "F"
    src = F.when(from_jxl, ".jxl").when(F.col("l_returnflag") == "A", ".JPG").otherwise(".png")
    dst = F.when(from_jxl & png, ".png").when(from_jxl, ".jpg").otherwise(".jxl")
    return s.lineitem.select(*ROWS, policy.keep_reason(
        src, dst, F.when(F.col("l_linenumber") < 4, 8).otherwise(16),
        F.when(F.col("l_discount") > 0.05, "Ultra HDR"), F.col("l_suppkey") % 3 == 0,
        F.when(F.col("l_tax") > 0.05, "float samples")).alias("keep"))


@query("hold_groups", "J17", f"""
    WITH {ACTIONS}, g AS (SELECT *, CASE action WHEN 'ask' THEN 'skip' ELSE action END AS act,
        bool_and(action IN ('convert', 'copy')) OVER (PARTITION BY l_linestatus, l_orderkey) AS whole FROM acted)
    SELECT {ROW}, act IN ('convert', 'copy') AND NOT whole AS held,
        CASE WHEN act IN ('convert', 'copy') AND NOT whole THEN 'skip' ELSE act END AS action FROM g""")
def hold_groups(s):
    plan = policy.settle_actions(_acted(s)).withColumns({
        "in_place": F.lit(True), "folder": F.col("l_linestatus"), "group_id": F.col("l_orderkey")})
    return groups.hold_groups(plan).select(*ROWS, "held", "action")


@query("encode_facts", "A8 A9 W3", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' THEN 2.0
             WHEN l_returnflag = 'R' OR (l_returnflag = 'A' AND l_linestatus = 'F') THEN l_tax ELSE -1.0 END AS recorded_d
    FROM lineitem""")
def encode_facts(s):
    rows = s.v_records.withColumn("history", F.array("history"))
    out = policy.encode_facts(rows, "description", "software", "history")
    return out.select(*ROWS, F.coalesce("recorded_d", F.lit(-1.0)).alias("recorded_d"))


@query("history_arrays", "W3", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        CASE WHEN contains(history, 'gen=1') THEN 'gen=1' || split_part(history, 'gen=1', 2) ELSE '' END AS record
    FROM v_records""")
def history_arrays(s):
    # An older entry with a record must not come back past a deliberate stop.
    old = F.when(F.col("history").contains("no encode"), "x: from a/b to c/d | gen=4 | cjxl d=1 e=7")
    values = F.array_compact(F.array(old, F.col("history"), F.lit("editor")))
    staged = s.v_records.select(*ROWS, R.settling_entry(values).alias("entry"))
    return staged.select(*ROWS, R.record_or_stop("entry").alias("record"))
