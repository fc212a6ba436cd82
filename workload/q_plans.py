"""Whole decision pipelines and removal gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.config import DeriveConfig, GateConfig, PolicyConfig, layout_for
from shelfmark.functions import paths as P
from shelfmark.functions import scalars as S
from shelfmark.operators import policy
from shelfmark.plans import archive, derive, gates, restore, transcode
from workload.q_groups import STATUS
from workload.q_policy import EXT, FACTS, _planned_sql, pages
from workload.registry import query

# -- archive --------------------------------------------------------------------

EXISTING = """e AS (SELECT '/scan/JXL_16bits/' || output_name AS dest, o_orderstatus <> 'P' AS found,
        CASE o_orderstatus WHEN 'F' THEN o_custkey + 1 ELSE o_custkey - 1 END AS out_mtime,
        o_totalprice <= 300000 AS own, o_orderpriority = '5-LOW' AS same, o_orderpriority <> '3-MEDIUM' AS read_ok,
        o_custkey, p.path, p.page, p.is_thumb FROM planned p JOIN v_pages g USING (path, page)
        JOIN orders ON o_orderkey = g.source_id)"""


def _archive(s):
    key = F.col("o_orderkey").cast("string")
    path = F.concat(F.lit("/scan/o"), key, F.lit(".tif"))
    assets = s.orders.select(path.alias("path"), F.col("o_custkey").alias("mtime"), S.content_id(key).alias("content_id"))
    named = policy.plan_pages(pages(s), PolicyConfig())
    rec = s.orders.filter("o_orderstatus <> 'P'").select(
        path.alias("path"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") + 1).otherwise(F.col("o_custkey") - 1).alias("out_mtime"),
        P.path_id(F.when(F.col("o_totalprice") <= 300000, path).otherwise(F.lit("/other"))).alias("src"),
        S.content_id(F.when(F.col("o_orderpriority") == "5-LOW", key).otherwise(F.lit("x"))).alias("srcsum"),
        (F.col("o_orderpriority") != "3-MEDIUM").alias("read_ok"),
        F.lit(False).alias("has_jbrd"), F.lit(False).alias("broken"))
    have = named.join(rec, "path").select(
        F.concat(F.lit("/scan/JXL_16bits/"), "output_name").alias("dest"), "out_mtime", "src", "srcsum", "read_ok",
        "has_jbrd", "broken")
    return archive.plan_archive(assets, pages(s), have, 3, PolicyConfig(distance=0.1))


ARCHIVE = f"""{_planned_sql('SELECT path, page, stem, subfiletype = 1 AS thumb FROM v_pages')}"""


@query("plan_archive", "D1", f"""
    WITH {FACTS}, planned AS (WITH {ARCHIVE}), {EXISTING}
    SELECT e.path, page, is_thumb, dest, kind, CASE WHEN kind IS NOT NULL OR bits BETWEEN 1 AND 8 THEN 0.0 ELSE 0.1 END AS distance,
        FALSE AS collides, CASE WHEN NOT found THEN 'write' WHEN o_custkey <= out_mtime THEN 'skip'
        WHEN same AND read_ok THEN 'skip' ELSE 'overwrite' END AS sync,
        CASE WHEN found AND o_custkey > out_mtime AND NOT (same AND read_ok) AND NOT own THEN 'refuse' ELSE 'allow' END AS verdict
    FROM e JOIN kinds USING (path)""")
def plan_archive(s):
    return _archive(s).select(
        "path", "page", "is_thumb", "dest", "kind", "distance", "collides", "sync", "verdict")


@query("archive_refused", "D1 A1", f"""
    WITH {FACTS}, planned AS (WITH {ARCHIVE}), {EXISTING}
    SELECT count(*) AS collisions, CAST(COALESCE(sum(n), 0) AS BIGINT) AS colliding_sources, count(*) > 0 AS refused
    FROM (SELECT dest, count(*) AS n FROM e GROUP BY dest HAVING count(*) > 1)""")
def archive_refused(s):
    return archive.archive_refused(_archive(s))


# -- restore -----------------------------------------------------------------------

SETTLED = f"""{STATUS}, b AS (SELECT folder, group_id, content_id, count(*) AS n FROM m GROUP BY ALL),
    f AS (SELECT folder, group_id, count(*) FILTER (content_id IS NOT NULL AND n = hi) AS full_n,
        count(*) FILTER (content_id IS NULL) AS blind, max(CASE WHEN n = hi THEN content_id END) AS kept
        FROM b JOIN st USING (folder, group_id) GROUP BY folder, group_id),
    roles AS (SELECT m.*, CASE WHEN status <> 'overfull' THEN 'member' WHEN blind > 0 OR full_n <> 1 THEN 'conflict'
        WHEN content_id = kept THEN 'member' ELSE 'orphan' END AS role
        FROM m JOIN st USING (folder, group_id) JOIN f USING (folder, group_id)
        UNION ALL SELECT *, 'duplicate' AS role FROM d WHERE rn > 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY folder, group_id ORDER BY is_thumb, page, path) AS pos,
        count(*) OVER w AS members, max(mtime) OVER w AS newest, min(nullif(declared, 0)) OVER w AS lo,
        max(nullif(declared, 0)) OVER w AS hi, min(page) OVER w AS first
        FROM roles WHERE role = 'member' WINDOW w AS (PARTITION BY folder, group_id)),
    docs AS (SELECT path AS main_path, members, newest, CASE WHEN members > 1 AND (page > 0 OR is_thumb)
          THEN 'o' || group_id ELSE regexp_extract(path, '([^/]*)[.]jxl$', 1) END AS name,
          CASE WHEN lo <> hi THEN 'inconsistent' WHEN members < hi THEN 'truncated' WHEN members > hi THEN 'overfull'
          WHEN hi IS NULL AND members = 1 AND first <> 0 THEN 'fragment' ELSE 'complete' END AS status FROM ranked WHERE pos = 1
        UNION ALL SELECT path, 1, mtime, regexp_extract(path, '([^/]*)[.]jxl$', 1), role FROM roles WHERE role <> 'member'),
    placed AS (SELECT *, '/out/' || name || '.tif' AS dest, count(*) OVER (PARTITION BY name) > 1 AS collides FROM docs)"""


@query("settle_entries", "D2 W1 A4", f"WITH {SETTLED} SELECT path, role FROM roles")
def settle_entries(s):
    return restore.settle_entries(s.v_entries).select("path", "role")


@query("plan_restore", "D2", f"""
    WITH {SETTLED}, o AS (SELECT '/out/o' || CAST(o_orderkey AS VARCHAR) || '.tif' AS dest,
        CAST(o_totalprice / 300 AS INT) AS out_mtime, o_orderstatus <> 'P' AS ours FROM orders)
    SELECT main_path, placed.dest, members, status, collides, CASE WHEN o.dest IS NULL THEN 'write' WHEN NOT ours THEN 'refused'
        WHEN newest <= out_mtime THEN 'skip' ELSE 'overwrite' END AS sync FROM placed LEFT JOIN o ON placed.dest = o.dest""")
def plan_restore(s):
    outputs = s.orders.select(
        F.concat(F.lit("/out/o"), F.col("o_orderkey").cast("string"), F.lit(".tif")).alias("dest"),
        F.rint(F.col("o_totalprice") / 300).cast("int").alias("out_mtime"),
        (F.col("o_orderstatus") != "P").alias("ours"))
    return restore.plan_restore(
        s.v_entries, outputs, 2, where=layout_for("restore", root="/out"), ours="ours")


@query("entries_from_tokens", "D2 F4", """
    SELECT '/m/F/o' || CAST(l_orderkey AS VARCHAR) || '_page7.jxl' AS path, CAST(l_orderkey AS VARCHAR) AS group_id,
        CASE WHEN l_tax = 0 THEN 7 ELSE l_linenumber - 1 END AS page, l_returnflag = 'R' AND l_tax > 0 AS is_thumb,
        l_linenumber + 1 AS declared, 's' || CAST(l_suppkey AS VARCHAR) AS content_id,
        CASE WHEN l_suppkey % 4 = 0 THEN 4 ELSE 0 END AS subfiletype FROM lineitem""")
def entries_from_tokens(s):
    # The line's place makes the path unique while the two inputs meet.
    unique = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    name = F.concat(F.lit("/m/F/"), unique, F.lit("/o"), F.col("l_orderkey").cast("string"), F.lit("_page7.jxl"))
    rows = s.v_tokens.select(name.alias("path"), F.lit(0).alias("mtime"), F.split("relation", "\n").alias("tokens"),
                             F.lit(True).alias("read_ok"))
    out = restore.entries_of(rows.select("path", "mtime"), rows)
    return out.select(F.regexp_replace("path", "/m/F/[^/]*/", "/m/F/").alias("path"), "group_id", "page", "is_thumb",
                      "declared", "content_id", "subfiletype")


# -- derive ------------------------------------------------------------------------

MEMBER = """CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-'
        || CAST(l_suppkey AS VARCHAR) || '-' || CAST(CAST(floor(l_extendedprice * 100) AS BIGINT) AS VARCHAR)"""


def _derive(s, cfg):
    name = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                       F.floor(F.col("l_extendedprice") * 100))
    path = F.concat(F.lit("/lib/_EXPORT/16B_JXL/m"), name, F.lit(".jxl"))
    lines = s.lineitem.withColumn("path", path)
    records = s.v_records.withColumn("path", path).select(
        "path", "description", "software", F.array("history").alias("history"))
    meta = records.join(lines, "path").select(
        "path", "description", "software", "history",
        F.when(F.col("l_linestatus") == "F", "jpeg").otherwise("tiff16").alias("origin"),
        F.when(F.col("l_quantity") > 40, "raw").alias("kind"), (F.col("l_partkey") % 5 == 0).alias("has_jbrd"),
        F.col("l_orderkey").alias("group_id"), (F.col("l_discount") > 0.08).alias("is_thumb"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.lit("sum").alias("srcsum"),
        F.lit(True).alias("read_ok"))
    have = lines.filter("l_tax > 0.02").select(
        F.regexp_replace("path", "16B_JXL", "16B_JXL_small").alias("dest"),
        F.when(F.col("l_returnflag") == "A", F.col("l_partkey") + 1).otherwise(F.col("l_partkey") - 1).alias("out_mtime"),
        F.when(F.col("l_tax") > 0.05, F.lit("other")).otherwise(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))
        .alias("src"), F.lit("sum").alias("srcsum"), F.lit(True).alias("read_ok"),
        F.when(F.col("l_tax") > 0.05, "sRGB/d1e7").when(F.col("l_tax") > 0.03, "keep/d1e7").alias("derived"),
        F.lit(False).alias("has_jbrd"), F.lit(False).alias("broken"))
    assets = lines.select("path", F.col("l_partkey").alias("mtime"))
    return derive.plan_derive(assets, meta, have, 6, cfg, layout_for("derive", root="/lib"))


# Facts of each record: its newest entry and its generations (d and e as numbers).
DERIVE = f"""x AS (SELECT *, 'm' || {MEMBER} AS member, l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' AS hist,
        CASE WHEN l_tax > 0 THEN 1 ELSE 0 END AS t, CASE WHEN l_discount > 0 THEN 1 ELSE 0 END AS q,
        l_discount = l_tax AND CAST(l_quantity AS INT) % 9 + 1 = 7 AS eq7 FROM lineitem),
    y AS (SELECT *, CASE WHEN hist THEN 2.0 WHEN l_returnflag = 'R' OR (l_returnflag = 'A' AND l_linestatus = 'F') THEN l_tax
            ELSE NULL END AS rd, CASE WHEN hist THEN CAST(l_quantity AS INT) % 9 + 1 ELSE 7 END AS re,
        l_linestatus = 'F' AS f,
        l_tax > 0.02 AS found, CASE WHEN l_returnflag = 'A' THEN 'skip' ELSE 'overwrite' END AS have,
        CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END AS hidden FROM x)"""


@query("plan_derive_categories", "D3", f"""
    WITH {DERIVE} SELECT '/lib/_EXPORT/16B_JXL_small/' || member || '.jxl' AS dest,
        CASE WHEN NOT found THEN 'write' ELSE have END AS planned,
        CASE WHEN rd IS NULL THEN 'unknown' WHEN rd = 0 THEN 'ok' WHEN 1.0 > greatest(rd, 0.05) THEN 'ok' ELSE 'downgrade' END AS category
    FROM y""")
def plan_derive_categories(s):
    plan = _derive(s, DeriveConfig(deletes=True, on_downgrade="convert", on_regeneration="convert", on_scan="convert",
                                   jbrd_policy="convert"))
    return plan.select("dest", F.col("sync").alias("planned"), "category")


@query("plan_derive_actions", "D3", f"""
    WITH {DERIVE}, a AS (SELECT *, CASE WHEN l_partkey % 5 = 0 THEN 'copy' WHEN rd IS NOT NULL AND rd > 0 AND greatest(rd, 0.05) >= 1.0
            THEN 'skip' ELSE 'convert' END AS base, CASE WHEN l_quantity > 40 THEN 'copy' END AS scan FROM y),
    b AS (SELECT *, CASE WHEN found AND have = 'skip' THEN 'up to date' WHEN base = 'skip' THEN 'skip'
        WHEN base = 'copy' OR scan = 'copy' THEN 'copy' ELSE 'convert' END AS action FROM a)
    SELECT '/lib/_EXPORT/16B_JXL_small/' || member || '.jxl' AS dest, action,
        CASE WHEN found AND have = 'overwrite' AND action IN ('convert', 'copy') AND l_tax > 0.05 THEN 'refuse' ELSE 'allow' END AS verdict
    FROM b""")
def plan_derive_actions(s):
    plan = _derive(s, DeriveConfig(on_downgrade="skip", on_regeneration="convert"))
    return plan.select("dest", "action", "verdict")


@query("plan_derive_copies", "D3 J7", f"""
    WITH {DERIVE}, a AS (SELECT *, found AND have = 'skip' AND l_tax > 0.05 AS ready FROM y)
    SELECT '/lib/_EXPORT/16B_JXL_small/' || member || '.jxl' AS dest,
        CASE WHEN ready THEN 'up to date' WHEN l_discount > 0.08 THEN 'skip' ELSE 'convert' END AS action,
        CASE WHEN NOT found THEN 'write' WHEN l_tax <= 0.03 THEN 'refuse' WHEN l_tax <= 0.05 THEN 'rederive'
        WHEN have = 'skip' THEN 'skip' WHEN l_discount > 0.08 THEN 'skip' ELSE 'overwrite' END AS verdict FROM a""")
def plan_derive_copies(s):
    plan = _derive(s, DeriveConfig(label="sRGB/d1e7", on_downgrade="convert", on_regeneration="convert",
                                   jbrd_policy="convert"))
    return plan.select("dest", "action", "verdict")


# -- transcode -----------------------------------------------------------------------


@query("plan_transcode", "D4", f"""
    WITH a AS (SELECT d.doc_id, '/pics/' || source || '/p' || CAST(d.doc_id AS VARCHAR) || {EXT} AS path,
        '/pics/' || source || '/p' || CAST(d.doc_id AS VARCHAR) AS base, {EXT} AS ext, COALESCE(quality, 0) = 1 AS jbrd,
        lang, source, toxic, quality FROM documents d LEFT JOIN labels USING (doc_id)),
    r AS (SELECT *, CASE WHEN lower(ext) IN ('.jpg', '.jpeg') THEN 'lossless' WHEN ext = '.png' THEN 'convert'
        WHEN ext = '.jxl' AND jbrd THEN 'recover' WHEN ext = '.jxl' THEN 'decode' ELSE 'error' END AS route FROM a),
    p AS (SELECT *, base || CASE WHEN ext = '.jxl' THEN '.jpg' ELSE '.jxl' END AS dest,
        CASE WHEN ext = '.jxl' THEN 'decode' ELSE 'encode' END AS direction,
        CASE WHEN quality IS NULL THEN 'write' WHEN lang = 'en' THEN 'overwrite' ELSE 'skip' END AS sync,
        CASE WHEN quality IS NULL OR source LIKE '%1' THEN 'not recorded' WHEN source LIKE '%2' THEN 'source differs'
        WHEN source LIKE '%3' THEN 'archive not recorded' WHEN source LIKE '%4' THEN 'archive replaced' ELSE 'proven' END AS binding
        FROM r WHERE route <> 'error')
    SELECT path, route, direction, dest, FALSE AS collides, sync,
        CASE WHEN sync = 'overwrite' AND route IN ('lossless', 'recover') AND binding IN ('source differs', 'archive replaced')
        THEN 'refuse' WHEN sync = 'overwrite' AND route IN ('lossless', 'recover') AND binding = 'not recorded' THEN 'verify'
        -- Nobody read the records of these outputs.
        WHEN sync = 'overwrite' AND route IN ('convert', 'decode') THEN 'refuse' ELSE 'allow' END AS verdict FROM p""")
def plan_transcode(s):
    return _transcode(s).select("path", "route", "direction", "dest", "collides", "sync", "verdict")


RECORDED = """CASE WHEN substr(source, 4, 1) = '5' THEN 'unread' WHEN substr(source, 4, 1) IN ('6', '7') THEN 'other'
        WHEN substr(source, 4, 1) = '8' THEN 'none' ELSE 'own' END"""


@query("plan_transcode_guarded", "D4 J6", f"""
    WITH a AS (SELECT d.doc_id, '/pics/' || source || '/p' || CAST(d.doc_id AS VARCHAR) || {EXT} AS path, {EXT} AS ext, lang, quality,
        COALESCE(quality, 0) = 1 AS jbrd, {RECORDED} AS rec, d.doc_id % 4 = 0 AS out_jbrd, d.doc_id % 7 = 0 AS broken
        FROM documents d LEFT JOIN labels USING (doc_id)),
    r AS (SELECT *, CASE WHEN ext = '.png' THEN 'convert' ELSE 'decode' END AS route,
        CASE WHEN quality IS NULL THEN 'write' WHEN lang = 'en' THEN 'overwrite' ELSE 'skip' END AS sync
        FROM a WHERE ext = '.png' OR (ext = '.jxl' AND NOT jbrd))
    SELECT path, route, sync, CASE WHEN sync <> 'overwrite' OR rec = 'own' THEN 'allow' WHEN rec = 'none' THEN CASE WHEN out_jbrd THEN 'refuse' ELSE 'allow' END
        ELSE 'refuse' END AS verdict,
        CASE WHEN sync <> 'overwrite' OR rec = 'own' OR (rec = 'none' AND NOT out_jbrd) THEN NULL WHEN broken THEN 'damaged output'
        WHEN rec = 'none' THEN 'lossless archive' WHEN rec = 'unread' THEN 'record unread' ELSE 'different source' END AS reason
    FROM r""")
def plan_transcode_guarded(s):
    """Conversions over existing outputs: whose they are decides."""
    digit = F.substring("source", 4, 1)
    own = F.concat(F.lit("/pics/"), "source", F.lit("/p"), F.col("doc_id").cast("string"), F.col("ext"))
    plan = _transcode(s, {
        "src": F.when(digit.isin("6", "7"), P.path_id(F.lit("/other"))).when(~digit.isin("5", "8"), P.path_id(own)),
        "srcsum": F.lit(None).cast("string"), "read_ok": digit != "5", "out_jbrd": F.col("doc_id") % 4 == 0, "broken": F.col("doc_id") % 7 == 0})
    plan = plan.filter(F.col("route").isin("convert", "decode"))
    return plan.select("path", "route", "sync", "verdict", "reason")


def _transcode(s, records=None):
    ext = F.element_at(F.array(*[F.lit(e) for e in (".tif", ".jpg", ".JPEG", ".png", ".jxl")]),
                       (F.col("doc_id") % 5 + 1).cast("int"))
    base = F.concat(F.lit("/pics/"), "source", F.lit("/p"), F.col("doc_id").cast("string"))
    docs = s.documents.join(s.labels, "doc_id", "left").select(
        "doc_id", "lang", "source", "quality", ext.alias("ext"), base.alias("base"), F.concat(base, ext).alias("path"))
    assets = docs.select("path", "ext", F.lit(10).alias("mtime"), F.md5("path").alias("md5"))
    boxes = docs.select("path", (F.coalesce("quality", F.lit(0)) == 1).alias("has_jbrd"))
    jxl = F.col("ext") == ".jxl"
    dest = F.concat("base", F.when(jxl, ".jpg").otherwise(".jxl"))
    have = docs.filter("quality IS NOT NULL AND ext <> '.tif'").select(
        dest.alias("dest"), F.when(F.col("lang") == "en", 5).otherwise(20).alias("out_mtime"), F.md5(dest).alias("out_md5"),
        *[value.alias(name) for name, value in (records or {}).items()])
    # The archive is the output when encoding, the source when decoding.
    arch = F.when(jxl, F.col("path")).otherwise(dest)
    original = F.when(jxl, dest).otherwise(F.col("path"))
    known = docs.filter("quality IS NOT NULL AND NOT source LIKE '%1'")
    folder, name, tail = P.parent(arch), P.file_name(arch), F.col("source")
    lines = known.select(
        folder.alias("folder"), name.alias("name"),
        F.when(tail.like("%2"), "0").otherwise(F.md5(original)).alias("md5")).unionByName(
            known.filter("NOT source LIKE '%3'").select(
                folder.alias("folder"), F.concat(name, F.lit(".jxl-md5")).alias("name"),
                F.when(tail.like("%4"), "0").otherwise(F.md5(arch)).alias("md5")))
    return transcode.plan_transcode(assets, boxes, have, lines, 8, "/pics")


# -- gates --------------------------------------------------------------------------


def _ranked_sql(cases: list[tuple[str, str]], rows: str, key: str, extra: str = "") -> str:
    ranks = " ".join(f"WHEN {test} THEN {i}" for i, (_, test) in enumerate(cases, 1))
    names = ", ".join(f"'{name}'" for name, _ in cases)
    return f"""
    WITH g AS (SELECT *, CASE {ranks} END AS rank FROM {rows}),
    w AS (SELECT {key}, min(rank) AS rank, bool_and(status = 'skipped') AS skips, count(*) AS outputs FROM g GROUP BY {key})
    SELECT {key}, outputs, CASE WHEN rank IS NULL THEN 'remove' ELSE 'keep' END AS verdict, [{names}][rank] AS reason,
        rank IS NULL AND skips AS already_archived FROM w"""


def lines(s):
    status = (F.when(F.col("l_quantity") > 49, "error").when(F.col("l_returnflag") == "R", "ok")
              .when(F.col("l_returnflag") == "A", "skipped").otherwise("overwrite"))
    return s.lineitem.withColumns({"src": F.col("l_orderkey"), "status": status})


LINES = """(SELECT l_orderkey AS src, CASE WHEN l_quantity > 49 THEN 'error' WHEN l_returnflag = 'R' THEN 'ok'
        WHEN l_returnflag = 'A' THEN 'skipped' ELSE 'overwrite' END AS status, * FROM lineitem) lines"""


@query("archive_gate", "D5", _ranked_sql([
    ("page not settled", "status = 'error'"), ("real page discarded", "l_quantity = 1"),
    ("unarchivable content", "l_quantity = 2"), ("output missing", "l_quantity = 3"),
    ("output not delivered", "FALSE"), ("output not intact", "l_quantity = 4"),
    ("skipped output not proven", "status = 'skipped' AND l_discount > 0.08"), ("pixels differ", "l_quantity = 6"),
    ("source changed", "l_quantity = 7")], LINES, "src"))
def archive_gate(s):
    q = F.col("l_quantity")
    facts = lines(s).withColumns({
        "discarded_real": q == 1, "unarchivable": F.when(q == 2, "layers"), "output_exists": q != 3,
        "delivered": F.lit(False), "intact": q != 4, "proven": F.col("l_discount") <= 0.08,
        # Not compared counts as different.
        "pixels_ok": F.when(q != 6, True), "changed": q == 7})
    return gates.delete_candidates(facts, "archive")


@query("restore_gate", "D5", _ranked_sql([
    ("not converted", "status = 'error'"), ("output missing", "l_quantity = 3"), ("output not delivered", "FALSE"),
    ("output not intact", "l_quantity = 4"),
    ("made from an earlier version", "status = 'skipped' AND l_tax > 0.02 AND l_discount > 0.08"),
    ("no matching record", "status = 'skipped' AND l_tax <= 0.02"),
    ("edited since", "status = 'skipped' AND l_quantity = 5"), ("incomplete group", "l_quantity IN (8, 9)"),
    ("group record unread", "l_quantity = 10"), ("alpha not provable", "FALSE"), ("reduced samples", "l_quantity = 11"),
    ("degraded on purpose", "l_quantity = 12"), ("approximate profile", "l_quantity = 13"),
    ("source changed", "l_quantity = 7")],
    LINES.replace("FROM lineitem) lines", "FROM lineitem WHERE l_linenumber < 7) lines"), "src").replace(
        "SELECT src, outputs", "SELECT src AS dest, outputs"))
def restore_gate(s):
    q = F.col("l_quantity")
    facts = lines(s).withColumns({
        "dest": F.col("src"), "ignored_thumb": F.col("l_linenumber") >= 7, "output_exists": q != 3,
        "delivered": F.lit(True), "intact": q != 4, "matches": F.col("l_tax") > 0.02,
        "proven": F.col("l_discount") <= 0.08, "edited": F.when(q == 5, "pixels changed"),
        "group_status": F.when(q == 8, "truncated").when(q == 9, "inconsistent").otherwise("complete"),
        "read_ok": q != 10, "reduced": F.when(q == 11, "animation"), "degraded": q == 12,
        "approximate": q == 13, "changed": q == 7})
    return gates.delete_candidates(facts, "restore")


@query("derive_gate", "D5", """
    WITH x AS (SELECT *, CASE WHEN l_quantity > 49 THEN 'error' WHEN l_returnflag = 'R' THEN 'ok'
        WHEN l_returnflag = 'A' THEN 'skipped' ELSE 'copied' END AS status FROM lineitem),
    g AS (SELECT *, CASE WHEN status = 'error' THEN 'not converted in this run' WHEN l_quantity = 7 THEN 'source changed'
        WHEN l_quantity = 3 THEN 'output missing' WHEN status <> 'skipped' AND l_quantity = 5 THEN 'output replaced since'
        WHEN l_quantity = 4 THEN 'output not intact' WHEN status = 'copied' AND l_quantity = 6 THEN 'copy differs'
        WHEN status = 'skipped' AND l_quantity = 8 THEN 'record unread'
        WHEN status = 'skipped' AND l_tax < 0.01 THEN 'no matching record'
        WHEN status = 'skipped' AND l_discount > 0.09 THEN 'made from an earlier version'
        WHEN status = 'skipped' AND l_quantity = 9 THEN 'pixels differ' END AS own FROM x),
    w AS (SELECT *, CASE WHEN l_linenumber < 6 THEN bool_and(own IS NULL) OVER p END AS whole,
        CASE WHEN l_linenumber < 6 THEN count(*) OVER p END AS here, CASE WHEN l_linenumber < 6 THEN
        max(l_suppkey % 4) OVER p END AS declared FROM g
        WINDOW p AS (PARTITION BY l_linestatus, CASE WHEN l_linenumber < 6 THEN l_orderkey END)),
    r AS (SELECT *, CASE WHEN own IS NOT NULL THEN own WHEN whole AND declared > here THEN 'document incomplete'
        WHEN NOT whole THEN 'sibling page kept' END AS reason FROM w)
    SELECT l_orderkey AS src, CASE WHEN reason IS NULL THEN 'remove' ELSE 'keep' END AS verdict, reason,
        reason IS NULL AND status = 'skipped' AS already_archived FROM r""")
def derive_gate(s):
    q = F.col("l_quantity")
    status = (F.when(q > 49, "error").when(F.col("l_returnflag") == "R", "ok")
              .when(F.col("l_returnflag") == "A", "skipped").otherwise("copied"))
    facts = s.lineitem.withColumns({
        "src": F.col("l_orderkey"), "status": status, "action": F.lit("convert"), "folder": F.col("l_linestatus"),
        "group_id": F.when(F.col("l_linenumber") < 6, F.col("l_orderkey")), "declared": F.col("l_suppkey") % 4,
        "changed": q == 7, "output_exists": q != 3, "replaced": q == 5, "intact": q != 4, "copy_md5_equal": q != 6,
        "out_read_ok": q != 8, "matches": F.col("l_tax") >= 0.01, "proven": F.col("l_discount") <= 0.09,
        "pixels_ok": q != 9})
    return gates.delete_candidates(facts, "derive")


@query("transcode_gate", "D5", _ranked_sql([
    ("not converted", "status = 'error'"), ("output missing", "l_quantity = 3"), ("source gone", "l_quantity = 2"),
    ("output not delivered", "FALSE"), ("no checksum recorded", "status = 'skipped' AND l_tax > 0.06"),
    ("checksum differs", "status = 'skipped' AND l_tax > 0.04"),
    ("archive replaced", "status = 'skipped' AND l_linestatus = 'O' AND l_tax > 0.03 AND l_quantity = 9"),
    ("checksum not confirmed", "status <> 'skipped' AND l_linestatus = 'F' AND l_quantity = 8"),
    ("not recoverable", "l_linestatus = 'F' AND l_quantity = 5"),
    ("reconstruction differs", "l_linestatus = 'F' AND l_quantity = 9"),
    ("recovery not verified", "l_linestatus = 'O' AND status <> 'skipped' AND l_quantity = 8"),
    ("decoded from a repaired copy", "l_linestatus = 'O' AND status <> 'skipped' AND l_quantity = 10"),
    ("output not intact", "l_quantity = 4"), ("source changed", "l_quantity = 7")], LINES, "src"))
def transcode_gate(s):
    q, tax = F.col("l_quantity"), F.col("l_tax")
    facts = lines(s).withColumns({
        "encodes": F.col("l_linestatus") == "F", "output_exists": q != 3, "source_exists": q != 2,
        "delivered": F.lit(False), "journal_md5": F.when(tax <= 0.06, "a"),
        "source_md5": F.when(tax > 0.04, "b").otherwise("a"),
        "binding": F.when(tax > 0.03, "archive replaced").otherwise("proven"), "md5_checked": q != 8,
        "has_jbrd": q != 5, "reconstructs": q != 9, "intact": q != 4, "repaired": q == 10, "changed": q == 7})
    return gates.delete_candidates(facts, "transcode")


@query("conversion_gate", "D5", _ranked_sql([
    ("not converted", "status IN ('error', 'skipped')"), ("output missing", "l_quantity = 3"), ("source gone", "l_quantity = 2"),
    ("output not delivered", "l_quantity = 8"), ("lossy copy", "l_quantity = 5"),
    ("reconstruction differs", "l_linestatus = 'F' AND l_quantity = 9"),
    ("output not intact", "l_quantity = 4"), ("skipped output not proven", "FALSE"),
    ("source changed", "l_quantity = 7")], LINES, "src"))
def conversion_gate(s):
    q = F.col("l_quantity")
    facts = lines(s).withColumns({
        "output_exists": q != 3, "source_exists": q != 2, "delivered": q != 8,
        "keep_reason": F.when(q == 5, "gain map not carried"), "jpeg_archive": F.col("l_linestatus") == "F",
        "reconstructs": q != 9, "intact": q != 4, "proven": F.lit(False), "changed": q == 7})
    return gates.delete_candidates(facts, "convert", GateConfig(delete_skipped=False, staging=True))
