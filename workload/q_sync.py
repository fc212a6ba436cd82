"""Synchronisation, provenance, guards, comparisons of catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.config import PolicyConfig
from shelfmark.functions import paths as P
from shelfmark.functions import scalars as S
from shelfmark.operators import policy, provenance, report, sync
from workload.registry import query

PLAN = """plan AS (SELECT doc_id, path, text, mtime, lang, source,
        folder || '/JXL_16bits/' || stem || '.jxl' AS dest FROM v_assets)"""
SYNC = f"""{PLAN}, synced AS (SELECT p.*, e.out_mtime, e.rec_path, e.rec_text, e.read_ok, e.has_jbrd, e.broken, e.derived,
        e.dest IS NOT NULL AS found,
        CASE WHEN e.dest IS NULL THEN 'write' WHEN p.mtime <= e.out_mtime THEN 'skip' ELSE 'overwrite' END AS sync
        FROM plan p LEFT JOIN v_existing e USING (dest))"""


def plan(s):
    return s.v_assets.select(
        "doc_id", "path", "mtime", "lang", "source",
        F.concat_ws("/", "folder", F.lit("JXL_16bits"), F.concat("stem", F.lit(".jxl"))).alias("dest"),
        P.path_id("path").alias("path_id"), S.content_id("text").alias("content_id"))


def existing(s):
    """Existing outputs with their recorded identities."""
    return s.v_existing.select(
        "dest", "out_mtime", P.path_id("rec_path").alias("src"), S.content_id("rec_text").alias("srcsum"),
        "read_ok", "has_jbrd", "broken", "derived")


def synced(s, overwrite="smart"):
    return sync.sync_plan(plan(s), existing(s).select("dest", "out_mtime"), overwrite)


@query("sync_plan", "J1", f"WITH {SYNC} SELECT doc_id, dest, sync FROM synced")
def sync_plan(s):
    return synced(s).select("doc_id", "dest", "sync")


@query("sync_never_and_always", "J1", f"""
    WITH {SYNC} SELECT doc_id, CASE WHEN found THEN 'skip' ELSE 'write' END AS never,
        CASE WHEN found THEN 'overwrite' ELSE 'write' END AS always FROM synced""")
def sync_never_and_always(s):
    have = existing(s).select("dest", "out_mtime")
    first = sync.sync_plan(plan(s), have, "never").select(
        "doc_id", "dest", "mtime", F.col("sync").alias("never"))
    return sync.sync_plan(first, have, "always").select("doc_id", "never", F.col("sync").alias("always"))


@query("sync_due", "J1", f"WITH {SYNC} SELECT doc_id FROM synced WHERE sync <> 'skip'")
def sync_due(s):
    return sync.due(plan(s), existing(s)).select("doc_id")


@query("sync_groups", "J2", """
    WITH g AS (SELECT '/out/' || group_id || '.tif' AS dest, max(mtime) AS newest, count(*) AS members
        FROM v_entries GROUP BY group_id),
    o AS (SELECT '/out/' || CAST(o_orderkey AS VARCHAR) || '.tif' AS dest, CAST(o_totalprice / 300 AS INT) AS out_mtime,
        o_orderstatus <> 'P' AS ours FROM orders)
    SELECT dest, newest, members, CASE WHEN o.dest IS NULL THEN 'write' WHEN NOT ours THEN 'refused'
        WHEN newest <= out_mtime THEN 'skip' ELSE 'overwrite' END AS sync
    FROM g LEFT JOIN o USING (dest)""")
def sync_groups(s):
    entries = s.v_entries.select(
        "mtime", F.concat(F.lit("/out/"), "group_id", F.lit(".tif")).alias("dest"))
    outputs = s.orders.select(
        F.concat(F.lit("/out/"), F.col("o_orderkey").cast("string"), F.lit(".tif")).alias("dest"),
        F.rint(F.col("o_totalprice") / 300).cast("int").alias("out_mtime"),
        (F.col("o_orderstatus") != "P").alias("ours"))
    return sync.sync_groups(entries, outputs, ours="ours").select("dest", "newest", "members", "sync")


@query("same_bytes", "J3", f"""
    WITH {SYNC} SELECT doc_id, COALESCE(sync = 'overwrite' AND read_ok AND rec_text = text, FALSE) AS same_bytes,
        CASE WHEN sync = 'overwrite' AND read_ok AND rec_text = text THEN 'skip' ELSE sync END AS sync FROM synced""")
def same_bytes(s):
    return sync.same_bytes(synced(s), existing(s)).select("doc_id", "same_bytes", "sync")


@query("provenance_match", "J4", f"""
    WITH {SYNC} SELECT doc_id, COALESCE(rec_path = path, FALSE) AS by_path,
        COALESCE(rec_path = path, FALSE) OR COALESCE(rec_text = text, FALSE) AS by_content FROM synced WHERE found""")
def provenance_match(s):
    pairs = plan(s).join(existing(s), "dest")
    first = provenance.provenance_ok(pairs).withColumnRenamed("provenance_ok", "by_path")
    return provenance.provenance_ok(first, "content").select(
        "doc_id", "by_path", F.col("provenance_ok").alias("by_content"))


@query("archive_proofs", "J5", f"""
    WITH {SYNC} SELECT doc_id, 'path' AS mode FROM synced WHERE rec_path = path AND rec_text = text
    UNION ALL SELECT doc_id, 'content' FROM synced WHERE rec_text = text""")
def archive_proofs(s):
    pairs = plan(s).join(existing(s), "dest")
    return report.union_plans(*[
        provenance.proves_archive(pairs, mode).select("doc_id", F.lit(mode).alias("mode"))
        for mode in ("path", "content")])


@query("overwrite_guard", "J6", f"""
    WITH {SYNC}, v AS (SELECT *, CASE WHEN sync <> 'overwrite' THEN 'allow|'
        WHEN rec_path IS NOT NULL OR rec_text IS NOT NULL THEN
            CASE WHEN rec_path = path THEN 'allow|' ELSE 'refuse|different source' END
        WHEN NOT read_ok THEN 'refuse|record unread' WHEN has_jbrd THEN 'refuse|lossless archive' ELSE 'allow|' END AS v
        FROM synced)
    SELECT doc_id, split_part(v, '|', 1) AS verdict,
        CASE WHEN starts_with(v, 'refuse') AND broken THEN 'damaged output' ELSE nullif(split_part(v, '|', 2), '') END AS reason
    FROM v""")
def overwrite_guard(s):
    have = existing(s)
    return provenance.overwrite_guard(synced(s), have, have).select("doc_id", "verdict", "reason")


@query("overwrite_guard_strict", "J6", f"""
    WITH {SYNC}, v AS (SELECT *, CASE WHEN NOT found OR rec_path = path THEN 'allow|'
        WHEN NOT read_ok THEN 'refuse|record unread'
        WHEN rec_path IS NULL AND rec_text IS NULL THEN 'verify|unmarked output' ELSE 'refuse|different source' END AS v
        FROM synced)
    SELECT doc_id, split_part(v, '|', 1) AS verdict,
        CASE WHEN starts_with(v, 'refuse') AND broken THEN 'damaged output' ELSE nullif(split_part(v, '|', 2), '') END AS reason
    FROM v""")
def overwrite_guard_strict(s):
    have = existing(s)
    return provenance.overwrite_guard(synced(s), have, have, "adopt", strict=True).select(
        "doc_id", "verdict", "reason")


@query("derivative_guard", "J7", f"""
    WITH {SYNC} SELECT doc_id, CASE WHEN sync = 'write' THEN sync WHEN NOT read_ok OR derived IS NULL THEN 'refuse'
        WHEN derived LIKE 'keep%' OR derived LIKE '%/d3e7' OR derived LIKE '%/d3e9s' THEN 'rederive' ELSE sync END AS verdict,
        CASE WHEN sync = 'write' THEN NULL WHEN NOT read_ok OR derived IS NULL THEN 'not a derived copy'
        WHEN derived LIKE 'keep%' THEN 'derivative recipe changed' WHEN derived LIKE '%/d3e7' OR derived LIKE '%/d3e9s' THEN 'encode settings changed'
        END AS reason FROM synced""")
def derivative_guard(s):
    return provenance.derivative_guard(synced(s), existing(s), "sRGB@long2048+screen/d3e9").select(
        "doc_id", "verdict", "reason")


@query("derivative_guard_quality", "J7", f"""
    WITH {SYNC} SELECT doc_id, CASE WHEN sync = 'write' THEN sync WHEN NOT read_ok OR derived IS NULL THEN 'refuse'
        WHEN derived LIKE 'keep%' THEN sync ELSE 'rederive' END AS verdict FROM synced""")
def derivative_guard_quality(s):
    return provenance.derivative_guard(
        synced(s), existing(s), "keep@pct50/q70", by_quality=True).select("doc_id", "verdict")


@query("restamp_moved", "J8", f"""
    WITH {SYNC} SELECT doc_id, CASE WHEN rec_path = path THEN 'already' WHEN NOT read_ok THEN 'unread'
        WHEN rec_path IS NULL AND rec_text IS NULL THEN 'unmarked' WHEN rec_text = text THEN 'restamp'
        ELSE 'differs' END AS state FROM synced WHERE found""")
def restamp_moved(s):
    return provenance.restamp_moved(plan(s), existing(s)).select("doc_id", "state")


@query("restamp_counts", "J8", f"""
    WITH {SYNC} SELECT CASE WHEN rec_path = path THEN 'already' WHEN NOT read_ok THEN 'unread'
        WHEN rec_path IS NULL AND rec_text IS NULL THEN 'unmarked' WHEN rec_text = text THEN 'restamp'
        ELSE 'differs' END AS state, count(*) AS outputs FROM synced WHERE found GROUP BY 1""")
def restamp_counts(s):
    return provenance.restamp_counts(provenance.restamp_moved(plan(s), existing(s)))


JOURNAL = """lines AS (SELECT folder, CAST(event_id AS BIGINT) AS line_no,
        md5(CAST(CASE WHEN value > 20 THEN user_id ELSE -1 END AS VARCHAR)) AS md5,
        'a' || CAST(user_id % 7 AS VARCHAR) || '.jxl' || CASE WHEN status = 'ok' THEN '.jxl-md5' ELSE '' END AS name
        FROM v_results),
    journal AS (SELECT folder, name, md5, line_no FROM (SELECT *, row_number() OVER (PARTITION BY folder, name
        ORDER BY line_no DESC) AS rn FROM lines) WHERE rn = 1)"""


def journal_lines(s):
    """Checksum lines out of the run results: one folder per user."""
    digest = F.md5(F.when(F.col("value") > 20, F.col("user_id")).otherwise(-1).cast("string"))
    name = F.concat(F.lit("a"), (F.col("user_id") % 7).cast("string"), F.lit(".jxl"),
                    F.when(F.col("status") == "ok", ".jxl-md5").otherwise(""))
    return s.v_results.select(
        "folder", F.col("event_id").alias("line_no"), digest.alias("md5"), name.alias("name"))


@query("checksum_binding", "J11", f"""
    WITH {JOURNAL}, u AS (SELECT DISTINCT folder, 'a' || CAST(user_id % 7 AS VARCHAR) || '.jxl' AS name,
        md5(CAST(user_id AS VARCHAR)) AS own FROM v_results)
    SELECT u.folder, u.name, CASE WHEN j.md5 IS NULL THEN 'not recorded' WHEN j.md5 <> own THEN 'source differs'
        WHEN k.md5 IS NULL THEN 'archive not recorded' WHEN k.md5 <> own THEN 'archive replaced' ELSE 'proven' END AS binding
    FROM u LEFT JOIN journal j ON u.folder = j.folder AND u.name = j.name
    LEFT JOIN journal k ON u.folder = k.folder AND u.name || '.jxl-md5' = k.name""")
def checksum_binding(s):
    from shelfmark.sources.checksums import last_lines

    own = F.md5(F.col("user_id").cast("string"))
    pairs = s.v_results.select(
        "folder", F.concat(F.lit("a"), (F.col("user_id") % 7).cast("string"), F.lit(".jxl")).alias("name"),
        own.alias("source_md5"), own.alias("archive_md5")).distinct()
    return provenance.checksum_binding(pairs, last_lines(journal_lines(s))).select(
        "folder", "name", "binding")


@query("edited_since", "J19", """
    SELECT doc_id, CASE WHEN quality = 0 THEN 'record unread' WHEN lang = 'es' THEN NULL WHEN lang = 'fr' THEN 'pixels unread'
        WHEN toxic = 1 THEN 'page count changed' WHEN source LIKE '%1' THEN 'pixels changed' END AS edited
    FROM documents JOIN labels USING (doc_id)""")
def edited_since(s):
    rows = s.documents.join(s.labels, "doc_id")
    sum_of = F.concat(F.lit("2:"), F.md5("text"))
    meta = rows.select("doc_id", F.col("doc_id").alias("dest"), (F.col("quality") == 1).alias("read_ok"),
                       F.when(F.col("lang") != "es", sum_of).alias("pixsum"))
    digests = rows.filter("lang <> 'fr'").select(
        F.col("doc_id").alias("dest"), F.when(F.col("toxic") == 1, 1).otherwise(3).alias("page_count"),
        F.when(F.col("source").like("%1"), F.lit("2:0")).otherwise(sum_of).alias("digest"))
    return provenance.edited_since(meta, digests).select("doc_id", "edited")


@query("changed_since", "J20", """
    SELECT o_orderkey, o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_totalprice > 300000) AS changed FROM orders""")
def changed_since(s):
    before = s.orders.select(
        "o_orderkey", F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("size"),
        F.col("o_orderdate").alias("mtime"))
    after = s.orders.filter("o_orderstatus <> 'F'").select(
        F.col("o_orderkey").alias("path"),
        F.when((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 300000), 1.0)
        .otherwise(F.col("o_totalprice")).alias("size"), F.col("o_orderdate").alias("mtime"))
    return sync.changed_since(before, after).select("o_orderkey", "changed")


@query("layout_guard", "J21", """
    WITH p AS (SELECT path, stem, page, subfiletype = 1 AS thumb, bits * 10 AS mtime, source_id,
        count(*) FILTER (subfiletype <> 1) OVER w AS reals, count(*) OVER w AS n,
        min(CASE WHEN subfiletype <> 1 THEN page END) OVER w AS first_real, min(page) OVER w AS first
        FROM v_pages WINDOW w AS (PARTITION BY path)),
    n AS (SELECT *, CASE WHEN n = 1 AND NOT thumb THEN '' ELSE CASE WHEN page > 0 THEN '_page' || CAST(page AS VARCHAR) ELSE '' END
            || CASE WHEN thumb THEN '_thumbnail' ELSE '' END END AS w_name,
        CASE WHEN thumb THEN NULL WHEN reals = 1 THEN '' WHEN page > 0 THEN '_page' || CAST(page AS VARCHAR) ELSE '' END AS o_name,
        page = COALESCE(first_real, first) AND (NOT thumb OR reals = 0) AS main FROM p),
    c AS (SELECT path, source_id, mtime, w_name AS name, main, w_name IS DISTINCT FROM o_name AS extra FROM n
          UNION ALL SELECT path, source_id, mtime, o_name, main, FALSE FROM n WHERE o_name IS NOT NULL),
    j AS (SELECT c.*, o_orderkey IS NOT NULL AND NOT (c.name LIKE '%2%') AS there,
          CASE WHEN o_orderstatus = 'F' THEN 50 ELSE 500 END AS out_mtime, o_orderpriority = '5-LOW' AS same
          FROM c LEFT JOIN orders ON o_orderkey = source_id AND o_orderstatus <> 'P'),
    v AS (SELECT path, bool_or(main AND there) AS archived, bool_or(main AND there AND mtime > out_mtime AND NOT same) AS stale,
          count(*) FILTER (extra) AS x, count(*) FILTER (extra AND there) AS xt FROM j GROUP BY path)
    SELECT path, CASE WHEN archived AND NOT stale THEN CASE WHEN x > 0 AND x = xt THEN 'keep' ELSE 'drop' END END AS layout
    FROM v""")
def layout_guard(s):
    from workload.q_policy import pages

    rows = pages(s).withColumns({"dest_dir": F.lit("/arch"), "mtime": F.col("bits") * 10})
    # Every page of an archived order exists but its second ones.
    names = policy.plan_pages(pages(s), PolicyConfig(page_mode="split_all"))
    plain = policy.plan_pages(pages(s), PolicyConfig(page_mode="split", thumbnail_mode="exclude"))
    orders = s.orders.select(F.col("o_orderkey").alias("source_id"), "o_orderstatus", "o_orderpriority")
    have = (
        names.select("source_id", "stem", "output_name").union(plain.select("source_id", "stem", "output_name"))
        .distinct().join(orders.filter("o_orderstatus <> 'P'"), "source_id")
        .filter(~F.expr("substring(output_name, length(stem) + 1)").contains("2"))
        .select(F.concat(F.lit("/arch/"), "output_name").alias("dest"),
                F.when(F.col("o_orderstatus") == "F", 50).otherwise(500).alias("out_mtime"),
                (F.col("o_orderpriority") == "5-LOW").alias("same_bytes")))
    out = sync.layout_guard(rows, have)
    return out.select("path", F.when(F.col("keep_thumbs"), "keep").when(~F.col("keep_thumbs"), "drop")
                      .alias("layout"))


@query("snapshot_diff", "J18", """
    WITH a AS (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT'),
    b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
        CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderpriority
        FROM orders WHERE o_orderpriority <> '2-HIGH')
    SELECT COALESCE(a.o_orderkey, b.o_orderkey) AS o_orderkey,
        CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
        CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN '' ELSE concat_ws(',',
            CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END,
            CASE WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'o_totalprice' END) END AS columns
    FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey
    WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
        OR a.o_totalprice IS DISTINCT FROM b.o_totalprice""")
def snapshot_diff(s):
    a = s.orders.filter("o_orderpriority <> '1-URGENT'")
    b = s.orders.filter("o_orderpriority <> '2-HIGH'").withColumns({
        "o_orderstatus": F.when(F.col("o_totalprice") > 400000, "X").otherwise(F.col("o_orderstatus")),
        "o_totalprice": F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice"))})
    return report.snapshot_diff(a, b, "o_orderkey", ["o_orderdate"])


@query("layout_diff", "X2", """
    WITH have AS (SELECT DISTINCT group_id, page FROM v_entries WHERE NOT is_thumb),
    want AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS group_id, p AS page FROM orders, (SELECT 0 AS p UNION ALL SELECT 1))
    SELECT group_id, page, 'stale' AS side FROM (SELECT * FROM have EXCEPT SELECT * FROM want)
    UNION ALL SELECT group_id, page, 'missing' FROM (SELECT * FROM want EXCEPT SELECT * FROM have)""")
def layout_diff(s):
    have = s.v_entries.filter("NOT is_thumb").select("group_id", "page").distinct()
    want = s.orders.select(F.col("o_orderkey").cast("string").alias("group_id"),
                           F.explode(F.array(F.lit(0), F.lit(1))).alias("page"))
    return report.layout_diff(have, want)


@query("unread_paths", "X4", """
    SELECT doc_id AS path, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'answered' ELSE 'unread' END AS state
    FROM documents""")
def unread_paths(s):
    return report.unread(s.documents.select(F.col("doc_id").alias("path")),
                         s.labels.select(F.col("doc_id").alias("path")))


@query("plan_impact", "A24", f"""
    WITH {SYNC} SELECT count(*) FILTER (sync = 'write') AS would_write, count(*) FILTER (sync = 'overwrite') AS would_replace,
        count(*) FILTER (sync = 'skip') AS would_skip, bool_or(sync IN ('write', 'overwrite')) AS any_for_gate,
        count(*) FILTER (sync <> 'skip') AS would_delete, count(*) FILTER (sync = 'skip') AS would_keep FROM synced""")
def plan_impact(s):
    return report.plan_impact(synced(s), deletes=True)
