"""Totals, previews, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.config import PolicyConfig
from shelfmark.operators import policy, report
from shelfmark.sources import sinks
from workload.q_policy import FACTS, pages
from workload.registry import query

COUNTED = "('ok', 'copied', 'overwrite', 'skipped', 'aborted', 'error')"


@query("status_counts", "A10", f"""
    SELECT entry, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'copied') AS copied,
        count(*) FILTER (status = 'overwrite') AS overwrite, count(*) FILTER (status = 'skipped') AS skipped,
        count(*) FILTER (status = 'aborted') AS aborted,
        count(*) FILTER (status = 'error' OR status NOT IN {COUNTED}) AS error,
        count(*) FILTER (status NOT IN {COUNTED}) AS uncounted, count(*) AS total
    FROM v_results GROUP BY entry""")
def status_counts(s):
    return report.status_counts(s.v_results, ["entry"])


def _extras(s):
    return s.v_results.select("entry", "status", F.create_map(
        F.col("status"), F.floor("value").cast("bigint"), F.lit("events"), F.lit(1).cast("bigint"),
        F.lit("never"), F.lit(0).cast("bigint")).alias("extras"))


@query("sum_maps", "A12", """
    SELECT entry, label, CAST(sum(v) AS BIGINT) AS total FROM (
        SELECT entry, status AS label, CAST(floor(value) AS BIGINT) AS v FROM v_results
        UNION ALL SELECT entry, 'events', 1 FROM v_results UNION ALL SELECT entry, 'never', 0 FROM v_results)
    GROUP BY entry, label""")
def sum_maps(s):
    return report.sum_maps(_extras(s), "extras", ["entry"])


@query("summed_maps", "A12", """
    WITH t AS (SELECT entry, label, CAST(sum(v) AS BIGINT) AS total FROM (
        SELECT entry, status AS label, CAST(floor(value) AS BIGINT) AS v FROM v_results
        UNION ALL SELECT entry, 'events', 1 FROM v_results) GROUP BY entry, label HAVING sum(v) <> 0)
    SELECT entry, string_agg(label || '=' || CAST(total AS VARCHAR), ',' ORDER BY label) AS extras FROM t GROUP BY entry""")
def summed_maps(s):
    out = report.summed_map(_extras(s), "extras", ["entry"])
    shown = F.transform(F.array_sort(F.map_entries("extras")), lambda e: F.concat_ws(
        "=", e["key"], e["value"].cast("string")))
    return out.select("entry", F.array_join(shown, ",").alias("extras"))


def decisions(s):
    return s.v_results.select(
        F.when(F.col("status") == "ok", "remove").otherwise("keep").alias("verdict"),
        F.col("status").alias("reason"),
        F.when(F.col("value") > 20, "encode").otherwise("decode").alias("direction"))


DECISIONS = """d AS (SELECT CASE status WHEN 'ok' THEN 'remove' ELSE 'keep' END AS verdict, status AS reason,
        CASE WHEN value > 20 THEN 'encode' ELSE 'decode' END AS direction FROM v_results)"""


@query("gate_counts", "A13", f"""
    WITH {DECISIONS} SELECT verdict, reason, count(*) AS sources FROM d GROUP BY verdict, reason""")
def gate_counts(s):
    return report.gate_counts(decisions(s))


@query("gate_cube", "A13", f"""
    WITH {DECISIONS} SELECT reason, direction, CAST(grouping_id(reason, direction) AS BIGINT) AS level,
        count(*) AS sources FROM d GROUP BY CUBE (reason, direction)""")
def gate_cube(s):
    return report.gate_cube(decisions(s))


def _targets(s):
    kinds = policy.source_kind(pages(s))
    return kinds.withColumn("distance", policy.assign_distance("kind", "bits", PolicyConfig(distance=0.1)))


@query("notice_counts", "A14", f"""
    WITH {FACTS} SELECT COALESCE(reason, '8-bit') AS reason, count(*) AS assets FROM kinds
    WHERE kind IS NOT NULL OR bits BETWEEN 1 AND 8 GROUP BY 1""")
def notice_counts(s):
    return report.notice_counts(_targets(s), 0.1)


@query("notice_folders", "A14", f"""
    WITH {FACTS} SELECT length(path) AS folder, count(*) AS assets FROM kinds WHERE reason = 'guessed'
    GROUP BY 1""")
def notice_folders(s):
    rows = _targets(s).withColumn("folder", F.length("path"))
    return report.notice_folders(rows, 0.1).select(F.col("folder").cast("bigint").alias("folder"), "assets")


PREFLIGHT = """s AS (SELECT 'vol' || CAST(l_suppkey % 4 AS VARCHAR) AS volume, 'f' || l_returnflag AS dest_dir, l_orderkey AS src,
        max(CAST(floor(o_totalprice) AS BIGINT)) * 4096 AS size, max(o_orderstatus) = 'F' AS near
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
    ratio AS (SELECT max(l_discount * 5 + 0.2) AS r FROM lineitem),
    f AS (SELECT volume, dest_dir, sum(CASE WHEN near THEN size ELSE 0 END) * r + sum(CASE WHEN near THEN 0 ELSE size END) AS need,
        sum(size) AS total FROM s, ratio GROUP BY volume, dest_dir, r)"""


@query("space_preflight", "A16", f"""
    WITH {PREFLIGHT}, p AS (SELECT sum(need) AS peak FROM (SELECT need FROM f ORDER BY need DESC LIMIT 2)),
    v AS (SELECT volume, sum(need) AS need FROM f GROUP BY volume),
    free AS (SELECT 'vol' || CAST(s_suppkey % 3 AS VARCHAR) AS volume, CAST(max(s_acctbal) * 100000000 AS BIGINT) AS free
        FROM supplier GROUP BY 1)
    SELECT v.volume, round(need, 2) AS need, COALESCE(free, -1) AS free, round(peak, 2) AS staging_peak,
        (SELECT sum(total) FROM f) < 5368709120 AS below_minimum, CASE WHEN free IS NULL THEN 'unknown'
        WHEN free <= need THEN 'not enough' ELSE 'ok' END AS verdict
    FROM v LEFT JOIN free ON v.volume = free.volume, p""")
def space_preflight(s):
    plan = s.lineitem.join(s.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("vol"), (F.col("l_suppkey") % 4).cast("string")).alias("volume"),
        F.concat(F.lit("f"), "l_returnflag").alias("dest_dir"), F.col("l_orderkey").alias("src"),
        (F.floor("o_totalprice").cast("bigint") * 4096).alias("size"),
        (F.col("o_orderstatus") == "F").alias("at_run_distance"))
    ratios = s.lineitem.select((F.col("l_discount") * 5 + 0.2).alias("ratio"))
    volumes = s.supplier.groupBy(
        F.concat(F.lit("vol"), (F.col("s_suppkey") % 3).cast("string")).alias("volume")).agg(
            F.rint(F.max("s_acctbal") * 100000000).cast("bigint").alias("free"))
    return report.space_preflight(plan, ratios, volumes).select(
        "volume", F.round("need", 2).alias("need"), F.coalesce("free", F.lit(-1)).alias("free"),
        F.round("staging_peak", 2).alias("staging_peak"), "below_minimum", "verdict")


@query("worst_ratio", "A17", """
    SELECT l_returnflag, max(l_discount) AS worst_ratio, count(*) AS samples FROM lineitem GROUP BY l_returnflag""")
def worst_ratio(s):
    return report.worst_ratio(s.lineitem, ["l_returnflag"], "l_discount")


@query("size_stats", "A22", """
    SELECT lang, source, count(*) AS assets, quantile_cont(n_chars, 0.5) AS median,
        round(quantile_cont(n_chars, 0.1), 6) AS low, round(quantile_cont(n_chars, 0.9), 6) AS high
    FROM documents GROUP BY lang, source""")
def size_stats(s):
    out = report.size_stats(s.v_assets, ["lang", "source"], digit_bits=6)
    return out.select("lang", "source", "assets", "median", F.round("low", 6).alias("low"),
                      F.round("high", 6).alias("high"))


@query("size_stats_lines", "A22", """
    SELECT l_returnflag, count(*) AS assets, quantile_cont(q, 0.5) AS median, round(quantile_cont(q, 0.1), 6) AS low,
        round(quantile_cont(q, 0.9), 6) AS high
    FROM (SELECT l_returnflag, CAST(floor(l_extendedprice * 1000) AS BIGINT) AS q FROM lineitem) GROUP BY l_returnflag""")
def size_stats_lines(s):
    rows = s.lineitem.select("l_returnflag", F.floor(F.col("l_extendedprice") * 1000).alias("size"))
    out = report.size_stats(rows, ["l_returnflag"])
    return out.select("l_returnflag", "assets", "median", F.round("low", 6).alias("low"),
                      F.round("high", 6).alias("high"))


@query("failure_signatures", "A25", """
    SELECT CASE WHEN value > 100 THEN 'out of memory' WHEN value > 60 THEN 'refused' WHEN value > 30 THEN 'unreadable'
        ELSE 'error' END AS signature, count(*) AS failures
    FROM v_results WHERE status NOT IN ('ok', 'copied', 'overwrite', 'skipped', 'aborted') GROUP BY 1""")
def failure_signatures(s):
    return report.failure_signatures(s.v_results.filter(report.is_failure()))


@query("spread_sample", "W7", """
    WITH r AS (SELECT path, size, row_number() OVER (ORDER BY size, path) - 1 AS i, count(*) OVER () AS n FROM v_assets)
    SELECT path, size FROM r WHERE i IN (0, CAST(round_even((n - 1) / 4.0, 0) AS BIGINT),
        CAST(round_even((n - 1) / 2.0, 0) AS BIGINT), CAST(round_even((n - 1) * 3 / 4.0, 0) AS BIGINT), n - 1)""")
def spread_sample(s):
    return report.spread_sample(s.v_assets, 5)


@query("top_failures", "L2", """
    WITH r AS (SELECT entry, src, value, row_number() OVER (PARTITION BY entry ORDER BY value DESC, src) AS position,
        count(*) OVER (PARTITION BY entry) AS n FROM v_results WHERE status NOT IN ('ok', 'copied', 'overwrite', 'skipped', 'aborted'))
    SELECT entry, src, value, position, greatest(n - 10, 0) AS more FROM r WHERE position <= 10""")
def top_failures(s):
    failed = s.v_results.filter(report.is_failure()).select("entry", "src", "value")
    return report.top_k(failed, ["entry"], [F.desc("value"), F.col("src")], 10).select(
        "entry", "src", "value", F.col("position").cast("bigint").alias("position"), "more")


@query("largest_groups", "L3", """
    SELECT folder, size FROM (SELECT folder, CAST(sum(size) AS BIGINT) AS size FROM v_assets GROUP BY folder)
    ORDER BY size DESC, folder LIMIT 2""")
def largest_groups(s):
    return report.largest_groups(s.v_assets.groupBy("folder").agg(F.sum("size").alias("size")), "size")


@query("run_summary", "S7", f"""
    WITH f AS (SELECT entry, src, detail, row_number() OVER (PARTITION BY entry ORDER BY src, detail) AS rn
        FROM v_results WHERE status = 'error' OR status NOT IN {COUNTED}),
    l AS (SELECT entry, string_agg(src || ':' || detail, '; ' ORDER BY src, detail) AS failures FROM f WHERE rn <= 200
        GROUP BY entry),
    t AS (SELECT entry, count(*) FILTER (status IN ('ok', 'copied')) AS ok,
        count(*) FILTER (status = 'overwrite') AS overwritten, count(*) FILTER (status = 'skipped') AS skipped,
        count(*) FILTER (status = 'error' OR status NOT IN {COUNTED}) AS errors FROM v_results GROUP BY entry)
    SELECT entry, ok, overwritten, skipped, errors, COALESCE(failures, '') AS failures, errors > 200 AS failures_truncated
    FROM t LEFT JOIN l USING (entry)""")
def run_summary(s):
    out = sinks.run_summary(s.v_results)
    return out.withColumn("failures", F.array_join(F.transform(
        "failures", lambda f: F.concat_ws(":", f["file"], f["reason"])), "; "))


@query("run_failures", "S7", """
    SELECT entry, src AS file, detail AS reason FROM v_results WHERE status NOT IN ('ok', 'copied', 'overwrite', 'skipped', 'aborted')""")
def run_failures(s):
    return sinks.run_failures(s.v_results)


@query("profile_stats", "A15", """
    SELECT lang, count(*) FILTER (source LIKE '%1') AS applied, count(*) FILTER (source NOT LIKE '%1') AS skipped,
        count(*) FILTER (source LIKE '%2') AS already_correct, CAST(0 AS BIGINT) AS skipped_needed,
        count(*) FILTER (source NOT LIKE '%1' AND source NOT LIKE '%2') AS other_illuminant,
        count(DISTINCT CASE WHEN source LIKE '%1' THEN source END) AS profiles_touched
    FROM documents GROUP BY lang""")
def profile_stats(s):
    rows = s.documents.select(
        "lang", F.sha2("source", 256).alias("profile_sha"), F.col("source").like("%2").alias("d50_exact"),
        F.col("source").like("%1").alias("d50_near"), F.lit(300).alias("profile_bytes"))
    return report.profile_stats(rows, keys=["lang"])


@query("profile_stats_approx", "A15")
def profile_stats_approx(s):
    rows = s.documents.select("lang", F.sha2("source", 256).alias("profile_sha"))
    return report.profile_stats_approx(rows, ["lang"])


