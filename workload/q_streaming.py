"""Streams over the event files, drained to a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.streaming import (
    run_to_table, stream_assets, stream_groups, stream_sessions, stream_status, sync_batches)
from shelfmark.session import working_path
from workload.q_sync import SYNC, existing
from workload.registry import query

# TIMESTAMP_NTZ in the files; a watermark needs an instant.
EPOCH = 1_700_000_000
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(s):
    raw = s.spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(s.sf_dir)
    return raw.select(F.col("ts").cast("timestamp").alias("ts"), "event_id",
                      F.col("user_id").alias("entry"), F.col("event_type").alias("status"))


def shown(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


@query("stream_status", "T2", """
    WITH w AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS s, event_type AS status, count(*) AS results FROM events GROUP BY 1, 2),
    m AS (SELECT max(ts) - INTERVAL '10 minutes' AS mark FROM events)
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS window_start, strftime(s + INTERVAL '6 hours', '%Y-%m-%d %H:%M:%S.%f') AS window_end,
        status, results FROM w, m WHERE s + INTERVAL '6 hours' <= mark""")
def status_tumbling(s):
    out = run_to_table(stream_status(events(s), "6 hours"), "status")
    return out.select(shown("window_start"), shown("window_end"), "status", "results")


@query("stream_status_sliding", "T2", """
    WITH w AS (SELECT s + to_hours(CAST(-k AS INT)) AS s, status FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS s, event_type AS status FROM events),
        (SELECT unnest([0, 1, 2]) AS k)),
    m AS (SELECT max(ts) - INTERVAL '10 minutes' AS mark FROM events)
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS window_start, status, count(*) AS results
    FROM w, m WHERE s + INTERVAL '3 hours' <= mark GROUP BY s, status""")
def status_sliding(s):
    out = run_to_table(stream_status(events(s), "3 hours", "1 hour"), "sliding")
    return out.select(shown("window_start"), "status", "results")


@query("stream_sessions", "T3", """
    WITH g AS (SELECT ts, user_id AS entry, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
        + INTERVAL '20 minutes' THEN 1 ELSE 0 END AS fresh FROM events),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY entry ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g),
    m AS (SELECT max(ts) - INTERVAL '10 minutes' AS mark FROM events)
    SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
        strftime(max(ts) + INTERVAL '20 minutes', '%Y-%m-%d %H:%M:%S.%f') AS session_end, entry,
        count(*) AS results FROM n, m GROUP BY entry, session, mark HAVING max(ts) + INTERVAL '20 minutes' <= mark""")
def sessions(s):
    out = run_to_table(stream_sessions(events(s), "20 minutes"), "sessions")
    return out.select(shown("session_start"), shown("session_end"), "entry", "results")


@query("stream_sync", "T1 J1", f"WITH {SYNC} SELECT dest, sync FROM synced")
def stream_sync(s):
    """Planned rows arrive as files; each micro-batch meets the outputs there are."""
    folder, sink = working_path(s.spark, "arrivals"), working_path(s.spark, "synced")
    arrivals = s.v_assets.select(
        "path", F.concat_ws("/", "folder", F.lit("JXL_16bits"), F.concat("stem", F.lit(".jxl"))).alias("dest"),
        F.timestamp_seconds(F.col("mtime") + EPOCH).alias("mtime"))
    # Everything arrives twice; the second time it is late and ignored.
    arrivals.union(arrivals).write.parquet(folder)
    stream = stream_assets(s.spark, folder, "30 days", "*.parquet", "path string, dest string, mtime timestamp")
    have = existing(s).select("dest", F.timestamp_seconds(F.col("out_mtime") + EPOCH).alias("out_mtime"))
    sync_batches(stream, have, sink).awaitTermination()
    return s.spark.read.parquet(sink).select("dest", "sync")


@query("stream_groups", "T4", """
    WITH p AS (SELECT l_linestatus AS folder, l_orderkey AS k, count(DISTINCT l_linenumber) AS pages,
        count(DISTINCT CASE WHEN l_linenumber <= 2 THEN l_linenumber END) AS early FROM lineitem GROUP BY 1, 2)
    SELECT folder, CAST(k AS VARCHAR) AS group_id, CAST(2 AS INT) AS pages, 'complete' AS outcome FROM p WHERE early = 2
    UNION ALL SELECT folder, CAST(k AS VARCHAR), CAST(pages AS INT), CASE WHEN pages = 2 THEN 'complete' ELSE 'overfull' END
        FROM p WHERE pages > 2 OR pages = 2 AND early < 2""")
def groups_complete(s):
    """Pages of documents in two batches; two pages make a document whole, a late third one is too many."""
    folder = working_path(s.spark, "pages")
    # A page that came twice counts once.
    pages = s.lineitem.select(
        F.col("l_linestatus").alias("folder"), F.col("l_orderkey").cast("string").alias("group_id"),
        F.col("l_linenumber").alias("page"), F.lit(False).alias("is_thumb"), F.lit(2).alias("declared"),
        F.timestamp_seconds(F.lit(EPOCH)).alias("ts"))
    pages.filter("page <= 2").write.parquet(folder)
    first = len(s.spark.read.parquet(folder).inputFiles())
    pages.filter("page > 2").write.mode("append").parquet(folder)
    stream = s.spark.readStream.schema(
        "folder string, group_id string, page int, is_thumb boolean, declared int, ts timestamp").option(
        "maxFilesPerTrigger", first).parquet(folder)
    out = run_to_table(stream_groups(stream), "groups")
    return out.select("folder", "group_id", "pages", "outcome")
