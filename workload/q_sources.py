"""Sources and sinks over data Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.session import is_mounted, working_path
from shelfmark.sources import assets, checksums, manifest_csv, meta, sinks
from workload.q_sync import JOURNAL, journal_lines, plan
from workload.registry import query

#: What Spark names the folder of rows without a value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


@query("scan_assets", "S1", """
    SELECT doc_id, source, CAST(strlen(text) + 1 AS BIGINT) AS size FROM documents""")
def scan_assets(s):
    """Documents written out as files of their own, then listed, never opened."""
    folder = working_path(s.spark, "library")
    if is_mounted(s.spark, folder):
        key = F.replace(F.url_encode(F.coalesce("source", F.lit(NO_VALUE))), F.lit("*"), F.lit("%2A"))
        name = F.concat(F.lit("source="), key, F.lit("/doc_id="), F.col("doc_id").cast("string"), F.lit(".txt"))
        sinks.write_files(s.documents.select(name.alias("name"), "text"), folder, "name", "text")
    else:
        # A store that only Spark's writers reach: a folder per document. Files cost time, not bytes: with their number
        # named, partitions are not merged because they are small.
        tasks = int(s.spark.conf.get("spark.sql.shuffle.partitions"))
        s.documents.select("text", "source", "doc_id").repartition(tasks, "source", "doc_id").write.partitionBy("source", "doc_id").text(folder)
    found = assets.scan_assets(s.spark, folder, ["TXT"])
    place = lambda key, end: F.regexp_extract("path", f"/{key}=([^/]*?){end}", 1)
    return found.select(place("doc_id", "(?:/|[.]txt$)").cast("bigint").alias("doc_id"),
                        F.nullif(F.url_decode(place("source", "/")), F.lit(NO_VALUE)).alias("source"), "size")


@query("read_metadata", "S2", """
    SELECT doc_id, CASE lang WHEN 'en' THEN source WHEN 'fr' THEN source || '|' || lang WHEN 'de' THEN lang || ', ' || source END
        AS relation, lang <> 'es' AND NOT (source LIKE '%1') AS read_ok FROM documents""")
def read_metadata(s):
    # One export per record: a scalar, a list, an error, or no answer at all.
    path = F.concat(F.lit("/lib/吾妻山 [tmp] 100%/"), F.col("doc_id").cast("string"))
    records = s.documents.filter("lang <> 'es'").select(
        path.alias("SourceFile"),
        F.when(F.col("lang") == "en", F.col("source"))
        .when(F.col("lang") == "fr", F.to_json(F.array("source", "lang")))
        .otherwise(F.concat_ws(", ", "lang", "source")).alias("Relation"),
        F.when(F.col("source").like("%1"), "File format error").alias("Error"))
    folder = working_path(s.spark, "meta")
    records.write.json(folder)
    asked = s.documents.select("doc_id", path.alias("path"))
    return meta.read_meta(s.spark, folder, asked, multiline=False).select(
        "doc_id", F.array_join("Relation", "|").alias("relation"), "read_ok")


@query("read_manifest", "S3", """
    SELECT "Source", "Destination", "Mode", "Direction" FROM v_manifest""")
def read_manifest(s):
    folder = working_path(s.spark, "manifest")
    s.v_manifest.select("Source", "Destination", "Mode", "Direction").unionByName(
        s.nation.select(F.concat(F.lit("# "), "n_name").alias("Source"), F.lit("").alias("Destination"),
                        F.lit("3").alias("Mode"), F.lit("").alias("Direction"))
    ).write.option("emptyValue", "").option("nullValue", "").csv(folder)
    rows, _ = manifest_csv.read_manifest(s.spark, folder)
    return rows.select("Source", "Destination", "Mode", "Direction")


@query("manifest_file_errors", "S3", """
    SELECT "column", message, count(*) AS rows FROM (
        SELECT 'Mode' AS "column", 'mode out of range or fractional' AS message FROM v_manifest WHERE Mode = '7.5'
        UNION ALL SELECT 'Source', 'parent folder in path' FROM v_manifest WHERE contains(Destination, '..'))
    GROUP BY 1, 2""")
def manifest_file_errors(s):
    folder = working_path(s.spark, "manifest")
    s.v_manifest.select("Source", "Destination", "Mode", "Direction").write.option(
        "emptyValue", "").csv(folder)
    _, errors = manifest_csv.read_manifest(s.spark, folder)
    return errors.groupBy("column", "message").agg(F.count(F.lit(1)).alias("rows"))


@query("checksum_journal", "S5", f"WITH {JOURNAL} SELECT folder, name, md5, line_no FROM journal")
def checksum_journal(s):
    # As lines of text: starred names, comments between them, a mark in front.
    line = F.concat(F.lit("﻿"), "md5", F.lit("  *"), "name")
    rows = journal_lines(s)
    texts = rows.select("folder", "line_no", line.alias("value")).unionByName(
        rows.select("folder", (F.col("line_no") + 1).alias("line_no"), F.lit("# checked").alias("value")))
    return checksums.last_lines(checksums.parse_journal(texts))


@query("journal_files", "S5 S6", """
    SELECT CAST(user_id AS VARCHAR) || '/' || CAST(event_id % 1000 AS VARCHAR) AS name,
        md5(CAST(max_by(event_id, event_id) FILTER (event_type <> 'click') AS VARCHAR)) AS md5
    FROM events GROUP BY user_id, event_id % 1000 HAVING count(*) FILTER (event_type <> 'click') > 0
    UNION ALL SELECT CAST(user_id AS VARCHAR) || '/' || CAST(event_id % 1000 AS VARCHAR), md5('first' || CAST(max(event_id) AS VARCHAR))
    FROM events GROUP BY user_id, event_id % 1000 HAVING count(*) FILTER (event_type <> 'click') = 0""")
def journal_files(s):
    """Two appends of lines to one journal; the second one's lines count where it has any."""
    folder = working_path(s.spark, "journal")
    name = F.concat_ws("/", F.col("user_id").cast("string"), (F.col("event_id") % 1000).cast("string")).alias("name")
    number = F.col("event_id").cast("string")
    checksums.write_checksums(s.events.select(name, F.md5(F.concat(F.lit("first"), number)).alias("md5"), "event_id"), folder, "event_id")
    later = s.events.filter("event_type <> 'click'").select(name, F.md5(number).alias("md5"), "event_id")
    checksums.write_checksums(later, folder, "event_id")
    return checksums.read_checksums(s.spark, folder).select("name", "md5")


@query("plan_sink", "S9", """
    SELECT folder || '/JXL_16bits' AS dest_dir, count(*) AS outputs FROM v_assets GROUP BY folder""")
def plan_sink(s):
    folder = working_path(s.spark, "plan")
    sinks.write_plan(plan(s), folder)
    return s.spark.read.parquet(folder).groupBy("dest_dir").agg(F.count(F.lit(1)).alias("outputs"))


@query("summary_sink", "S7", """
    SELECT entry, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'skipped') AS skipped
    FROM v_results GROUP BY entry""")
def summary_sink(s):
    folder = working_path(s.spark, "summary")
    sinks.write_summary(sinks.run_summary(s.v_results), folder)
    read = s.spark.read.schema("entry int, ok bigint, skipped bigint").json(folder)
    return read.select("entry", "ok", "skipped")
