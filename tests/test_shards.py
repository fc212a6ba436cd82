"""Joins and text aggregates sort by the shard of their keys, not by paths that all begin alike."""

import re

from pyspark.sql import functions as F

from shelfmark import skew
from shelfmark.functions import paths as P
from shelfmark.operators import groups

PATHS = ["", "/", "a", "/a", "a/b", "/a/b", "//", "//a", "/a/", "a//b", "a/b\n", "/x\n", "/é/ü.x", "x/\n", None]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shard_is_the_first_sort_key(spark):
    rows = spark.range(100).select(F.concat(F.lit("/lib/one/folder/"), F.col("id").cast("string")).alias("path"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.attach(rows, rows.select("path", F.col("id").alias("other")), ["path"])
        grouped = skew.group_facts(rows, ["path"], F.min(F.col("id").cast("string")).alias("low"))
        for plan in (_plan(joined), _plan(grouped)):
            assert re.search(r"Sort \[_shard#\d+", plan)
        assert joined.columns == ["path", "id", "other"] and grouped.columns == ["path", "low"]
        assert joined.filter("id = other").count() == 100 and grouped.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_documents_in_one_aggregation(spark):
    entries = spark.createDataFrame(
        [("/m/k_page1.jxl", "/m", "g", 1, False, 3, 7), ("/m/k_page2.jxl", "/m", "g", 2, False, 3, 9), ("/m/x.jxl", "/m", "h", 0, False, 1, 1)],
        "path string, folder string, group_id string, page int, is_thumb boolean, declared int, mtime int")
    found = groups.documents(entries, F.max("mtime").alias("mtime"), *groups.status_facts())
    assert _plan(found).count("Exchange hashpartitioning") == 1
    rows = found.select("group_id", "members", "main_path", "naming_path", "mtime", groups.status_of().alias("status")).orderBy("group_id").collect()
    assert [tuple(r) for r in rows] == [("g", 2, "/m/k_page1.jxl", "/m/k.jxl", 9, "truncated"), ("h", 1, "/m/x.jxl", "/m/x.jxl", 1, "complete")]


def test_names_and_folders_without_patterns(spark):
    rows = spark.createDataFrame([(p,) for p in PATHS], "t string")
    name = F.regexp_extract("t", r"([^/]*)$", 1)
    folder = F.when(F.col("t").rlike("^/[^/]*$"), "/").otherwise(F.regexp_replace("t", r"(^|/)[^/]*$", ""))
    assert rows.filter(~P.file_name("t").eqNullSafe(name) | ~P.parent("t").eqNullSafe(folder)).count() == 0
    assert "regexp" not in rows.select(P.parent("t"))._jdf.queryExecution().optimizedPlan().toString()


def test_several_tables_are_met_on_one_exchange_of_the_rows(spark):
    rows = spark.range(100).select(F.concat(F.lit("/lib/"), (F.col("id") % 10).cast("string")).alias("dest"), "id").unionByName(
        spark.createDataFrame([(None, 100)], "dest string, id long"))
    low = rows.filter("id < 5").select("dest", F.lit(True).alias("low"))
    high = rows.filter("id >= 97 AND id < 100").select("dest", F.col("id").alias("high"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = skew.attach_each(rows, [low, high], ["dest"])
        assert _plan(met).count("Exchange hashpartitioning") == 3 and met.columns == ["dest", "id", "low", "high"]
        want = skew.attach(skew.attach(rows, low, ["dest"]), high, ["dest"])
        assert sorted(map(tuple, met.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_collisions_and_outputs_are_met_on_one_exchange_of_the_plan(spark):
    from shelfmark.plans import archive

    plan = spark.createDataFrame([("/a", "/x", 1), ("/b", "/x", 9), ("/c", "/y", 1), ("/d", None, 1)], "path string, dest string, mtime int")
    have = spark.createDataFrame([("/x", 5), ("/z", 5)], "dest string, out_mtime int")
    met = archive.meet_outputs(plan, have)
    assert sorted((r.path, r.collides, r.sync) for r in met.collect()) == [
        ("/a", True, "skip"), ("/b", True, "overwrite"), ("/c", False, "write"), ("/d", False, "write")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = _plan(archive.meet_outputs(plan, have))
        assert len(re.findall(r"Exchange hashpartitioning\(_shard", text)) == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_rows_that_write_collide(spark):
    from shelfmark.plans import archive

    plan = spark.createDataFrame([("/a", "/x", "convert"), ("/b", "/x", "skip"), ("/c", "/y", "copy"), ("/d", "/y", "convert"), ("/e", "/y", None),
                                  ("/f", None, "copy")], "path string, dest string, action string")
    got = archive.flag_collisions(plan, writes=F.col("action").isin("convert", "copy"))
    assert sorted(got.columns) == ["action", "collides", "dest", "path"]
    assert sorted((r.path, r.collides) for r in got.collect()) == [
        ("/a", False), ("/b", False), ("/c", True), ("/d", True), ("/e", False), ("/f", False)]


def test_written_sources_without_a_join(spark):
    plan = spark.createDataFrame([("/a", "/1"), ("/a", "/2"), ("/b", "/3"), ("/b", "/3"), ("/c", None), (None, "/4"), ("/d", "/5")],
                                 "src string, dest string")
    results = spark.createDataFrame([("/a", "/1", "ok"), ("/a", "/2", "overwrite"), ("/b", "/3", "error"), ("/c", None, "ok"), (None, "/4", "ok"),
                                     ("/e", "/6", "ok"), ("/d", "/5", "ok"), ("/d", "/7", "ok"), ("/d", "/5", None)],
                                    "src string, dest string, status string")
    done = groups.complete_sources(plan, results)
    assert "Join" not in _plan(done) and sorted(r.src for r in done.collect()) == ["/a", "/d"]


def test_a_document_keeps_only_the_columns_that_decide_it(spark):
    from shelfmark.config import layout_for
    from shelfmark.plans import restore

    entries = spark.createDataFrame(
        [("/m/a.jxl", "/m", "g", 0, False, 2, "c", 0, 5, "x"), ("/m/a_page1.jxl", "/m", "g", 1, False, 2, "c", 0, 7, "y")],
        "path string, folder string, group_id string, page int, is_thumb boolean, declared int, content_id string, subfiletype int, mtime int, extra string")
    outputs = spark.createDataFrame([("/out/a.tif", 6, True)], "dest string, out_mtime int, ours boolean")
    got = restore.plan_restore(entries, outputs, 2, where=layout_for("restore", root="/out"), ours="ours")
    assert [tuple(r) for r in got.collect()] == [("/m/a.jxl", "/out/a.tif", 2, "complete", False, "overwrite")]
    assert "naming_path" not in _plan(got) and "naming_path" not in got._jdf.queryExecution().logical().toString()
