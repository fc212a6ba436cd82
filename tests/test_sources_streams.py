"""Files in, files out, and streams."""

from pyspark.sql import functions as F

from shelfmark.operators import manifest
from shelfmark.sources import assets, checksums, manifest_csv, meta
from shelfmark.streaming import run_to_table, stream_groups

HOSTILE = "吾妻山 [tmp] 100%"


def test_scan_assets_reads_no_bytes(spark, tmp_path):
    folder = tmp_path / "lib" / "sub"
    folder.mkdir(parents=True)
    for name in ("a.TIF", "b.tif", "c.jpg"):
        (folder / name).write_bytes(b"x" * 10)
    found = assets.scan_assets(spark, str(tmp_path / "lib"), ["tif"])
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.TIF", "b.tif"]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()


def test_read_meta_keeps_unanswered_files(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('[{"SourceFile": "/a", "Relation": "Smith, John"}, {"SourceFile": "/b", "Relation": ["x", "y"]},'
                    '{"SourceFile": "/c", "Error": "bad"}]', encoding="utf-8")
    asked = spark.createDataFrame([("/a",), ("/b",), ("/c",), ("/d",)], "path string")
    got = {r.path: (r.Relation, r.read_ok) for r in meta.read_meta(spark, str(path), asked).collect()}
    assert got == {"/a": (["Smith, John"], True), "/b": (["x", "y"], True), "/c": (None, False), "/d": (None, False)}


def test_checksum_journal_last_line_wins(spark, tmp_path):
    folder = tmp_path / "x"
    folder.mkdir()
    (folder / "checksums.md5").write_text(
        "﻿aa  photo.jxl\n# note\nbb *photo.jxl\ncc  photo.jxl.jxl-md5\n\ndd  other one.jxl\n", encoding="utf-8")
    got = {r["name"]: r.md5 for r in checksums.read_checksums(spark, str(tmp_path / "*")).collect()}
    assert got == {"photo.jxl": "bb", "photo.jxl.jxl-md5": "cc", "other one.jxl": "dd"}


def test_manifest_file(spark, tmp_path):
    path = tmp_path / "manifest_1.csv"
    path.write_text("﻿Source,Destination,Mode,Direction,Resize\n/a,,7.0,tiff2jxl,\n#/b,,3,tiff2jxl,\n,,3,,\n"
                    f"/{HOSTILE}/x,,7.5,tiff2jxl,50%\n/c/../d,,3,tiff2jxl,\n", encoding="utf-8")
    rows, errors = manifest_csv.read_manifest(spark, str(path))
    assert sorted(r.Source for r in rows.collect()) == ["/a", "/c/../d", f"/{HOSTILE}/x"]
    assert sorted((e.column, e.message) for e in errors.collect()) == [
        ("Mode", "mode out of range or fractional"), ("Source", "parent folder in path")]
    resolved = manifest.resolve_options(rows, {"Resize": "long:2048", "Sharpen": "screen"})
    first = resolved.filter("Source = '/a'").collect()[0]
    # Present and empty clears, absent keeps the run's answer.
    assert (first.opt_Resize, first.opt_Sharpen) == (None, "screen")


def test_manifest_without_header_and_unknown_column(spark, tmp_path):
    plain = tmp_path / "manifest_2.csv"
    plain.write_text("/a,,3,tiff2jxl\n", encoding="utf-8")
    assert manifest_csv.read_manifest(spark, str(plain))[0].count() == 1
    odd = tmp_path / "manifest_3.csv"
    odd.write_text("Source,Destination,Mode,Direction,Resise\n/a,,3,tiff2jxl,50%\n", encoding="utf-8")
    _, errors = manifest_csv.read_manifest(spark, str(odd))
    assert [(e.column, e.message) for e in errors.collect()] == [("Resise", "unknown column")]


def test_manifest_with_relative_paths_and_a_broken_line(spark, tmp_path):
    path = tmp_path / "manifest_4.csv"
    path.write_text('Source,Destination,Mode\nalbum,out/new,2\n/abs,,3\nC:\\pics,\\\\host\\share,2\ns3://bucket/a,,3\n"a, b",,3\n', encoding="utf-8")
    rows, errors = manifest_csv.read_manifest(spark, str(path))
    assert sorted((r.Source, r.Destination) for r in rows.collect()) == sorted([
        (f"{tmp_path}/album", f"{tmp_path}/out/new"), ("/abs", ""), ("C:\\pics", "\\\\host\\share"), ("s3://bucket/a", ""), (f"{tmp_path}/a, b", "")])
    assert errors.count() == 0
    path.write_text('Source,Destination,Mode\n"/lib/a\nb",,0\n', encoding="utf-8")
    _, errors = manifest_csv.read_manifest(spark, str(path))
    assert {e.message for e in errors.collect()} == {"line break inside quotes"}


def test_stream_groups_complete_and_truncated(spark, tmp_path):
    """Two files, two batches: a whole document at once, a short one on timeout."""
    schema = "folder string, group_id string, page int, is_thumb boolean, declared int, ts timestamp"
    day = "2024-01-01 00:00:00"
    first = [("/f", "whole", 0, False, 2, day), ("/f", "whole", 1, False, 2, day), ("/f", "whole", 1, False, 2, day),
             ("/f", "short", 0, False, 3, day)]
    later = [("/f", "late", 0, False, 1, "2024-01-03 00:00:00"), ("/f", "whole", 2, False, 2, day)]
    cast = F.col("ts").cast("timestamp").alias("ts")
    cols = ["folder", "group_id", "page", "is_thumb", "declared", cast]
    source = str(tmp_path / "in")
    text = schema.replace("ts timestamp", "ts string")
    spark.createDataFrame(first, text).select(*cols).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    spark.createDataFrame(later, text).select(*cols).coalesce(1).write.mode("append").parquet(source)
    got = sorted((r.group_id, r.pages, r.outcome) for r in run_to_table(stream_groups(stream), "t4").collect())
    # A page beyond the declared ones corrects the outcome; it does not open the document anew.
    assert got == [("late", 1, "complete"), ("short", 1, "truncated"), ("whole", 2, "complete"), ("whole", 3, "overfull")]


def test_stream_groups_judges_a_bucket_in_one_call(spark):
    """Many documents make no more calls than buckets; a told outcome is not told again."""
    import pandas as pd

    from shelfmark.streaming import streams

    class State:
        exists, hasTimedOut, get, timeout = False, False, None, None

        def getCurrentWatermarkMs(self):
            return self.mark

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists, self.get = False, None

        def setTimeoutTimestamp(self, at):
            self.timeout = at

    def rows(pages, day):
        return pd.DataFrame([("/f", str(d), p, 2, pd.Timestamp(f"2024-01-{day:02d}")) for d, p in pages],
                            columns=["folder", "group_id", "member", "declared", "ts"])

    def told(state, pages=None, day=1):
        parts = streams._group_step(3_600_000, "ts")((0,), iter([] if pages is None else [rows(pages, day)]), state)
        return sorted((r.group_id, r.pages, r.outcome) for part in parts for r in part.itertuples())

    state = State()
    state.mark = 0
    first = told(state, [(d, p) for d in range(1000) for p in ((0, 1) if d % 2 else (0,))])
    assert first == sorted((str(d), 2, "complete") for d in range(1, 1000, 2))
    assert told(state, [(1, 0), (1, 2), (2, 1)], 1) == [("1", 3, "overfull"), ("2", 2, "complete")]
    assert told(state, [(1, 3)], 2) == []
    state.mark, state.hasTimedOut = state.timeout + 10, True
    assert told(state) == sorted((str(d), 1, "truncated") for d in range(0, 1000, 2) if d != 2)
    state.mark = state.timeout + 10
    assert told(state) == [] and not state.exists


def test_saved_again_is_another_state_and_a_replay_changes_nothing(spark, tmp_path):
    from shelfmark.streaming import streams

    kind = "path string, dest string, mtime timestamp, size bigint"
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda hour: F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * hour))
    rows = spark.createDataFrame([("/a", "/x/a", 5), ("/a", "/x/a", 5)], "path string, dest string, size bigint")
    rows.withColumn("mtime", at(0)).unionByName(rows.withColumn("mtime", at(1))).select("path", "dest", "mtime", "size").write.parquet(source)
    have = spark.createDataFrame([], "dest string, out_mtime timestamp")
    for k in range(2):  # the second run knows nothing of the first: it replays epoch 0
        stream = streams.stream_assets(spark, source, "30 days", "*.parquet", kind)
        streams.sync_batches(stream, have, sink, checkpoint=str(tmp_path / f"state{k}")).awaitTermination()
        assert spark.read.parquet(sink).count() == 2


def test_manifest_round_trip_of_many_files(spark, tmp_path):
    rows = spark.range(0, 40, 1, 8).select(
        F.format_string("/lib/%03d", "id").alias("Source"), F.lit("").alias("Destination"), F.lit("3").alias("Mode"),
        F.lit("tiff2jxl").alias("Direction"))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 6)
    try:
        manifest_csv.write_manifest(rows, str(tmp_path / "m"))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    read, errors = manifest_csv.read_manifest(spark, str(tmp_path / "m"))
    assert errors.count() == 0
    got = [r.Source for r in read.orderBy("row_no").collect()]
    assert got == [f"/lib/{k:03d}" for k in range(40)]


def test_journal_appended_twice(spark, tmp_path):
    kind = "name string, md5 string, line_no int"
    for k in range(4):
        lines = [("a.jxl", f"v{k}", 1), ("a.jxl", f"w{k}", 2)] + ([("b.jxl", "once", 1)] if k == 1 else [])
        checksums.write_checksums(spark.createDataFrame(lines, kind).repartition(3), str(tmp_path / "j"))
    got = {r["name"]: (r.md5, r.folder) for r in checksums.read_checksums(spark, str(tmp_path / "j")).collect()}
    assert got == {"a.jxl": ("w3", str(tmp_path / "j")), "b.jxl": ("once", str(tmp_path / "j"))}


def test_addresses_of_stores(spark):
    from shelfmark.functions import paths as P

    rows = [("file:/a/b.tif", "/a/b.tif", ""), ("file:///a/b.tif", "/a/b.tif", ""), ("s3a://bucket/a/b.tif", "/a/b.tif", "s3a://bucket"),
            ("hdfs://nn:8020/x", "/x", "hdfs://nn:8020"), ("abfss://c@acct.dfs.core/x y/z", "/x y/z", "abfss://c@acct.dfs.core"), ("/a/b", "/a/b", "")]
    df = spark.createDataFrame(rows, "uri string, path string, store string")
    assert df.filter((P.without_scheme("uri") != F.col("path")) | (P.store_of("uri") != F.col("store"))).count() == 0
    tops = spark.createDataFrame([("/x.tif", "/"), ("x.tif", ""), ("/a/x.tif", "/a"), ("a/x.tif", "a")], "path string, folder string")
    assert tops.filter(P.parent("path") != F.col("folder")).count() == 0


def test_a_number_no_page_can_have_is_part_of_the_name(spark):
    from shelfmark.functions import paths as P

    df = spark.createDataFrame([("DSC_page20240101123456",), ("DSC_page3",)], "stem string")
    got = {r.stem: (r.p.stem, r.p.page) for r in df.withColumn("p", P.parse_page_name("stem")).collect()}
    assert got == {"DSC_page20240101123456": ("DSC_page20240101123456", 0), "DSC_page3": ("DSC", 3)}


def test_scan_assets_lists_many_folders_a_task(spark, tmp_path):
    for n in range(260):
        folder = tmp_path / "lib" / f"f{n}"
        folder.mkdir(parents=True)
        (folder / "a.tif").write_bytes(b"x" * (n + 1))
    context = spark.sparkContext
    context.setJobGroup("listing", "listing")
    found = assets.scan_assets(spark, str(tmp_path / "lib"), ["tif"])
    jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup("listing")]
    stages = [context.statusTracker().getStageInfo(s) for job in jobs for s in job.stageIds]
    context.setJobGroup("rest", "rest")
    assert stages and max(s.numTasks for s in stages) <= 200
    assert found.count() == 260


def test_files_of_documents_lie_in_one_folder_a_source(spark, tmp_path):
    from workload.q_sources import scan_assets

    from types import SimpleNamespace

    rows = [(1, "a b+c%2F*é", "x"), (2, "src1", "yé"), (3, "src1", ""), (4, None, "z"), (5, "..", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = scan_assets(SimpleNamespace(spark=spark, documents=docs))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [(i, source, len(text.encode()) + 1) for i, source, text in rows], key=str)
    assert len({f.rsplit("/", 1)[0] for f in found.sparkSession.read.format("binaryFile").load(
        sorted({f.rsplit("/", 2)[0] for f in found.inputFiles()}), recursiveFileLookup="true").inputFiles()}) == 4


def test_a_file_written_twice_is_the_same_file(spark, tmp_path):
    from shelfmark.sources import sinks

    docs = spark.createDataFrame([("a/x.txt", "one"), ("b/c/y.txt", "two")], "name string, text string")
    for _ in range(2):
        assert sinks.write_files(docs, f"file://{tmp_path}/a%20b", "name", "text") == 2
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["a b/a/x.txt", "a b/b/c/y.txt"]
    assert (tmp_path / "a b" / "b" / "c" / "y.txt").read_bytes() == b"two\n"
