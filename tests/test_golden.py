"""Golden vectors of the scalar rules and policies.

The tables of inputs and outputs below are fixed values: results that must be met.
"""

import pytest
from pyspark.sql import functions as F

from shelfmark import fixed_values as fv
from shelfmark.config import DeriveConfig, PolicyConfig
from shelfmark.functions import paths as P
from shelfmark.functions import recipes as RC
from shelfmark.functions import records as R
from shelfmark.functions import scalars as S
from shelfmark.functions import tokens as T
from shelfmark.operators import groups, policy

HOSTILE = "吾妻山 [tmp] 100%"


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_resize_geometry(spark):
    data = [(8256, 5504, "long", 2048.0, "2048x1365"), (5504, 8256, "long", 2048.0, "1365x2048"),
            (8256, 5504, "short", 1080.0, "1620x1080"), (8256, 5504, "percent", 50.0, "4128x2752"),
            (1000, 800, "long", 2048.0, None), (1000, 800, "percent", 100.0, None), (1000, 800, None, 2048.0, None)]
    df = rows(spark, data, "w int, h int, mode string, v double, want string")
    g = RC.resize_geometry("w", "h", "mode", "v")
    got = df.select("want", F.when(g.isNotNull(), F.concat_ws("x", g["width"], g["height"])).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_classification(spark):
    data = [(0.0, 7, 1.0, 7, "ok"), (0.0, 7, 0.05, 7, "ok"), (0.0, 7, 0.0, 9, "ok"), (0.1, 7, 1.0, 7, "ok"),
            (0.05, 7, 2.0, 9, "ok"), (0.0, 7, 0.0, 7, "downgrade"), (0.0, 9, 0.0, 7, "downgrade"),
            (0.1, 7, 0.1, 5, "downgrade"), (0.1, 7, 0.1, 7, "downgrade"), (0.1, 7, 0.1, 9, "downgrade"),
            (1.0, 7, 0.1, 7, "downgrade"), (1.0, 7, 0.0, 7, "downgrade"), (None, None, 1.0, 7, "unknown"),
            (0.02, 7, 0.05, 7, "downgrade")]
    df = rows(spark, data, "d double, e int, wd double, we int, want string")
    got = df.select("want", policy.classify_reencode("d", "e", "wd", "we").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_recipe_labels(spark):
    data = [("sRGB", "long", 2048.0, False, "screen", "sRGB@long2048+screen"), (None, "percent", 50.0, False, "none", "keep@pct50"),
            ("AdobeRGB", None, None, False, "none", "AdobeRGB"), (None, "short", 1080.0, True, "none", "keep@short1080+up"),
            (None, "long", 320.0, False, "print", "keep@long320+print")]
    df = rows(spark, data, "p string, m string, v double, up boolean, sh string, want string")
    got = df.select("want", RC.recipe_label("p", "m", "v", "up", "sh").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_rederive(spark):
    recipe, encode = "derivative recipe changed", "encode settings changed"
    data = [("sRGB/d1e7", "AdobeRGB/d1e7", True, False, recipe), ("sRGB", "AdobeRGB/d1e7", True, False, recipe),
            ("sRGB/d1e7", "sRGB/d2e7", True, False, encode), ("sRGB/d1e7", "sRGB/d1e9", True, False, encode),
            ("sRGB/d1e7", "sRGB/d2e7", False, False, None), ("sRGB", "sRGB/d4e7", True, False, None),
            ("sRGB/d3e9", "sRGB/d3e7", True, False, None), ("sRGB/d3e9", "sRGB/d3e7", True, True, encode),
            ("sRGB/d3e9s", "sRGB/d3e9", True, False, encode), ("sRGB/d3e9s", "sRGB/d3e7", True, False, encode),
            ("sRGB/d3e9s", "sRGB/d3e7s", True, True, None), ("sRGB/d3e9", "sRGB/d3e9s", True, False, None),
            ("sRGB/d2e7", "sRGB/d2e7s", True, True, None), ("sRGB/d0e7s", "sRGB/d0e9s", True, False, encode),
            ("sRGB/d0e9s", "sRGB/d0e7s", True, False, None)]
    df = rows(spark, data, "a string, b string, c boolean, l boolean, want string")
    got = df.select("want", RC.rederive_reason("a", F.col("b"), F.col("c"), F.col("l")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


PAGE = "path string, page int, subfiletype int, samples int, extrasamples array<int>, width int, height int, " \
       "software string, icc_class string, bits int, camera boolean"


def page_rows(name, software, icc, bits, pages, camera=False, size=None):
    out = []
    for i, (kind, samples, extra) in enumerate(pages):
        w, h = (4000, 3000) if i == 0 or size is None else size
        out.append((name, i, kind, samples, extra, w, h, software if i == 0 else None, icc if i == 0 else None,
                    bits if i == 0 else None, camera if i == 0 else None))
    return out


ONE, TWO = [(0, 3, [])], [(0, 3, []), (0, 3, [])]


@pytest.mark.parametrize("software,icc,bits,pages,camera,size,kind", [
    ("SilverFast 8.8.0", "scnr", 16, [(0, 3, []), (1, 3, []), (4, 1, [])], False, None, "raw"),
    ("SilverFast 8.8.0", "mntr", 16, ONE, False, None, "final"), ("SilverFast 8.8.0", None, 16, ONE, False, None, "raw"),
    ("VueScan 9 x64", "mntr", 16, [(0, 4, [])], False, None, "raw"), ("Negmaster BR", "mntr", 16, [(0, 4, [0])], False, None, "raw"),
    ("Capture One 23", "mntr", 16, TWO, False, None, None), ("Adobe Photoshop", "mntr", 16, [(0, 4, [2])], False, None, None),
    ("", None, 16, ONE, False, None, "raw"), ("", None, 8, ONE, False, None, "final"), ("", None, 16, ONE, True, None, None),
    ("", "mntr", 16, TWO, False, (160, 120), None), ("", None, 8, TWO, False, (120, 160), None),
    ("", "mntr", 16, TWO, False, (320, 240), "final"), ("SilverFast 8.8.0", "mntr", 16, TWO, False, (160, 120), "final"),
    ("", None, 16, [(0, 4, []), (0, 3, [])], False, (160, 120), "raw"),
])
def test_source_kind(spark, software, icc, bits, pages, camera, size, kind):
    df = rows(spark, page_rows("a", software, icc, bits, pages, camera, size), PAGE)
    assert policy.source_kind(df).collect()[0].kind == kind


def test_master_kind(spark):
    data = [([fv.SCAN + "final"], "", "final"), ([fv.SCAN + "raw"], "SilverFast", "raw"), ([fv.SUBFILETYPE + "4"], "", "unknown"),
            ([], "SilverFast 8.8.0 r16", "unknown"), ([], "Capture One 23 | gen=1 | cjxl d=0.1 e=7", None),
            ([fv.ORIGIN + "tiff16"], "", "unknown"), ([fv.ORIGIN + "tiff8"], "gen=1 | cjxl d=0.1 e=7", "unknown"),
            ([fv.ORIGIN + "jpeg"], "", None), ([fv.ORIGIN + "tiff16", fv.SCAN + "no"], "", None)]
    df = rows(spark, data, "t array<string>, s string, want string")
    got = df.select("want", policy.master_kind("t", "s", F.lit(False)).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


@pytest.mark.parametrize("kind,d,scope,label,want", [
    ("raw", 1.0, "all", None, "copy"), ("final", 1.0, "all", None, "copy"), ("final", 1.0, "raw", None, None),
    ("unknown", 1.0, "raw", None, "copy"), ("raw", 0.0, "all", None, None), ("raw", 1.0, "all", "x", None), (None, 1.0, "all", None, None)])
def test_scan_guard(spark, kind, d, scope, label, want):
    df = rows(spark, [(kind,)], "kind string")
    cfg = DeriveConfig(scan_scope=scope, label=label)
    assert df.select(policy.scan_action("kind", d, cfg).alias("a")).collect()[0].a == want


LINEAGE = [("gen=2 | cjxl d=0.05 e=9 | cjxl d=3.0 e=9", 2, 2), ("cjxl d=0.1 e=7", 1, 1), ("gen=5 | cjxl d=0.1 e=7", 1, 5),
           ("gen=1 | cjxl d=0.1 e=7 | cjxl d=0 e=9", 2, 1), ("Project gen=3 phase 2", 0, 0), ("gen=2 | My caption", 0, 2),
           ("Note: cjxl d=1 e=7", 0, 0), ("cjxl d=1.2.3 e=7 | cjxl d=2 e=7", 2, 1),
           ("gen=1 | cjxl d=0.1 e=7 | gen=5 | cjxl d=1.0 e=7", 2, 5), ("gen=abc | cjxl d=0.5 e=7", 1, 1),
           ("Project gen=3 phase 2 | cjxl d=0.5 e=7", 1, 1)]


def test_lineage(spark):
    df = rows(spark, LINEAGE, "t string, n int, g int")
    got = df.select("n", "g", F.size(R.parse_chain("t")).alias("gn"), R.reconciled_gen("t").alias("gg")).collect()
    assert [(r.gn, r.gg) for r in got] == [(r.n, r.g) for r in got]


def test_append_and_strip(spark):
    data = [("gen=1 | cjxl d=0.5 e=7", "0", 9, "gen=1 | cjxl d=0.5 e=7 | cjxl d=0 e=9"), ("", "0", 9, "gen=0 | cjxl d=0 e=9"),
            ("gen=1 | cjxl d=0.1 e=7 | cjxl d=1.0 e=7", "2.0", 7, "gen=3 | cjxl d=0.1 e=7 | cjxl d=1.0 e=7 | cjxl d=2.0 e=7"),
            ("My caption | cjxl d=0.1 e=7", "1.0", 7, "My caption | gen=2 | cjxl d=0.1 e=7 | cjxl d=1.0 e=7")]
    df = rows(spark, data, "t string, d string, e int, want string")
    got = df.select("want", R.append_record("t", "d", "e").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    kept = rows(spark, [("gen=2 | My caption",), ("a | gen=3 | gen=4",), ("Project gen=3 phase 2",)], "t string")
    assert [r[0] for r in kept.select(R.strip_record("t")).collect()] == ["gen=2 | My caption", "a", "Project gen=3 phase 2"]


def test_marker_folders(spark):
    yes = ["_export", "_export_2024", "my_export", "export_lightroom", "lightroom_export", "export", "sports_export", "export_2024"]
    no = ["photos", "exports", "exported_raws", "reexport", "sports_exports", "backup_export_old"]
    df = rows(spark, [(n, True) for n in yes] + [(n, False) for n in no], "n string, want boolean")
    got = df.select("want", P.marker_matches("n", "_EXPORT").alias("a"), P.marker_matches("n", F.lit("_EXPORT")).alias("b"),
                    P.marker_matches("n", "").alias("none")).collect()
    assert all(r.want == r.a == r.b and not r.none for r in got)


def test_marker_anchor(spark):
    path = f"/m/Lightroom_Export/2025/{HOSTILE}/_EXPORT/TIFF16/a.tif"
    root, deep = f"/m/Lightroom_Export/2025/{HOSTILE}", f"/m/Lightroom_Export/2025/{HOSTILE}/_EXPORT/TIFF16"
    df = rows(spark, [(path,)], "path string")
    dirs = P.folder_parts("path")
    at = [P.marker_anchor(dirs, r, "_EXPORT") for r in (root, deep, deep + "/a.tif", None, "/elsewhere [x]")]
    assert list(df.select(*at).collect()[0]) == [4, 4, 4, 1, 1]


def test_tokens_of_folder_names(spark):
    df = rows(spark, [("MyTIFF_TIFF",), ("MyJXLArchive",), ("16B_TIFF",), ("tiff old",)], "n string")
    got = [r[0] for r in df.select(P.replace_token("n", "TIFF", "JXL")).collect()]
    assert got == ["MyTIFF_JXL", "MyJXLArchive_JXL", "16B_JXL", "JXL old"]


def test_hostile_paths(spark):
    from shelfmark.config import layout_for
    from shelfmark.operators import layout

    df = rows(spark, [(f"/{HOSTILE}/s.1/photo.v2.tif",)], "path string")
    parts = layout.path_parts(df).collect()[0]
    assert (parts.parent, parts["name"], parts.stem, parts.ext) == (f"/{HOSTILE}/s.1", "photo.v2.tif", "photo.v2", ".tif")
    for mode, want in {1: f"/{HOSTILE}/s.1/converted_jxl/photo.v2.jxl", 5: f"/{HOSTILE}/JXL_16bits/photo.v2.jxl",
                       6: None, 8: f"/{HOSTILE}/s.1/photo.v2.jxl"}.items():
        out = layout.resolve_destination(df, mode, cfg=layout_for("archive", root=f"/{HOSTILE}"))
        assert out.collect()[0].dest == want


def test_sizes_and_mime(spark):
    df = rows(spark, [(1024 ** 4 * 3, "3.0 TB"), (1536, "2 KB"), (2560, "2 KB"), (433009623040, "403.3 GB"),
                      (432979771392, "403.2 GB")], "n bigint, want string")
    got = df.select("want", S.fmt_size("n").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_group_status(spark):
    schema = "path string, folder string, group_id string, page int, is_thumb boolean, declared int, content_id string, subfiletype int"

    def group(name, pages):
        return [(f"/f/{name}_page{p}.jxl", "/f", name, p, False, d, "c", 0) for p, d in pages]

    data = (group("gap", [(0, 2), (2, 2)]) + group("short", [(0, 3), (1, 3)]) + group("odd", [(0, 2), (1, 3)])
            + group("lone", [(1, None)]) + group("plain", [(0, None), (2, None)]) + group("over", [(0, 1), (1, 1)]))
    got = {r.group_id: r.status for r in groups.group_status(rows(spark, data, schema)).collect()}
    assert got == {"gap": "complete", "short": "truncated", "odd": "inconsistent", "lone": "fragment", "plain": "complete",
                   "over": "overfull"}


def test_origin_and_distance(spark):
    df = rows(spark, [(["x"], False), ([fv.ORIGIN + "jpeg"], True), ([fv.DEPTH + "8"], False), (["x"], True)],
              "t array<string>, rec boolean")
    assert [r[0] for r in df.select(T.output_origin("t", "rec", "tiff16")).collect()] == ["tiff16", "jpeg", None, None]
    bits = rows(spark, [("raw", 16), (None, 8), (None, 16)], "kind string, bits int")
    assert [r[0] for r in bits.select(policy.assign_distance("kind", "bits", PolicyConfig(distance=1.0))).collect()] == [0.0, 1.0, 1.0]
