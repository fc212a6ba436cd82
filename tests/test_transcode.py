"""Guards of conversions: whose output it is decides, and a derived copy only replaces a derived copy."""

import pytest

from shelfmark.functions import paths as P
from shelfmark.plans import transcode

OWN = "own"


def verdicts(spark, outputs, **options):
    """One PNG and one codestream container, each over an output of its own; outputs: dest -> (src, read_ok, out_jbrd, derived)."""
    assets = spark.createDataFrame([("/p/a.png", ".png", 10, "m1"), ("/p/b.jxl", ".jxl", 10, "m2")], "path string, ext string, mtime int, md5 string")
    boxes = spark.createDataFrame([("/p/b.jxl", False)], "path string, has_jbrd boolean")
    ids = {r.path: r.id for r in assets.select("path", P.path_id("path").alias("id")).collect()}
    source = {"/p/a.jxl": "/p/a.png", "/p/b.jpg": "/p/b.jxl"}
    rows = [(d, 5, "x", ids[source[d]] if src == OWN else src, None, read, jbrd, False, derived) for d, (src, read, jbrd, derived) in outputs.items()]
    have = spark.createDataFrame(rows, "dest string, out_mtime int, out_md5 string, src string, srcsum string, read_ok boolean, out_jbrd boolean, "
                                       "broken boolean, derived string")
    journal = spark.createDataFrame([], "folder string, name string, md5 string")
    plan = transcode.plan_transcode(assets, boxes, have, journal, 8, "/p", **options)
    return {r.dest: (r.route, r.verdict, r.reason) for r in plan.collect()}


@pytest.mark.parametrize("record, verdict, reason", [
    ((OWN, True, False, None), "allow", None), (("other", True, False, None), "refuse", "different source"),
    ((None, False, False, None), "refuse", "record unread"), ((None, None, False, None), "refuse", "record unread"),
    ((None, True, True, None), "refuse", "lossless archive"), ((None, True, False, None), "allow", None)])
def test_conversions_over_outputs(spark, record, verdict, reason):
    got = verdicts(spark, {"/p/a.jxl": record, "/p/b.jpg": record})
    assert got == {"/p/a.jxl": ("convert", verdict, reason), "/p/b.jpg": ("decode", verdict, reason)}


def test_without_guard_other_sources_are_warned_about(spark):
    assert verdicts(spark, {"/p/a.jxl": ("other", True, False, None)}, guard=False)["/p/a.jxl"] == ("convert", "warn", "different source")


def test_derived_copies_only_replace_derived_copies(spark):
    got = verdicts(spark, {"/p/a.jxl": (OWN, True, False, None), "/p/b.jpg": (OWN, False, False, "q90")}, label="q90")
    assert got == {"/p/a.jxl": ("convert", "refuse", "not a derived copy"), "/p/b.jpg": ("decode", "refuse", "not a derived copy")}


def test_nothing_there_is_written(spark):
    assert verdicts(spark, {}) == {"/p/a.jxl": ("convert", "allow", None), "/p/b.jpg": ("decode", "allow", None)}
