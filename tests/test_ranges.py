"""Header audits by byte ranges: the same findings as from contents, and large files for the price of their headers."""

import os
import struct

import pytest

from shelfmark import fixed_values as fv
from shelfmark.operators import audit
from shelfmark.sources import ranges

SIGNATURE = bytes.fromhex(fv.CONTAINER_SIGNATURE_HEX)
PNG, END = bytes.fromhex(fv.PNG_SIGNATURE_HEX), bytes.fromhex(fv.PNG_END_HEX)


def box(kind, payload, long=False):
    if long:
        return struct.pack(">I4sQ", 1, kind, len(payload) + 16) + payload
    return struct.pack(">I4s", len(payload) + 8, kind) + payload


FTYP = box(b"ftyp", b"jxl \0\0\0\0")
FILES = {
    "whole.jxl": SIGNATURE + FTYP + box(b"jxlc", b"x" * 9000), "long.jxl": SIGNATURE + FTYP + box(b"jxlc", b"x" * 50, long=True),
    "open.jxl": SIGNATURE + FTYP + struct.pack(">I4s", 0, b"jxlc") + b"to the end", "cut.jxl": (SIGNATURE + FTYP + box(b"jxlc", b"x" * 70))[:-1],
    "parts.jxl": SIGNATURE + FTYP + box(b"jxlp", b"\0\0\0\0a") + box(b"jbrd", b"r") + box(b"jxlp", b"\x80\0\0\1b"),
    "unmarked.jxl": SIGNATURE + FTYP + box(b"jxlp", b"\0\0\0\0a") + box(b"jxlp", b"\0\0\0\1b"), "bare.jxl": b"\xff\x0a" + b"x" * 40,
    "nothing.jxl": b"", "no stream.jxl": SIGNATURE + FTYP + box(b"brob", b"Exif1234"), "ünïcode.jxl": b"x" + SIGNATURE + FTYP,
    "a.png": PNG + b"d" * 100 + END, "cut.png": PNG + b"tEXt IEND of the story" + b"d" * 200, "far.png": PNG + END + b"d" * 70_000,
    "trailing.png": PNG + b"d" * 90 + END + b"trailing", "short.png": PNG + b"abc", "le.tif": bytes.fromhex("49492A00") + b"x" * 30,
    "be.tif": bytes.fromhex("4D4D002A") + b"x" * 30, "odd.tif": bytes.fromhex("4949002A") + b"x" * 30}
HEADERS = {"a.png": "png", "cut.png": "png without end", "far.png": "png without end", "trailing.png": "png", "short.png": "png too short",
           "le.tif": "tiff", "be.tif": "tiff", "odd.tif": "tiff byte order mismatch", "nothing.jxl": "empty", "bare.jxl": "other"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    for name, data in FILES.items():
        (path / name).write_bytes(data)
    return str(path)


def catalogue(spark, folder):
    return spark.createDataFrame([(os.path.join(folder, n), len(d)) for n, d in FILES.items()], "path string, length long")


def named(df, *columns):
    return {os.path.basename(r["path"].replace("%20", " ")): tuple(r[c] for c in columns) for r in df.collect()}


def test_containers_like_from_contents(spark, folder):
    whole = audit.audit_containers(spark.createDataFrame(list(FILES.items()), "path string, content binary"))
    files = catalogue(spark, folder)
    assert named(audit.audit_container_files(files), "state", "has_jbrd") == named(whole, "state", "has_jbrd")
    found = ranges.listed(spark, folder, "*.jxl")
    assert named(audit.audit_container_files(found), "state") == {
        k: v[:1] for k, v in named(whole, "state").items() if k.endswith(".jxl") and FILES[k]}
    plan = audit.audit_container_files(found)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    boxes = sorted(map(tuple, audit.box_ranges(files.filter("path like '%parts.jxl'")).drop("path").collect()))
    same = sorted(map(tuple, audit.explode_boxes(spark.createDataFrame([("p", FILES["parts.jxl"])], "path string, content binary")).drop("path").collect()))
    assert boxes == same and len(boxes) == 5


def test_headers_like_from_contents(spark, folder):
    whole = named(audit.audit_headers(spark.createDataFrame(list(FILES.items()), "path string, content binary")), "header")
    found = named(audit.audit_header_files(catalogue(spark, folder)), "header")
    assert found == whole and {k: found[k][0] for k in HEADERS} == HEADERS


def test_a_file_of_three_gigabytes(spark, tmp_path):
    """Sparse on disk: a payload of 3 GB between the headers and a last box."""
    size = 3 << 30
    with open(tmp_path / "huge.jxl", "wb") as f:
        f.write(SIGNATURE + FTYP + struct.pack(">I4sQ", 1, b"jxlc", size + 16))
        f.seek(size, os.SEEK_CUR)
        f.write(box(b"Exif", b"\0" * 12))
    files = ranges.listed(spark, str(tmp_path))
    assert [(r.state, r.has_jbrd) for r in audit.audit_container_files(files).collect()] == [("ok", False)]
    with open(tmp_path / "huge.jxl", "rb") as f:
        def read_at(at, n):
            f.seek(at)
            return f.read(n)

        data = ranges.Ranged(read_at, os.path.getsize(tmp_path / "huge.jxl"))
        assert [kind for kind, *_ in audit._boxes_of(data)] == ["JXL ", "ftyp", "jxlc", "Exif"]
        assert data.bytes_read <= 5 * ranges.BLOCK


def test_files_that_are_gone_or_shorter_than_listed(spark, tmp_path):
    (tmp_path / "a.jxl").write_bytes(FILES["whole.jxl"])
    files = spark.createDataFrame([(str(tmp_path / "a.jxl"), len(FILES["whole.jxl"]) + 10), (str(tmp_path / "gone.jxl"), 500)], "path string, length long")
    assert {os.path.basename(r.path): r.state for r in audit.audit_container_files(files).collect()} == {
        "a.jxl": "broken chain", "gone.jxl": "no signature"}


def test_ranged_is_like_bytes():
    data = bytes(range(256)) * 100
    view = ranges.Ranged(lambda at, n: data[at:at + n], len(data))
    for a, b in ((0, 4), (4090, 4100), (-5, None), (100, 100), (25_590, 30_000), (5, 2)):
        assert view[a:b] == data[a:b]
    assert view[4096] == data[4096] and len(view) == len(data)
    with pytest.raises(IndexError):
        view[len(data)]
