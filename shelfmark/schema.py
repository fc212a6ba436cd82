"""Schemas of the tables the operators exchange."""

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ASSETS = _struct(path=_S, size=_L, mtime=T.TimestampType(), content=T.BinaryType())
META = T.StructType([
    T.StructField("SourceFile", _S), T.StructField("Relation", T.ArrayType(_S)),
    T.StructField("Description", _S), T.StructField("Software", _S),
    T.StructField("HistoryParameters", T.ArrayType(_S)), T.StructField("CreatorTool", _S),
    T.StructField("ImageWidth", _I), T.StructField("ImageHeight", _I),
    T.StructField("Error", _S), T.StructField("read_ok", _B)])
PAGES = T.StructType([
    T.StructField("path", _S), T.StructField("page", _I), T.StructField("subfiletype", _I),
    T.StructField("samples", _I), T.StructField("extrasamples", T.ArrayType(_I)),
    T.StructField("width", _I), T.StructField("height", _I), T.StructField("photometric", _I),
    T.StructField("software", _S), T.StructField("icc_class", _S), T.StructField("bits", _I),
    T.StructField("camera", _B)])
ENTRIES = _struct(path=_S, folder=_S, group_id=_S, page=_I, is_thumb=_B, declared=_I,
                  content_id=_S, subfiletype=_I, depth=_I)
RESULTS = _struct(src=_S, page=_I, status=_S, dest=_S, detail=_S, entry=_I, ts=T.TimestampType())
CHECKSUMS = _struct(folder=_S, line_no=_L, md5=_S, name=_S)
FAILURE = _struct(file=_S, reason=_S)
SUMMARY = T.StructType([
    T.StructField("script", _S), T.StructField("ok", _L), T.StructField("overwritten", _L),
    T.StructField("skipped", _L), T.StructField("errors", _L), T.StructField("unreadable", _L),
    T.StructField("dry_run", _B), T.StructField("extras", T.MapType(_S, _L)),
    T.StructField("failures", T.ArrayType(FAILURE)), T.StructField("failures_truncated", _B)])
