"""Structure audits over bytes Spark builds from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import fixed_values as fv
from shelfmark.operators import audit, report
from workload.registry import query


def _u32(value):
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 8, "0"))


def _box(kind: str, payload):
    return F.concat(_u32(F.length(payload) + 8), F.lit(kind).cast("binary"), payload)


def containers(s):
    """One container per document; how it is (un)sound follows its columns.

    The whole text is the codestream: one box for most sources, two parts for
    those ending in 3 (second part unmarked in French) and in 4 (sound).
    """
    text = F.col("text").cast("binary")
    half = F.floor(F.length(text) / 2).cast("int")
    lead = F.substring(text, F.lit(1), half)
    rest = F.substring(text, half + 1, F.length(text))
    tail = F.col("source")

    def part(index, payload):
        return _box("jxlp", F.concat(F.unhex(F.lit(index)), payload))

    plain, empty = _box("jxlc", text), F.lit(b"")
    two = F.concat(part("00000000", lead), part("80000001", rest))
    unmarked = F.concat(part("00000000", lead), part("00000001", rest))
    exif, xmp = _box("Exif", F.lit(b"\x00" * 12)), _box("xml ", F.lit(b"<x/>"))
    packed = _box("brob", F.lit(b"Exif....."))
    lang = F.col("lang")
    before = (F.when(lang == "en", F.concat(exif, xmp)).when(lang == "fr", F.concat(xmp, exif))
              .when(lang == "de", packed).otherwise(empty))
    stream = (
        F.when(tail.like("%5"), empty).when(tail.like("%6"), F.concat(plain, two))
        .when(tail.like("%4"), two).when(tail.like("%3") & (lang == "fr"), unmarked)
        .when(tail.like("%3"), two).otherwise(plain))
    after = F.when(lang == "es", exif).otherwise(empty)
    jbrd = F.when(tail.like("%7"), _box("jbrd", F.lit(b"data"))).otherwise(empty)
    body = F.concat(F.unhex(F.lit(fv.CONTAINER_SIGNATURE_HEX)), _box("ftyp", F.lit(b"jxl \0\0\0\0")), jbrd,
                    before, stream, after)
    whole = (
        F.when(tail.like("%9"), F.substring(body, F.lit(1), F.length(body) - 1))
        .when(tail.like("%8"), F.concat(F.unhex(F.lit("FF0A")), text))
        .when(tail.like("%0"), F.concat(F.lit(b"x"), body))
        .otherwise(body))
    return s.documents.select("doc_id", F.col("doc_id").cast("string").alias("path"), whole.alias("content"))


STATE = """CASE WHEN source LIKE '%8' THEN 'bare codestream' WHEN source LIKE '%0' THEN 'no signature'
        WHEN source LIKE '%9' THEN 'broken chain' WHEN source LIKE '%5' THEN 'no codestream'
        WHEN source LIKE '%6' THEN 'mixed codestream' WHEN source LIKE '%3' AND lang = 'fr' THEN 'incomplete parts'
        ELSE 'ok' END"""
PROBLEM = """CASE lang WHEN 'en' THEN NULL WHEN 'fr' THEN 'after the XMP' WHEN 'de' THEN 'compressed metadata'
        ELSE CASE WHEN source LIKE '%5' OR source LIKE '%9' THEN NULL ELSE 'after the image data' END END"""


@query("container_boxes", "U1", """
    SELECT "type", count(*) AS boxes, CAST(sum("size") AS BIGINT) AS bytes FROM (
      -- One whole codestream; where the last byte is missing, it must not be in the last box.
      SELECT 'jxlc' AS "type", octet_length(encode(text)) + 8 AS "size" FROM documents
      WHERE right(source, 1) NOT IN ('0', '3', '4', '5', '8') AND (source NOT LIKE '%9' OR lang = 'es')
      -- Two parts, counted by the first.
      UNION ALL SELECT 'jxlp', octet_length(encode(text)) + 24 FROM documents WHERE right(source, 1) IN ('3', '4', '6'))
    GROUP BY "type" """)
def container_boxes(s):
    """Codestream boxes of all files; those without a signature have none."""
    boxes = audit.explode_boxes(containers(s))
    return boxes.filter(F.col("type").isin("jxlc", "jxlp")).groupBy("type").agg(
        F.count_if(F.coalesce("part_no", F.lit(0)) == 0).alias("boxes"), F.sum("size").alias("bytes"))


@query("audit_containers", "U2", f"""
    SELECT CAST(doc_id AS VARCHAR) AS path, {STATE} AS state, source LIKE '%7' AS has_jbrd FROM documents""")
def audit_containers(s):
    return audit.audit_containers(containers(s))


@query("audit_layout", "U3", f"""
    SELECT CAST(doc_id AS VARCHAR) AS path, source LIKE '%7' AS has_jbrd, {PROBLEM} AS layout_problem FROM documents
    WHERE source NOT LIKE '%8' AND source NOT LIKE '%0'""")
def audit_layout(s):
    # Files without a container signature have no boxes and so no layout to speak of.
    return audit.audit_layout(audit.explode_boxes(containers(s)))


@query("audit_totals", "A20", f"""
    SELECT {STATE} AS state, count(*) AS containers, count(*) FILTER (({PROBLEM}) IS NOT NULL
        AND source NOT LIKE '%8' AND source NOT LIKE '%0') AS layout_problems FROM documents GROUP BY 1""")
def audit_totals(s):
    files = containers(s)
    boxes = audit.explode_boxes(files)
    layout = audit.audit_layout(boxes).select("path", "layout_problem")
    return report.audit_totals(audit.audit_containers(files, boxes).join(layout, "path", "left"))


def jpegs(s):
    """Marker chains around the text: a thumbnail inside, data, an end or none."""
    thumb = F.lit(b"\xff\xd8\xff\xd9")
    mark = (F.when(F.col("lang") == "en", F.lit(fv.GAIN_MAP_MARKS[1][0]))
            .when(F.col("lang") == "fr", F.lit(fv.GAIN_MAP_MARKS[0][0])).otherwise(F.lit("Exif"))).cast("binary")
    piece = F.concat(mark, thumb)
    app1 = F.concat(F.lit(b"\xff\xe1"), F.unhex(F.lpad(F.hex((F.length(piece) + 2).cast("bigint")), 4, "0")), piece)
    index = F.when(F.col("source").like("%1"), F.lit(b"\xff\xe2\x00\x06MPF\x00")).otherwise(F.lit(b""))
    scan = F.concat(F.lit(b"\xff\xda\x00\x02"), F.col("text").cast("binary"), F.lit(b"\xff\x00\xff\xd0"))
    end = F.when(F.col("source").like("%2"), F.lit(b"")).otherwise(F.lit(b"\xff\xd9"))
    second = F.when(F.col("lang") == "de", F.lit(fv.GAIN_MAP_MARKS[2][0]).cast("binary")).otherwise(F.lit(b""))
    return s.documents.select(
        F.col("doc_id").cast("string").alias("path"),
        F.concat(F.lit(b"\xff\xd8"), app1, index, scan, end, second).alias("content"))


@query("audit_jpegs", "U4", """
    SELECT CAST(doc_id AS VARCHAR) AS path, source NOT LIKE '%2' AS whole FROM documents""")
def audit_jpegs(s):
    return audit.audit_jpegs(jpegs(s))


@query("gain_map_census", "U6", """
    SELECT CAST(doc_id AS VARCHAR) AS path, CASE lang WHEN 'en' THEN 'Ultra HDR' WHEN 'fr' THEN 'ISO 21496-1'
        WHEN 'de' THEN CASE WHEN source LIKE '%1' THEN 'Apple' END END AS gain_map FROM documents""")
def gain_map_census(s):
    return audit.gain_map_census(jpegs(s))


@query("audit_headers", "U5", """
    SELECT CAST(doc_id AS VARCHAR) AS path, CASE lang WHEN 'en' THEN CASE WHEN source LIKE '%3'
        THEN CASE WHEN octet_length(encode(text)) < 12 THEN 'png too short' ELSE 'png without end' END ELSE 'png' END
        WHEN 'fr' THEN CASE WHEN source LIKE '%3' THEN 'tiff byte order mismatch' ELSE 'tiff' END
        WHEN 'de' THEN 'other' ELSE CASE WHEN source LIKE '%3' THEN 'empty' ELSE 'tiff' END END AS header FROM documents""")
def audit_headers(s):
    odd = F.col("source").like("%3")
    text = F.col("text").cast("binary")
    content = (
        F.when((F.col("lang") == "en") & odd, F.concat(F.unhex(F.lit(fv.PNG_SIGNATURE_HEX)), text))
        .when(F.col("lang") == "en", F.concat(
            F.unhex(F.lit(fv.PNG_SIGNATURE_HEX)), text, F.lit(b"\0\0\0\0IEND\xae\x42\x60\x82")))
        .when((F.col("lang") == "fr") & odd, F.concat(F.unhex(F.lit("4949002A")), text))
        .when(F.col("lang") == "fr", F.concat(F.unhex(F.lit("4D4D002A")), text))
        .when(F.col("lang") == "de", text)
        .when(odd, F.lit(b"")).otherwise(F.concat(F.unhex(F.lit("49492B00")), text)))
    return audit.audit_headers(s.documents.select(
        F.col("doc_id").cast("string").alias("path"), content.alias("content")))


def profiles(s):
    """A colour profile per document: header and tags by language and source, the text behind them."""
    lang, tail = F.col("lang"), F.col("source")
    white = (F.when(tail.like("%1"), F.lit("0000F6D6000100000000D32B"))
             .when(tail.like("%2"), F.lit(fv.D50_ILLUMINANT_HEX)).otherwise(F.lit("0000F000000100000000D000")))
    name = (F.when(lang == "en", "sRGB IEC61966").when(lang == "fr", "Adobe RGB (1998)")
            .when(lang == "de", "ProPhoto").otherwise("Scan   ")).cast("binary")
    kind = F.when(tail.like("%3"), F.lit(b"scnr")).otherwise(F.lit(b"mntr"))
    head = F.concat(
        F.unhex(F.lit("00" * 12)), kind, F.lit(b"RGB XYZ "), F.unhex(F.lit("00" * 12)), F.lit(b"acsp"),
        F.unhex(F.lit("00" * 28)), F.unhex(white), F.unhex(F.lit("00" * 48)))
    xyz = [F.concat(F.lit(b"XYZ \0\0\0\0"), F.unhex(F.lit(v))) for v in (
        "00006FA2000038F500000390", "00006299000B7850000018DA".replace("000B", "0000"), "000024A000000F840000B6CF")]
    gamma = F.unhex(F.lit("6375727600000000" + "00000001" + "01CD" + "0000"))
    table = F.unhex(F.lit("6375727600000000" + "00000002" + "0000FFFF"))
    curve = F.when(lang == "de", table).otherwise(gamma)
    lut = F.when(tail.like("%4"), F.lit(b"A2B0")).otherwise(F.lit(b"none"))
    back = F.when(tail.like("%4") & (lang == "en"), F.lit(b"B2A0")).otherwise(F.lit(b"desc"))
    names = [F.lit(b"rXYZ"), F.lit(b"gXYZ"), F.lit(b"bXYZ"), F.lit(b"rTRC"), F.lit(b"gTRC"), F.lit(b"bTRC"), lut, back]
    bodies = [*xyz, curve, curve, curve, F.lit(b"mft2\0\0\0\0\0\0\0\0"), F.concat(F.lit(b"desc\0\0\0\0"), name)]
    sizes = [20, 20, 20, 16, 16, 16, 12]
    offset, entries = 132 + 12 * 8, []
    for i, tag in enumerate(names):
        size = F.lit(sizes[i]) if i < 7 else F.length(bodies[7])
        entries.append(F.concat(tag, _u32(F.lit(offset)), _u32(size)))
        offset += sizes[i] if i < 7 else 0
    data = F.concat(head, _u32(F.lit(8)), *entries, *bodies)
    return s.documents.select("doc_id", "lang", "source", F.md5(data).alias("profile_sha"), data.alias("profile"), "text")


@query("profile_space", "P28", """
    SELECT doc_id, CASE lang WHEN 'en' THEN 'srgb' WHEN 'fr' THEN 'adobe' WHEN 'de' THEN 'prophoto' ELSE 'unknown' END AS space
    FROM documents""")
def profile_space(s):
    return profiles(s).select("doc_id", audit.profile_space("profile").alias("space"))


@query("audit_profiles", "P29", """
    SELECT doc_id, source LIKE '%2' AS d50_exact, source LIKE '%1' AS d50_near, source LIKE '%4' AND lang <> 'en' AS a2b_only,
        source NOT LIKE '%3' AND octet_length(encode(text)) < 51200 - 356 - CASE lang WHEN 'en' THEN 13 WHEN 'fr' THEN 16 WHEN 'de' THEN 8 ELSE 7 END
        AS embeddable FROM documents""")
def audit_profiles(s):
    padded = profiles(s).withColumn("profile", F.concat("profile", F.col("text").cast("binary")))
    return audit.audit_profiles(padded).select("doc_id", "d50_exact", "d50_near", "a2b_only", "embeddable")


@query("profile_tags", "U7", """
    SELECT DISTINCT lang, right(source, 1) IN ('4') AS lut, 8 AS tags, source NOT LIKE '%4' AND lang <> 'de' AS matrix_shaper
    FROM documents""")
def profile_tags(s):
    rows = profiles(s)
    verdict = audit.audit_profile_tags(rows)
    return (
        rows.select("lang", F.col("source").like("%4").alias("lut"), "profile_sha").distinct()
        .join(verdict, "profile_sha").select("lang", "lut", F.col("tags").cast("int").alias("tags"), "matrix_shaper").distinct())


@query("verdict_per_profile", "J12", """
    SELECT doc_id, source NOT LIKE '%4' AND lang <> 'de' AS matrix_shaper FROM documents""")
def verdict_per_profile(s):
    return audit.verdict_per_profile(
        profiles(s).select("doc_id", "profile_sha", "profile"),
        lambda distinct: audit.audit_profile_tags(distinct).select("profile_sha", "matrix_shaper"),
        ["profile_sha"]).select("doc_id", "matrix_shaper")
