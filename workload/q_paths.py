"""Paths, layout and source selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.config import layout_for
from shelfmark.functions import paths as P
from shelfmark.operators import audit, layout, manifest, report
from workload.registry import query

BUCKET = ("CASE doc_id % 3 WHEN 0 THEN '_EXPORT' WHEN 1 THEN 'Lightroom_Export' ELSE 'raw' END")
ROLL = "'r' || CAST(CAST(floor(doc_id / 40) AS INT) AS VARCHAR)"


def marker_sql(part: str, marker: str) -> str:
    """The marker rule spelt with plain string functions."""
    m, bare = f"lower({marker})", f"trim(lower({marker}), '_')"

    def edge(at: str) -> str:
        return f"substr(lower({part}), {at}, 1) IN ('_', '-', ' ')"

    def at_edges(word: str, anchored: str) -> str:
        return (
            f"({word} <> '' AND ((starts_with(lower({part}), {word}) AND (length({part}) = length({word})"
            f" OR {edge(f'length({word}) + 1')})) OR (ends_with(lower({part}), {word}) AND"
            f" (length({part}) = length({word}) OR {anchored}"
            f" OR {edge(f'length({part}) - length({word})')}))))")

    own = f"left({m}, 1) IN ('_', '-', ' ')"
    return f"({at_edges(m, own)} OR ({bare} <> {m} AND {m} <> '' AND {at_edges(bare, 'FALSE')}))"


@query("path_parts", "P1", """
    SELECT page_id, regexp_replace(path, '/[^/]*$', '') AS parent, parts[-1] AS name,
           CASE WHEN dot > 1 THEN left(parts[-1], dot - 1) ELSE parts[-1] END AS stem,
           CASE WHEN dot > 1 THEN lower(substr(parts[-1], dot)) ELSE '' END AS ext,
           len(parts) - 1 AS depth, list_aggregate(parts[1:len(parts) - 1], 'string_agg', '>') AS dirs
    FROM (SELECT *, CASE WHEN position('.' IN parts[-1]) = 0 OR ends_with(parts[-1], '.') THEN 0
                    ELSE length(parts[-1]) - position('.' IN reverse(parts[-1])) + 1 END AS dot
          FROM (SELECT page_id, path, [x FOR x IN string_split(path, '/') IF x <> ''] AS parts
                FROM v_urls))""")
def path_parts(s):
    return layout.path_parts(s.v_urls).select(
        "page_id", "parent", "name", "stem", "ext", F.size("dir_parts").cast("bigint").alias("depth"),
        F.when(F.size("dir_parts") > 0, F.array_join("dir_parts", ">")).alias("dirs"))


@query("path_identity", "P2", """
    SELECT doc_id, left(sha256(path), 16) AS path_id, left(sha256(lower(path)), 16) AS folded_id
    FROM v_assets""")
def path_identity(s):
    return s.v_assets.select(
        "doc_id", P.path_id("path").alias("path_id"), P.path_id("path", True).alias("folded_id"))


@query("marker_match", "P3", f"""
    SELECT p_partkey, {marker_sql('p_name', "'ring'")} AS literal,
           {marker_sql('p_name', 'marker')} AS per_row
    FROM (SELECT *, CASE p_size % 4 WHEN 0 THEN '_Widget' WHEN 1 THEN 'ring' WHEN 2 THEN '_red'
                    ELSE '' END AS marker FROM part)""")
def marker_match(s):
    marker = (F.when(F.col("p_size") % 4 == 0, "_Widget").when(F.col("p_size") % 4 == 1, "ring")
              .when(F.col("p_size") % 4 == 2, "_red").otherwise(""))
    return s.part.select(
        "p_partkey", P.marker_matches("p_name", "ring").alias("literal"),
        P.marker_matches("p_name", marker).alias("per_row"))


@query("marker_anchor", "P4", f"""
    WITH parts AS (
      SELECT doc_id, unnest([x FOR x IN string_split(folder, '/') IF x <> '']) AS part,
             generate_subscripts([x FOR x IN string_split(folder, '/') IF x <> ''], 1) - 1 AS i
      FROM v_assets),
    hits AS (SELECT doc_id, min(i) AS first_hit, max(i) AS last_hit FROM parts
             WHERE {marker_sql('part', "'_EXPORT'")} GROUP BY doc_id)
    SELECT a.doc_id, COALESCE(first_hit, -1) AS under_root, COALESCE(first_hit, -1) AS no_root,
           COALESCE(last_hit, -1) AS inside
    FROM v_assets a LEFT JOIN hits USING (doc_id)""")
def marker_anchor(s):
    dirs = P.folder_parts("path")

    def shown(anchor, name):
        return F.coalesce(anchor, F.lit(-1)).cast("bigint").alias(name)

    return s.v_assets.select(
        "doc_id", shown(P.marker_anchor(dirs, "/lib", "_EXPORT"), "under_root"),
        shown(P.marker_anchor(dirs, None, "_EXPORT"), "no_root"),
        # A root inside the marker folder anchors on the closest one above.
        shown(P.marker_anchor(dirs, F.col("folder"), "_EXPORT"), "inside"))


@query("destination_by_mode", "P5", f"""
    SELECT doc_id, CASE doc_id % 9
        WHEN 0 THEN folder || '/' || stem || '.jxl'
        WHEN 1 THEN folder || '/converted_jxl/' || stem || '.jxl'
        WHEN 2 THEN '/lib/' || stem || '.jxl'
        WHEN 3 THEN folder || '/JXL_16bits/' || stem || '.jxl'
        WHEN 4 THEN '/lib/' || source || '/' || {BUCKET} || '/' || {ROLL} || '/'
                    || CASE lang WHEN 'en' THEN 'JXL' ELSE lang || '_JXL' END || '/' || stem || '.jxl'
        WHEN 5 THEN '/lib/' || source || '/' || {BUCKET} || '/' || {ROLL} || '/JXL_16bits/' || stem || '.jxl'
        WHEN 8 THEN folder || '/' || stem || '.jxl'
        ELSE CASE WHEN doc_id % 3 < 2 AND (doc_id % 9 = 6 OR {ROLL} = 'r1')
             THEN '/lib/' || source || '/' || {BUCKET} || '/16B_JXL/' || lang || '/' || stem || '.jxl' END
        END AS dest
    FROM v_assets""")
def destination_by_mode(s):
    where = layout_for("archive", root="/lib", token_from="EN", export_subfolder="R1")
    return layout.resolve_destination(
        s.v_assets, F.col("doc_id") % 9, cfg=where).select("doc_id", "dest")


@query("destination_restore", "P5", f"""
    SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN '/lib/' || source || '/' || {BUCKET} || '/16B_TIFF/'
        || lang || '/' || stem || '.tif' END AS marker_dest,
        folder || '/recompressed_jxl/' || stem || '.tif' AS beside_dest
    FROM v_assets""")
def destination_restore(s):
    plan = layout.resolve_destination(s.v_assets, 6, "restore", layout_for("restore", root="/lib"),
                                      name="marker_dest")
    return layout.resolve_destination(
        plan, 1, "derive", layout_for("derive", root="/lib"), name="beside_dest").select(
            "doc_id", "marker_dest", "beside_dest")


@query("replace_folder_token", "P6", """
    SELECT p_partkey, CASE WHEN words[1] = 'ring' THEN 'BAND' || substr(p_name, 5)
        WHEN words[-1] = 'ring' THEN left(p_name, length(p_name) - 4) || 'BAND'
        ELSE p_name || '_BAND' END AS renamed
    FROM (SELECT p_partkey, p_name, string_split(p_name, ' ') AS words FROM part)""")
def replace_folder_token(s):
    return s.part.select("p_partkey", P.replace_token("p_name", "RING", "BAND").alias("renamed"))


@query("rename_outputs", "P7", """
    SELECT doc_id, folder || '/' || CASE WHEN position('00' IN stem) > 0
        THEN left(stem, position('00' IN stem) - 1) || '-x-' || substr(stem, position('00' IN stem) + 2)
        ELSE stem END || '.tif' AS dest,
        CASE WHEN stem <> 'DSC_0001' THEN stem || '.tif' END AS refused_when_empty
    FROM v_assets""")
def rename_outputs(s):
    plan = s.v_assets.withColumn("dest", F.col("path"))
    return layout.rename_outputs(plan, "00", "-x-").select(
        "doc_id", "dest",
        P.apply_rename(P.file_name("path"), "DSC_0001", "").alias("refused_when_empty"))


@query("exclude_folders", "P8", f"""
    SELECT doc_id FROM v_assets WHERE lang <> 'en' AND {BUCKET} <> 'raw'""")
def exclude_folders(s):
    return layout.exclude_folders(s.v_assets, ["EN", "raw", "lib"], "/lib").select("doc_id")


@query("skip_tool_output", "P9", f"""
    SELECT doc_id FROM v_assets
    WHERE NOT ({ROLL} <> 'r2' AND {ROLL} <> 'r10' AND ({ROLL} IN ('r1', 'r2') OR ends_with({ROLL}, '0')))""")
def skip_tool_output(s):
    below = F.slice(P.folder_parts("path"), 4, 10)
    return layout.skip_tool_output(
        s.v_assets, below, ["R1", "R2"], ["0"], ["r10"], "R2").select("doc_id")


@query("drop_derivatives", "P10", """
    SELECT doc_id FROM v_existing WHERE NOT (read_ok AND derived IS NOT NULL)""")
def drop_derivatives(s):
    return layout.drop_derivatives(s.v_existing).select("doc_id")


@query("parse_page_names", "P18", """
    SELECT path, 'o' || group_id AS stem, CAST(page AS INT) AS page, is_thumb FROM v_entries""")
def parse_page_names(s):
    parsed = P.parse_page_name(P.stem_of(P.file_name("path")))
    return s.v_entries.select("path", parsed["stem"].alias("stem"), parsed["page"].alias("page"),
                              parsed["is_thumb"].alias("is_thumb"))


@query("collapses_structure", "P32", """
    SELECT row_no, COALESCE(TRY_CAST(Mode AS DOUBLE) IN (2, 4, 5, 6, 7)
        OR (TRY_CAST(Mode AS DOUBLE) = 0 AND Destination <> '' AND Destination <> Source), FALSE) AS collapses
    FROM v_manifest""")
def collapses_structure(s):
    rows = s.v_manifest.withColumn("mode", F.col("Mode").try_cast("double"))
    return layout.collapses_structure(rows, F.col("mode"), "Destination", F.col("Source")).select(
        "row_no", "collapses")


@query("outside_tree", "P33", f"""
    SELECT doc_id, NOT ({ROLL} = 'r1' AND source = 'src1' AND {BUCKET} = 'raw') AS outside FROM v_assets""")
def outside_tree(s):
    where = layout_for("archive", root="/lib/src1/raw/r1")
    return layout.outside_tree(layout.resolve_destination(s.v_assets, 5, cfg=where), where.root).select(
        "doc_id", "outside")


def _temps(s):
    """Asset names as an interrupted run would leave them."""
    digest = F.md5(F.col("text"))
    name = (
        F.when(F.col("lang") == "en", F.concat(digest, F.lit("_"), "stem", F.lit(".jxl.tmp")))
        .when(F.col("lang") == "fr", F.concat(
            digest, F.lit("_"), digest, F.lit("_repair_"), "stem", F.lit(".tmp.tmp")))
        .when(F.col("lang") == "de", F.concat(digest, F.lit("_"), "stem", F.lit(".jxl")))
        .otherwise(F.concat("stem", F.lit(".jxl.tmp"))))
    return s.v_assets.select(
        "doc_id", "lang", F.concat_ws("/", "folder", F.lit("JXL_16bits"), name).alias("path"))


@query("staging_leftovers", "P34", """
    SELECT doc_id, CASE lang WHEN 'en' THEN stem || '.jxl' WHEN 'fr' THEN stem END AS temp_for
    FROM v_assets WHERE lang IN ('en', 'fr', 'de')""")
def staging_leftovers(s):
    return layout.leftovers(_temps(s)).select("doc_id", "temp_for")


@query("orphan_temps", "J13", """
    SELECT a.doc_id FROM v_assets a JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr')""")
def orphan_temps(s):
    plan = s.v_existing.select("dest")
    return audit.orphan_temps(_temps(s), plan).select("doc_id")


@query("select_sources", "S10", f"""
    SELECT reason, count(*) AS files FROM (
      SELECT CASE WHEN lang = 'fr' THEN 'excluded folder'
        WHEN doc_id % 9 < 2 THEN 'below the flat folder'
        WHEN doc_id % 9 IN (6, 7) AND {BUCKET} = 'raw' THEN 'outside marker'
        WHEN doc_id % 9 IN (6, 7) AND {ROLL} = 'r3' THEN 'other tool''s folder'
        WHEN doc_id % 9 = 7 AND {ROLL} <> 'r1' THEN 'outside subfolder'
        ELSE 'selected' END AS reason FROM v_assets) GROUP BY reason""")
def select_sources(s):
    where = layout_for("archive", root="/lib", exclude_folders=("fr",), skip_names=("r3",),
                       export_subfolder="R1")
    return layout.selection_counts(s.v_assets, F.col("doc_id") % 9, where)


@query("selected_files", "S10", f"""
    SELECT doc_id FROM v_assets WHERE {BUCKET} <> 'raw' AND {ROLL} NOT IN ('r3')""")
def selected_files(s):
    where = layout_for("archive", root="/lib", skip_names=("R3",))
    return layout.select_sources(s.v_assets, 6, where).select("doc_id")


@query("duplicate_destinations", "A1", f"""
    WITH plan AS (
      SELECT path, '/lib/' || source || '/' || {BUCKET} || '/16B_JXL/' || lang || '/' || stem || '.jxl' AS dest
      FROM v_assets WHERE doc_id % 3 < 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY dest ORDER BY path) AS rn,
                      count(*) OVER (PARTITION BY dest) AS n FROM plan)
    SELECT dest, n AS sources, string_agg(path, ' | ' ORDER BY path) AS sample, greatest(n - 4, 0) AS more
    FROM ranked WHERE n > 1 AND rn <= 4 GROUP BY dest, n""")
def duplicate_destinations(s):
    plan = layout.resolve_destination(s.v_assets, 6, cfg=layout_for("archive", root="/lib"))
    return report.duplicate_destinations(plan).withColumn("sample", F.array_join("sample", " | "))


@query("duplicate_destinations_flat", "A1", """
    WITH ranked AS (
      SELECT '/lib/' || stem || '.jxl' AS dest, path,
             row_number() OVER (PARTITION BY stem ORDER BY path) AS rn, count(*) OVER (PARTITION BY stem) AS n
      FROM v_assets)
    SELECT dest, n AS sources, string_agg(path, ' | ' ORDER BY path) AS sample, greatest(n - 4, 0) AS more
    FROM ranked WHERE n > 1 AND rn <= 4 GROUP BY dest, n""")
def duplicate_destinations_flat(s):
    plan = layout.resolve_destination(s.v_assets, 2, cfg=layout_for("archive", root="/lib"))
    return report.duplicate_destinations(plan).withColumn("sample", F.array_join("sample", " | "))


@query("refuse_on_collision", "A1", """
    SELECT count(*) AS collisions, CAST(sum(n) AS BIGINT) AS colliding_sources, count(*) > 0 AS refused
    FROM (SELECT stem, count(*) AS n FROM v_assets GROUP BY stem HAVING count(*) > 1)""")
def refuse_on_collision(s):
    plan = layout.resolve_destination(s.v_assets, 2, cfg=layout_for("archive", root="/lib"))
    return report.refuse_on_collision(plan)


@query("plan_order", "L1", "SELECT path, size FROM v_assets ORDER BY path")
def plan_order(s):
    return report.order_plan(s.v_assets.select("path", "size"))


@query("recommend_mode", "A21", f"""
    SELECT source, count(*) AS files, count(DISTINCT folder) AS folders, 4 AS depth,
        bool_or({BUCKET} <> 'raw') AS has_marker,
        CASE WHEN NOT bool_or({BUCKET} <> 'raw') THEN 3
             WHEN count(DISTINCT CASE WHEN {BUCKET} <> 'raw' THEN {ROLL} END) = 1 THEN 7 ELSE 6 END AS mode
    FROM v_assets GROUP BY source""")
def recommend_mode(s):
    return report.recommend_mode(s.v_assets, root="/lib", keys=["source"])


@query("generate_manifest_recursive", "S4", """
    SELECT DISTINCT folder AS "Source", '' AS "Destination", '3' AS "Mode", 'tiff2jxl' AS "Direction"
    FROM v_assets""")
def generate_manifest_recursive(s):
    return manifest.generate_manifest(s.v_assets, 3, "tiff2jxl")


@query("generate_manifest_outermost", "S4", """
    WITH f AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM v_urls)
    SELECT folder AS "Source", '' AS "Destination", '8' AS "Mode", 'jpeg2jxl' AS "Direction"
    FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE starts_with(f.folder, o.folder || '/'))""")
def generate_manifest_outermost(s):
    return manifest.generate_manifest(s.v_urls, 8, "jpeg2jxl")


@query("generate_manifest_marker", "S4", f"""
    SELECT DISTINCT '/lib/' || source || '/' || {BUCKET} AS "Source", '' AS "Destination", '6' AS "Mode",
        'tiff2jxl' AS "Direction" FROM v_assets WHERE {BUCKET} <> 'raw'""")
def generate_manifest_marker(s):
    return manifest.generate_manifest(s.v_assets, 6, "tiff2jxl", root="/lib")
