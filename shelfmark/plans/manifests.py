"""Everything that spans manifest rows, checked before anything runs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import skew
from shelfmark.config import LayoutConfig, layout_for
from shelfmark.functions import paths as P
from shelfmark.operators import layout, manifest
from shelfmark.session import materialise

# --- fixed values: direction of a manifest -> layout of its outputs -----------------
LAYOUT_OF = {
    "tiff2jxl": "archive", "jxl2tiff": "restore", "jxl2jxl": "derive",
    "jpeg2jxl": "encode", "jxl2jpeg": "decode", "jxl2png": "decode",
}


# Everything about a row that decides which files it reads and where they go.
_SHAPE = ("source", "mode", "out", "rename_from", "rename_to", "marker", "subfolder", "folder", "exclude")


def detected_mode(source: Column, marker: Column, subfolder: Column) -> Column:
    """The mode of an empty cell: an export folder is one (7 with an input subfolder, else 6), anything else is flat."""
    export = F.exists(P.segments(source), lambda part: P.marker_matches(part, marker))
    return F.when(export, F.when(subfolder != "", 7).otherwise(6)).otherwise(0)


def shaped_rows(rows: DataFrame, direction: str, run: Mapping[str, str | None] | None = None,
                where: LayoutConfig | None = None) -> DataFrame:
    """Rows with what their cells and the run's answers (P30) make of their outputs.

    Destination counts in modes 0 and 2 only.  Renames belong to derivative
    directions, exclusions to the scanning ones, the export folder to those that
    write one.  A mode cell that says no mode leaves the row without outputs.
    """
    where = where or layout_for(LAYOUT_OF[direction])
    run = {"ExportMarker": where.export_marker, "ExportSubfolder": where.export_subfolder,
           "ExportJxlFolder": where.export_folder, "ExcludeFolders": ";".join(where.exclude_folders) or None, **(run or {})}
    out = manifest.resolve_options(rows, run, "present" if "present" in rows.columns else None)
    text = lambda name: F.coalesce(F.col(f"opt_{name}"), F.lit(""))
    only = lambda allowed, value: value if direction in allowed else F.lit("")
    source = F.regexp_replace(F.trim("Source"), "(?<=.)/$", "")
    empty = F.trim(F.coalesce("Mode", F.lit(""))) == ""
    mode = F.when(empty, detected_mode(source, text("ExportMarker"), text("ExportSubfolder"))).otherwise(manifest.mode_of())
    dest = F.regexp_replace(F.trim(F.coalesce("Destination", F.lit(""))), "(?<=.)/$", "")
    staged = out.select("row_no", source.alias("source"), mode.alias("mode"), dest.alias("_dest"), only(
        manifest.DERIVATIVE_DIRECTIONS, text("RenameFrom")).alias("rename_from"), only(
        manifest.DERIVATIVE_DIRECTIONS, text("RenameTo")).alias("rename_to"), text("ExportMarker").alias("_marker"),
        text("ExportSubfolder").alias("_subfolder"), F.when(
            F.lit(direction in manifest.EXPORT_FOLDER_DIRECTIONS), text("ExportJxlFolder")).otherwise(where.export_folder).alias("_folder"),
        only(manifest.EXCLUDE_DIRECTIONS, text("ExcludeFolders")).alias("exclude"))
    in_mode = lambda numbers, name: F.when(F.col("mode").isin(*numbers), F.col(name)).otherwise("")
    return staged.filter("mode IS NOT NULL").select(
        "row_no", "source", "mode", in_mode((0, 2), "_dest").alias("out"), "rename_from", "rename_to",
        in_mode((6, 7), "_marker").alias("marker"), in_mode((7,), "_subfolder").alias("subfolder"),
        in_mode((6, 7), "_folder").alias("folder"), "exclude")


def distinct_runs(shaped: DataFrame) -> DataFrame:
    """Rows whose outputs are the same, as one run: its number (the first row's), the last row and how many."""
    return shaped.groupBy(*_SHAPE).agg(
        F.min("row_no").alias("row_no"), F.max("row_no").alias("last_row"), F.count(F.lit(1)).alias("n_rows"))


def planned_outputs(runs: DataFrame, assets: DataFrame, direction: str, where: LayoutConfig | None = None) -> DataFrame:
    """Every distinct run's outputs, planned once: row_no, last_row, n_rows, path, dest.

    All cells that shape an output are columns of the plan.
    """
    where = where or layout_for(LAYOUT_OF[direction])
    expanded = manifest.expand_manifest(
        runs.select("row_no", F.col("source").alias("Source"), F.col("mode").cast("string").alias("Mode")), assets)
    joined = skew.attach(expanded.select("row_no", "path"), runs, ["row_no"])
    joined = joined.filter((F.col("exclude") == "") | ~P.is_excluded(P.folder_parts("path"), F.col("exclude"), F.col("source")))
    own = replace(where, output_root=F.nullif(F.col("out"), F.lit("")), export_marker=F.col("marker"),
                  export_folder=F.col("folder"), export_subfolder=F.col("subfolder"))
    planned = layout.planned_destinations(joined, F.col("mode"), own, root=F.col("source"))
    renamed = layout.rename_outputs(planned, F.col("rename_from"), F.col("rename_to")).filter(F.col("dest").isNotNull())
    return renamed.select("row_no", "last_row", "n_rows", "path", "dest")


# -- folders first, files where two rows can meet --------------------------------------

#: What decides the names that a run writes from one folder into another.
_NAMING = ("rename_from", "rename_to", "only", "folds")


def numbered_runs(shaped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row with its run (the run's first row), and the distinct runs with their second row."""
    first = distinct_runs(shaped)
    of_run = materialise(shaped.join(first.select(*_SHAPE, F.col("row_no").alias("run")), [*_SHAPE]).select("row_no", "run"))
    second = of_run.filter("row_no > run").groupBy("run").agg(F.min("row_no").alias("second_row"))
    runs = first.withColumnRenamed("row_no", "run").join(second, "run", "left")
    return of_run, materialise(runs)


def _covering(folder: str) -> Column:
    """The folders at or above a folder, the top of an absolute path included."""
    top = F.when(F.col(folder).startswith("/") & (F.col(folder) != "/"), F.array(F.lit("/")))
    return F.concat(F.coalesce(top, F.array().cast("array<string>")), P.ancestors(folder))


def _named(assets: DataFrame, where: LayoutConfig) -> DataFrame:
    """Each file's folder and name, the name it gets without a rename and that name's stem: once a file, not once a run."""
    named = assets.select(P.parent("path").alias("at"), P.file_name("path").alias("file"))
    out = F.col("file") if where.extension is None else F.concat(P.stem_of("file"), F.lit(where.extension))
    return named.withColumn("_out", out).withColumn("_stem", P.stem_of("_out"))


def written_files(pairs: DataFrame, assets: DataFrame, where: LayoutConfig) -> DataFrame:
    """``pairs`` (at, naming) with the ``name`` that they give to each file of the folder; files left out are gone.

    The name comes out of a generator, so it is computed once per row.
    """
    file = F.col("file")
    taken = (F.col("only") == "") | (F.when(F.col("folds"), F.lower(file)).otherwise(file) == F.col("only"))
    name = F.when(taken, P.apply_rename("_out", F.col("rename_from"), F.col("rename_to"), F.col("_stem")))
    return pairs.join(_named(assets, where), "at").select(*pairs.columns, F.explode(F.array_compact(F.array(name))).alias("name"))


def reached_folders(runs: DataFrame, assets: DataFrame, direction: str, where: LayoutConfig | None = None) -> DataFrame:
    """Every folder ``at`` that a run reads, with the folder that it writes ``into`` from there.

    Folders, not files, meet the Sources: where a file lands depends on its
    folder alone.  Folders are few bytes and much work: they are dealt to as
    many tasks as a shuffle has, where the adaptive planner would leave them in
    one.  Two exceptions carry the name they are about in ``only``
    (empty: none): a Source that is a file, and files right inside a marker
    folder, which mode 7 takes only if they are called like its subfolder
    (``folds``: in any case).
    """
    where = where or layout_for(LAYOUT_OF[direction])
    tasks = int(assets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By a hash: dealt by the folder itself, as for DISTINCT, the second exchange would be left out as needless.
    folders = assets.select(P.parent("path").alias("at")).distinct().repartition(tasks, F.xxhash64("at"))
    covered = folders.select("at", F.explode(_covering("at")).alias("source"))
    flat = F.col("mode").isin(*manifest.FLAT_MODES)
    below = covered.join(runs, "source").filter(~flat | (F.col("at") == F.col("source"))).withColumn("file", F.lit(None).cast("string"))
    alone = assets.select(F.col("path").alias("source"), P.parent("path").alias("at"), P.file_name("path").alias("file"))
    pairs = below.unionByName(alone.join(runs, "source").select(*below.columns))
    # Any name shows where a folder's files go; one like the subfolder is not left out for being another.
    name = F.coalesce("file", F.when(F.col("subfolder") != "", F.col("subfolder")).otherwise("x"))
    lead = F.when(F.col("at").isin("/", ""), F.col("at")).otherwise(F.concat("at", F.lit("/")))
    pairs = pairs.withColumn("path", F.concat(lead, name))
    pairs = pairs.filter((F.col("exclude") == "") | ~P.is_excluded(P.folder_parts("path"), F.col("exclude"), F.col("source")))
    own = replace(where, output_root=F.nullif(F.col("out"), F.lit("")), export_marker=F.col("marker"),
                  export_folder=F.col("folder"), export_subfolder=F.col("subfolder"))
    planned = layout.planned_destinations(pairs, F.col("mode"), own, root=F.col("source"))
    dirs = P.folder_parts("path")
    by_name = F.when((F.col("mode") == 7) & (F.col("subfolder") != ""), P.marker_anchor(
        dirs, F.col("source"), F.col("marker"), where.fold_case) == F.size(dirs) - 1)
    return planned.select(
        "run", "last_row", "second_row", "n_rows", "at", P.parent("dest").alias("into"), "rename_from", "rename_to",
        F.coalesce("file", F.when(by_name, F.lower("subfolder")), F.lit("")).alias("only"), F.col("file").isNull().alias("folds"))


def written_folders(reached: DataFrame, assets: DataFrame, where: LayoutConfig) -> DataFrame:
    """``reached`` without pairs whose rule about names leaves no file of the folder."""
    picky = (F.col("folds") & (F.col("only") != "")) | ((F.col("rename_from") != "") & (F.trim("rename_to") == ""))
    keys = ["at", *_NAMING]
    asked = reached.filter(picky).select(*keys).distinct()
    alive = written_files(asked, assets, where).select(*keys).distinct()
    return reached.filter(~picky).unionByName(reached.filter(picky).join(alive, keys, "left_semi"))


def cross_row_collisions(reached: DataFrame, writers: DataFrame, assets: DataFrame, where: LayoutConfig) -> DataFrame:
    """Destinations written by more than one manifest row, one line each: the first and last row, and how many.

    Only folders that several rows write into are opened to files.  A file meets
    the *sets of runs* that take it to one folder under one naming, not the
    runs: such a set is one row with its facts, however many runs it holds.
    Where different sets meet in one destination, and only there, their runs
    are counted anew.
    """
    several = writers.groupBy("folder").agg(F.sum("n_rows").alias("_n")).filter("_n > 1").select(F.col("folder").alias("into"))
    sets = materialise(
        reached.join(several, "into", "left_semi").groupBy("at", "into", *_NAMING).agg(
            F.min("run").alias("row_no"), F.max("last_row").alias("last"), F.sum("n_rows").alias("n"),
            F.xxhash64(F.bit_xor(F.xxhash64("run")), F.bit_xor(F.xxhash64("run", F.lit(1))), F.count(F.lit(1))).alias("set")))
    by_set = materialise(written_files(sets, assets, where).groupBy("into", "name", "set").agg(
        F.first("row_no").alias("row_no"), F.first("last").alias("last"), F.first("n").alias("n")))
    by_dest = by_set.groupBy("into", "name").agg(
        F.min("row_no").alias("row_no"), F.max("last").alias("last"), F.max("n").alias("n"), F.count(F.lit(1)).alias("sets"))
    # A set is the same wherever its hash is: its runs are read where it occurs first.
    mixed = by_set.join(by_dest.filter("sets > 1").select("into", "name"), ["into", "name"], "left_semi")
    place = sets.groupBy("set").agg(F.min(F.struct("at", "into", *_NAMING)).alias("p"))
    runs_of = (mixed.select("set").distinct().join(place, "set").select("set", "p.*")
               .join(reached.select("at", "into", *_NAMING, "run", "last_row", "n_rows"), ["at", "into", *_NAMING]).select(
                   "set", "run", "last_row", "n_rows"))
    counted = (mixed.select("into", "name", "set").join(runs_of, "set").groupBy("into", "name", "run").agg(F.first("n_rows").alias("n_rows"))
               .groupBy("into", "name").agg(F.sum("n_rows").alias("_n")))
    found = by_dest.join(counted, ["into", "name"], "left").withColumn("n", F.coalesce("_n", "n")).filter("n > 1")
    dest = F.concat("into", F.when(F.col("into").isin("/", ""), F.lit("")).otherwise(F.lit("/")), "name")
    return found.select("row_no", F.concat_ws(
        " ", dest, F.lit("also row"), F.col("last").cast("string"), F.lit("of"), F.col("n").cast("string")).alias("detail"))


def check_manifest(rows: DataFrame, assets: DataFrame, direction: str, deletes: bool = False,
                   where: LayoutConfig | None = None, run: Mapping[str, str | None] | None = None) -> DataFrame:
    """One row per finding (check, row_no, detail); any finding refuses the run.

    Rows that would do the same are one run; runs meet folders; files are read
    for folders that several rows write into.
    """
    where = where or layout_for(LAYOUT_OF[direction])
    of_run, runs = numbered_runs(shaped_rows(rows, direction, run, where))
    reached = written_folders(materialise(reached_folders(runs, assets, direction, where)), assets, where)
    writers = materialise(reached.groupBy(F.col("into").alias("folder"), "run").agg(
        F.first("second_row").alias("second_row"), F.first("n_rows").alias("n_rows")))
    errors = manifest.validate_manifest(rows, direction, deletes).select(
        F.lit("cell").alias("check"), "row_no", F.concat_ws(": ", "column", "message").alias("detail"))
    overlaps = manifest.source_overlaps(rows).select(
        F.lit("source overlap").alias("check"), "row_no",
        F.concat_ws(" ", "kind", F.col("other_row").cast("string")).alias("detail"))
    collisions = cross_row_collisions(reached, writers, assets, where).select(
        F.lit("duplicate output").alias("check"), "row_no", "detail")
    feeds = manifest.fed_by_runs(rows.join(of_run.withColumnRenamed("run", "_run"), "row_no", "left"), writers).select(
        F.lit("output feeds source").alias("check"), "row_no",
        F.concat_ws(
            " ", "folder", F.col("writer_row").cast("string"), F.concat(F.lit("of "), F.col("writers").cast("string"))).alias("detail"))
    return errors.unionByName(overlaps).unionByName(collisions).unionByName(feeds)
