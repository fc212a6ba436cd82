"""Where things are and where outputs land."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.config import LayoutConfig, layout_for
from shelfmark.functions import paths as P


def path_parts(df: DataFrame, col: str = "path") -> DataFrame:
    """Parent, name, stem, ext and folder parts of a path column."""
    return (
        df.withColumn("dir_parts", P.folder_parts(col))
        .withColumn("parent", P.parent(col))
        .withColumn("name", P.file_name(col))
        .withColumn("stem", P.stem_of(F.col("name")))
        .withColumn("ext", P.suffix_of(F.col("name")))
    )


def _mode(mode) -> Column:
    return F.lit(mode) if isinstance(mode, int) else (F.col(mode) if isinstance(mode, str) else mode)


mode_column = _mode


def _setting(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _needs_anchor(mode) -> bool:
    return not isinstance(mode, int) or mode in (6, 7)


def _with_anchor(df: DataFrame, col: str, root, marker, fold_case: bool, mode) -> DataFrame:
    # Columns of their own: the rules below look at them several times.  Only modes 6 and 7 have an anchor.
    anchor = P.marker_anchor(F.col("_dirs"), root, marker, fold_case)
    if not isinstance(mode, int):
        anchor = F.when(_mode(mode).isin(6, 7), anchor)
    return df.withColumn("_dirs", P.folder_parts(col)).withColumn("_anchor", anchor)


def _destination(mode, cfg: LayoutConfig, col: str, root) -> Column:
    """P5 over staged ``_dirs`` and ``_anchor`` columns.

    ``cfg.output_root``, ``export_marker``, ``export_folder`` and ``export_subfolder``
    may be columns: a manifest row has its own.
    """
    path, file = F.col(col), P.file_name(col)
    out = file if cfg.extension is None else F.concat(P.stem_of(file), F.lit(cfg.extension))
    here = P.parent(col)
    above = P.parent(here)
    flat = F.coalesce(F.lit(cfg.output_root), _setting(root))

    def exported(in_subfolder: Column | None) -> Column:
        dirs, anchor = F.col("_dirs"), F.col("_anchor")
        lead = F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
        export_dir = F.concat(lead, F.concat_ws("/", F.slice(dirs, F.lit(1), anchor + 1)))
        # Exactly one level below the marker is dropped.
        kept = F.slice(dirs, anchor + 3, F.greatest(F.size(dirs) - anchor - 2, F.lit(0)))
        dest = F.concat_ws("/", F.concat(
            F.array(export_dir, F.lit(cfg.export_folder)), kept, F.array(out)))
        inside = anchor.isNotNull()
        return F.when(inside if in_subfolder is None else inside & in_subfolder, dest)

    def in_subfolder() -> Column | None:
        wanted, below = cfg.export_subfolder, F.coalesce(F.get(F.col("_dirs"), F.col("_anchor") + 1), file)
        if isinstance(wanted, Column):  # a manifest's; empty: every subfolder
            return F.coalesce((wanted == "") | (F.lower(below) == F.lower(wanted)), F.lit(True))
        if not wanted:
            return None
        return F.lower(below) == wanted.lower()

    rules = {
        0: lambda: P.join_path(F.coalesce(F.lit(cfg.output_root), here), out),
        1: lambda: P.join_path(here, F.lit(cfg.beside_folder), out),
        2: lambda: P.join_path(F.regexp_replace(flat, "/$", ""), out),
        3: lambda: P.join_path(here, F.lit(cfg.sub_folder), out),
        4: lambda: P.join_path(
            above, P.replace_token(P.file_name(here), cfg.token_from, cfg.token_to), out),
        5: lambda: P.join_path(above, F.lit(cfg.sibling_folder), out),
        6: lambda: exported(None),
        7: lambda: exported(in_subfolder()),
        8: lambda: P.join_path(here, out),
    }
    if isinstance(mode, int):
        return rules[mode]()
    chosen = _mode(mode)
    dest = F.when(chosen == 0, rules[0]())
    for number in range(1, 9):
        dest = dest.when(chosen == number, rules[number]())
    return dest


def resolve_destination(df: DataFrame, mode, direction: str = "archive",
                        cfg: LayoutConfig | None = None, col: str = "path", name: str = "dest",
                        root=None) -> DataFrame:
    """P5: add the planned destination; NULL where the mode leaves a file out.

    ``mode`` is a number or a column (a manifest's); so is ``root``.
    """
    cfg = cfg or layout_for(direction)
    root = cfg.root if root is None else root
    staged = (
        _with_anchor(df, col, root, cfg.export_marker, cfg.fold_case, mode) if _needs_anchor(mode) else df)
    return staged.withColumn(name, _destination(mode, cfg, col, root)).drop("_dirs", "_anchor")


def planned_destinations(df: DataFrame, mode, cfg: LayoutConfig, col: str = "path",
                         name: str = "dest", root=None, select: bool = False) -> DataFrame:
    """P5 with the files the mode leaves out gone (``select``: S10's choice too).

    The destination comes out of a generator, so it is computed once per file:
    as an ordinary column, the "is not null" filter would be pushed below it
    and repeat the whole rule.
    """
    root = cfg.root if root is None else root
    staged = _with_anchor(df, col, root, cfg.export_marker, cfg.fold_case, mode)
    dest = _destination(mode, cfg, col, root)
    if select:
        dest = F.when(_selection(mode, cfg) == "selected", dest)
    columns = [c for c in df.columns if c != name]
    return staged.select(*columns, F.explode(F.array_compact(F.array(dest))).alias(name))


def rename_outputs(df: DataFrame, rename_from, rename_to, col: str = "dest") -> DataFrame:
    """P7 on the planned file name; a refused rename leaves NULL."""
    renamed = P.apply_rename(P.file_name(col), rename_from, rename_to)
    return df.withColumn(col, F.when(renamed.isNotNull(), P.join_path(P.parent(col), renamed)))


def exclude_folders(df: DataFrame, names, root, col: str = "path") -> DataFrame:
    """Leave out files below folders with these names."""
    return df.filter(~P.is_excluded(P.folder_parts(col), names, root))


def skip_tool_output(df: DataFrame, parts: Column, names, suffixes=(), masters=(),
                     requested=None) -> DataFrame:
    """Leave out files inside other tools' output folders."""
    return df.filter(~P.is_tool_output(parts, names, suffixes, masters, requested))


def drop_derivatives(df: DataFrame, label: str = "derived", read_ok: str = "read_ok") -> DataFrame:
    """P10: derived copies leave; a label that could not be read stays."""
    known = F.col(read_ok) & (F.coalesce(F.col(label), F.lit("")) != "")
    return df.filter(~F.coalesce(known, F.lit(False)))


def collapses_structure(df: DataFrame, mode, output_root: str, root) -> DataFrame:
    """Flag runs that drop the source's folder from the output path."""
    return df.withColumn("collapses", P.collapses_structure(
        _mode(mode), F.col(output_root), _setting(root)))


def outside_tree(df: DataFrame, root, dest: str = "dest") -> DataFrame:
    """Planned outputs that land outside the input tree."""
    return df.withColumn("outside", P.outside_tree(F.col(dest), root))


def leftovers(df: DataFrame, col: str = "path") -> DataFrame:
    """Staging leftovers and orphan temps by name."""
    name = P.file_name(col)
    return (
        df.withColumn("staged", P.is_staged_leftover(name))
        .withColumn("temp_for", P.orphan_temp_target(name))
        .filter(F.col("staged"))
    )


def _selection(mode, cfg: LayoutConfig) -> Column:
    """S10 over staged ``_dirs`` and ``_anchor`` columns."""
    mode = _mode(mode)
    dirs, anchor = F.col("_dirs"), F.col("_anchor")
    below_marker = F.slice(dirs, anchor + 2, F.greatest(F.size(dirs) - anchor - 1, F.lit(0)))
    requested = F.when(mode == 7, F.lit(cfg.export_subfolder))
    wanted = cfg.export_subfolder.lower()
    in_subfolder = F.lit(True) if not wanted else F.coalesce(
        F.lower(F.get(dirs, anchor + 1)) == wanted, F.lit(False))
    other = P.is_tool_output(
        below_marker, cfg.skip_names, cfg.skip_suffixes, cfg.master_folders, requested)
    depth = len([p for p in cfg.root.split("/") if p])
    return (
        F.when(~P.under_root(dirs, cfg.root, cfg.fold_case), F.lit("outside root"))
        .when(P.is_excluded(dirs, cfg.exclude_folders, cfg.root), F.lit("excluded folder"))
        .when(mode.isin(0, 1) & (F.size(dirs) > depth), F.lit("below the flat folder"))
        .when(mode.isin(6, 7) & anchor.isNull(), F.lit("outside marker"))
        .when(mode.isin(6, 7) & other, F.lit("other tool's folder"))
        .when((mode == 7) & ~in_subfolder, F.lit("outside subfolder"))
        .otherwise(F.lit("selected")))


def with_selection(df: DataFrame, mode, cfg: LayoutConfig, col: str = "path",
                   name: str = "selection") -> DataFrame:
    """S10: 'selected', or why the mode leaves a file out."""
    staged = _with_anchor(df, col, cfg.root, cfg.export_marker, cfg.fold_case, mode)
    return staged.withColumn(name, _selection(mode, cfg)).drop("_dirs", "_anchor")


def select_sources(df: DataFrame, mode, cfg: LayoutConfig, col: str = "path") -> DataFrame:
    """The files a mode takes."""
    return with_selection(df, mode, cfg, col, "_sel").filter("_sel = 'selected'").drop("_sel")


def selection_counts(df: DataFrame, mode, cfg: LayoutConfig, col: str = "path") -> DataFrame:
    """How many files were taken and left out, by reason."""
    return (
        with_selection(df, mode, cfg, col, "reason")
        .groupBy("reason").agg(F.count(F.lit(1)).alias("files")))
