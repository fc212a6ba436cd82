"""Path columns: parts, identities, marker folders, tokens inside names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import fixed_values as fv

_EDGE = r"[_\- ]"
_EDGES = ("_", "-", " ")


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def segments(path) -> Column:
    """All parts of a (non-empty) path, the file name last."""
    return F.split(F.regexp_replace(_col(path), "^/+|/+$", ""), "/+")


def _base(root) -> tuple[Column, Column]:
    """Parts of a root folder and their number; literals when the root is text."""
    if isinstance(root, str):
        parts = [p for p in root.split("/") if p]
        listed = F.array(*[F.lit(p) for p in parts]) if parts else F.array().cast("array<string>")
        return listed, F.lit(len(parts))
    parts = F.filter(segments(root), lambda p: p != "")
    return parts, F.size(parts)


def folder_parts(path) -> Column:
    """The folder parts only."""
    parts = segments(path)
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def file_name(path) -> Column:
    # No pattern: one that is anchored at the end tries every place of the path first.
    return F.substring_index(_col(path), "/", -1)


def parent(path) -> Column:
    """The folder of a path: ``/`` for a file at the top, empty for a bare name."""
    text = _col(path)
    size = F.length(text) - F.length(file_name(text)) - 1
    return F.when(size == 0, F.lit("/")).otherwise(F.substring(text, F.lit(1), size))


def without_scheme(uri) -> Column:
    """The path inside its store: scheme and authority left out."""
    return F.concat(F.lit("/"), F.regexp_replace(_col(uri), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*|^/+", ""))


def store_of(uri) -> Column:
    """Scheme and authority of a file's address (``s3a://bucket``), empty for local files."""
    found = F.regexp_extract(_col(uri), r"^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)", 1)
    return F.when(found.rlike("^file:"), F.lit("")).otherwise(found)


def stem_of(name) -> Column:
    """The name without its last suffix (a leading dot starts no suffix)."""
    return F.regexp_replace(_col(name), r"(?<=.)\.[^.]+$", "")


def suffix_of(name) -> Column:
    """The last suffix with its dot, lower case."""
    return F.lower(F.regexp_extract(_col(name), r".(\.[^.]+)$", 1))


def join_path(*pieces) -> Column:
    return F.concat_ws("/", *[_col(p) if isinstance(p, str) else p for p in pieces])


def path_id(path, fold_case: bool = False) -> Column:
    """The identity of a location, 16 hex digits of its SHA-256."""
    text = F.lower(_col(path)) if fold_case else _col(path)
    return F.substring(F.sha2(text, 256), 1, 16)


def marker_pattern(marker: str) -> str | None:
    """The folder-name pattern of an export marker, or None when it matches nothing."""
    marker = marker.lower()
    if not marker:
        return None
    whole = re.escape(marker)
    options = [f"^{whole}(?:$|{_EDGE})"]
    options.append(f"{whole}$" if marker[0] in _EDGES else f"(?:^|{_EDGE}){whole}$")
    bare = marker.strip("_")
    if bare and bare != marker:
        word = re.escape(bare)
        options += [f"^{word}(?:$|{_EDGE})", f"(?:^|{_EDGE}){word}$"]
    return "|".join(options)


def _edge_at(text: Column, position: Column) -> Column:
    return F.substring(text, position, F.lit(1)).isin(*_EDGES)


def _word_at_edges(text: Column, word: Column, anchored: Column) -> Column:
    """``word`` opens or closes ``text`` as a whole token."""
    size, width = F.length(text), F.length(word)
    opens = text.startswith(word) & ((size == width) | _edge_at(text, width + 1))
    closes = text.endswith(word) & ((size == width) | anchored | _edge_at(text, size - width))
    return (width > 0) & (opens | closes)


def marker_matches(part, marker) -> Column:
    """Does a folder name carry the export marker?  ``marker`` may be a column."""
    text = F.lower(_col(part))
    if isinstance(marker, str):
        pattern = marker_pattern(marker)
        return F.lit(False) if pattern is None else text.rlike(pattern)
    word = F.lower(marker)
    bare = F.regexp_replace(word, "^_+|_+$", "")
    own_edge = F.substring(word, 1, 1).isin(*_EDGES)
    return F.coalesce(
        _word_at_edges(text, word, own_edge)
        | ((bare != word) & (word != "") & _word_at_edges(text, bare, F.lit(False))),
        F.lit(False))


def under_root(dirs: Column, root, fold_case: bool = False) -> Column:
    """Do the folder parts start with the root's?"""
    fold = (lambda c: F.transform(c, lambda p: F.lower(p))) if fold_case else (lambda c: c)
    base, count = _base(root)
    return fold(F.slice(dirs, F.lit(1), count)) == fold(base)


def below_root(dirs: Column, root, fold_case: bool = False) -> Column:
    """Folder parts strictly below ``root``; all of them when not under it."""
    _, count = _base(root)
    rest = F.slice(dirs, count + 1, F.greatest(F.size(dirs) - count, F.lit(0)))
    return F.when(under_root(dirs, root, fold_case), rest).otherwise(dirs)


def marker_anchor(dirs: Column, root, marker, fold_case: bool = False) -> Column:
    """0-based index of the anchoring marker folder, or NULL.

    The first match at or below the root wins (the root itself counts), else
    the closest match above it.  A path outside the root scans from the top.
    """
    fold = (lambda c: F.transform(c, lambda p: F.lower(p))) if fold_case else (lambda c: c)
    hits = F.transform(dirs, lambda part, i: F.when(marker_matches(part, marker), i))
    if root is None:
        return F.array_min(hits)
    base, count = _base(root)
    under = under_root(dirs, root, fold_case)
    # A root that is the file itself: everything is above it.
    is_file = fold(dirs) == fold(F.slice(base, F.lit(1), F.greatest(count - 1, F.lit(0))))
    start = (
        F.when(count == 0, F.lit(0)).when(under, count - 1)
        .when(is_file, F.size(dirs)).otherwise(F.lit(0)))
    return F.coalesce(
        F.array_min(F.filter(hits, lambda i: i >= start)),
        F.array_max(F.filter(hits, lambda i: i < start)))


def replace_token(name, token_from: str, token_to: str) -> Column:
    """Swap the first whole token of a folder name, else append ``_TO``."""
    text = _col(name)
    pattern = (
        rf"(?s)^((?:.*?{_EDGE})?)(?i:{re.escape(token_from)})((?:{_EDGE}.*)?)$")
    swapped = F.concat(
        F.regexp_extract(text, pattern, 1), F.lit(token_to), F.regexp_extract(text, pattern, 2))
    result = F.when(text.rlike(pattern), swapped).otherwise(text)
    return F.when(result == text, F.concat(text, F.lit("_" + token_to))).otherwise(result)


def apply_rename(name, rename_from, rename_to, stem: Column | None = None) -> Column:
    """Literal, case-sensitive, first occurrence, stem only.

    An emptied stem is refused: the result is NULL.  ``stem``: the name's, where
    it is a column already.
    """
    text = _col(name)
    source = F.lit(rename_from) if isinstance(rename_from, str) else rename_from
    target = F.coalesce(F.lit(rename_to) if isinstance(rename_to, str) else rename_to, F.lit(""))
    stem = stem_of(text) if stem is None else stem
    tail = F.substring(text, F.length(stem) + 1, F.length(text))
    at = F.locate(source, stem) if isinstance(source, str) else F.instr(stem, source)
    renamed = F.concat(
        F.substring(stem, F.lit(1), at - 1), target,
        F.substring(stem, at + F.length(source), F.length(stem)))
    applies = source.isNotNull() & (source != "") & (at > 0)
    result = F.when(applies, renamed).otherwise(stem)
    return F.when(F.trim(result) != "", F.concat(result, tail))


def is_excluded(dirs: Column, names, root) -> Column:
    """A folder strictly below the root carries one of ``names`` (words, or a column of ``a;b``; NULL: none)."""
    if isinstance(names, Column):
        listed = F.transform(F.split(F.lower(names), ";"), lambda n: F.trim(n))
        return F.coalesce(F.exists(below_root(dirs, root), lambda part: F.array_contains(listed, F.lower(part))), F.lit(False))
    wanted = [n.lower() for n in names]
    if not wanted or root is None:
        return F.lit(False)
    return F.exists(below_root(dirs, root), lambda part: F.lower(part).isin(*wanted))


def is_tool_output(parts: Column, names: Iterable[str], suffixes: Iterable[str] = (),
                   masters: Iterable[str] = (), requested=None) -> Column:
    """Some folder is another tool's output folder.

    Master folders never count, nor does the explicitly requested one.
    ``requested`` is text or a column (NULL or empty: nothing requested).
    """
    names = [n.lower() for n in names]
    suffixes = [s.lower() for s in suffixes]
    masters = [m.lower() for m in masters]
    wanted = F.lower(F.lit(requested) if isinstance(requested, str) or requested is None
                     else requested)

    def foreign(part):
        low = F.lower(part)
        hit = low.isin(*names) if names else F.lit(False)
        for suffix in suffixes:
            hit = hit | low.endswith(suffix)
        if masters:
            hit = hit & ~low.isin(*masters)
        return hit & ~F.coalesce(low == wanted, F.lit(False))

    return F.exists(parts, foreign)


def collapses_structure(mode, output_root, root) -> Column:
    """Does the run drop the source's folder from the output path?"""
    return F.coalesce(
        mode.isin(*fv.COLLAPSING_MODES)
        | ((mode == 0) & (F.coalesce(output_root, F.lit("")) != "") & (output_root != root)),
        F.lit(False))


def outside_tree(dest, root) -> Column:
    """The destination is not under the root."""
    return ~under_root(segments(dest), root)


def is_staged_leftover(name) -> Column:
    """A name with a 32-hex staging prefix."""
    return _col(name).rlike(fv.STAGED_NAME_PATTERN)


def orphan_temp_target(name) -> Column:
    """The planned name or stem an interrupted write was for, or NULL."""
    return F.nullif(F.regexp_extract(_col(name), fv.ORPHAN_TEMP_PATTERN, 1), F.lit(""))


def parse_page_name(stem, thumbnail_suffix: str = fv.THUMBNAIL_SUFFIX) -> Column:
    """(stem, page, is_thumb) of an output page name."""
    text = _col(stem)
    tail = re.escape(thumbnail_suffix)
    thumb = text.endswith(thumbnail_suffix) if thumbnail_suffix else F.lit(False)
    bare = F.when(thumb, F.regexp_replace(text, f"{tail}$", "")).otherwise(text)
    # A number no page can have is part of the name.
    page = F.nullif(F.regexp_extract(bare, fv.PAGE_NAME_PATTERN, 1), F.lit("")).try_cast("int")
    return F.struct(
        F.when(page.isNotNull(), F.regexp_replace(bare, fv.PAGE_NAME_PATTERN, "")).otherwise(bare).alias("stem"),
        F.coalesce(page, F.lit(0)).alias("page"),
        thumb.alias("is_thumb"))


def ancestors(path, include_self: bool = True) -> Column:
    """Every ancestor folder of a path (and the path itself) as full paths."""
    text = _col(path)
    parts = segments(text)
    lead = F.when(text.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    count = F.size(parts) if include_self else F.size(parts) - 1
    return F.when(count > 0, F.transform(
        F.sequence(F.lit(1), count),
        lambda n: F.concat(lead, F.concat_ws("/", F.slice(parts, F.lit(1), n))))
    ).otherwise(F.array().cast("array<string>"))
