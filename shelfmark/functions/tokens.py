"""Marker tokens: namespaced strings inside a record's ``Relation`` list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import fixed_values as fv
from shelfmark.functions.numbers import whole_number


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean(tokens) -> Column:
    """Trimmed, non-empty tokens; a NULL list reads as empty."""
    return F.filter(
        F.transform(F.coalesce(_col(tokens), F.array().cast("array<string>")), lambda x: F.trim(x)),
        lambda t: t != "")


def _carried(cleaned: Column, prefix: str) -> Column:
    """``values_of`` over tokens that are clean already."""
    return F.transform(
        F.filter(cleaned, lambda t: t.startswith(prefix)),
        lambda t: F.substring(t, F.lit(len(prefix) + 1), F.length(t)))


def values_of(tokens, prefix: str) -> Column:
    """All values carried under ``prefix`` in list order."""
    return _carried(clean(tokens), prefix)


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def first_value(tokens, prefix: str) -> Column:
    return _first(values_of(tokens, prefix))


def last_value(tokens, prefix: str) -> Column:
    return _last(values_of(tokens, prefix))


def _last_int(values: Column) -> Column:
    # A malformed number is skipped, so an earlier good one still counts.
    return _last(F.filter(
        F.transform(values, lambda v: whole_number(F.trim(v))), lambda n: n.isNotNull()))


def has_flag(tokens, flag: str) -> Column:
    return F.array_contains(clean(tokens), flag)


def parse_tag(value) -> Column:
    """``code:type:hex`` as a struct, NULL when malformed or out of range."""
    parts = F.split(_col(value), ":", 3)
    code = whole_number(F.trim(F.get(parts, F.lit(0))))
    kind = whole_number(F.trim(F.get(parts, F.lit(1))))
    raw = F.try_to_binary(F.regexp_replace(F.get(parts, F.lit(2)), r"\s", ""), F.lit("hex"))
    good = (
        (code >= 32768) & kind.isin(*fv.PRIVATE_TAG_TYPES) & raw.isNotNull()
        & (F.length(F.regexp_replace(F.get(parts, F.lit(2)), r"\s", "")) % 2 == 0))
    return F.when(good, F.struct(code.alias("code"), kind.alias("type"), raw.alias("bytes")))


def parse_extrasamples(value) -> Column:
    """A comma list of numbers, NULL when any of them is malformed."""
    numbers = F.transform(F.split(_col(value), ","), lambda v: whole_number(F.trim(v)))
    return F.when(~F.exists(numbers, lambda n: n.isNull()), numbers)


def _markers(cleaned: Column) -> dict[str, Column]:
    """Every marker by name, over tokens that are clean already."""
    of = lambda prefix: _carried(cleaned, prefix)
    flag = lambda token: F.array_contains(cleaned, token)
    extras = F.filter(
        F.transform(of(fv.EXTRASAMPLES), parse_extrasamples), lambda v: v.isNotNull())
    tags = F.filter(F.transform(of(fv.TIFFTAG), parse_tag), lambda t: t.isNotNull())
    return {
        "group_id": _last(of(fv.GROUP)), "page": _last_int(of(fv.PAGE)), "pages": _last_int(of(fv.PAGES)),
        "subfiletype": F.coalesce(_last_int(of(fv.SUBFILETYPE)), F.lit(0)), "depth": _last_int(of(fv.DEPTH)),
        "is_thumb": flag(fv.THUMB), "grayscale": flag(fv.GRAYSCALE), "icc_inherited": flag(fv.ICC_INHERITED),
        "extrasamples": _last(extras), "tags": tags, "src": _last(of(fv.SRC)), "srcsum": _last(of(fv.SRCSUM)),
        "origin": _first(F.filter(of(fv.ORIGIN), lambda v: v != "")),
        "scan": F.nullif(_first(of(fv.SCAN)), F.lit("")), "pixsum": _first(of(fv.PIXSUM)),
        "orientation": _last_int(of(fv.ORIENTATION)), "derived": _first(of(fv.DERIVED))}


def parse_markers(tokens, *names: str) -> Column:
    """every marker of a record as one struct, or those asked for by name.

    The list is cleaned once, as the one item that the struct is made from:
    each marker would trim and filter all tokens again otherwise.
    """

    def markers(cleaned: Column) -> Column:
        found = _markers(cleaned)
        return F.struct(*[found[name].alias(name) for name in names or found])

    return F.get(F.transform(F.array(clean(tokens)), markers), F.lit(0))


def origin_of(tokens) -> Column:
    """The first non-empty origin a record carries, or NULL."""
    return F.get(F.filter(values_of(tokens, fv.ORIGIN), lambda v: v != ""), F.lit(0))


def _carries(token: Column, prefixes) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | token.startswith(prefix)
    return hit


def user_tokens(tokens) -> Column:
    """The user's own tokens, internal markers left out."""
    return F.filter(clean(tokens), lambda t: ~_carries(t, fv.INTERNAL_PREFIXES))


def derived_tokens(tokens, label, converted=True, profile_token=None) -> Column:
    """The token list of a derived copy."""
    wanted = F.lit(label) if isinstance(label, str) else label
    drops = fv.DERIVED_DROPS + ((fv.ICC_PROFILE,) if converted else ())
    kept = F.filter(
        clean(tokens), lambda t: ~_carries(t, drops) & (t != fv.ICC_INHERITED))
    added = F.array(F.concat(F.lit(fv.DERIVED), wanted))
    if converted and profile_token is not None:
        added = F.concat(added, F.array(F.concat(F.lit(fv.ICC_PROFILE), _col(profile_token))))
    return F.concat(kept, added)


def output_origin(tokens, has_record, fresh, read_ok=None) -> Column:
    """The origin value of a new output, NULL when it must stay unknown.

    Unread tokens never get one; an inherited value wins; anything a tool run
    touched before without one stays unknown.
    """
    inherited = origin_of(tokens)
    touched = _col(has_record) | F.exists(
        clean(tokens), lambda t: t.startswith(fv.TOKEN_NAMESPACE))
    fresh = F.lit(fresh) if isinstance(fresh, str) else fresh
    value = F.when(inherited.isNotNull(), inherited).when(~touched, fresh)
    return value if read_ok is None else F.when(_col(read_ok), value)


def _valid_profile(raw: Column) -> Column:
    return F.when(
        (F.length(raw) >= fv.PROFILE_MIN_BYTES)
        & (F.hex(F.substring(raw, 37, 4)) == "61637370"), raw)


def _decode_profile(text: Column) -> Column:
    strict = text.rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.length(text) % 4 == 0)
    return _valid_profile(F.when(strict, F.try_to_binary(text, F.lit("base64"))))


def carried_profile(tokens, creator) -> Column:
    """The colour profile a record carries: token first, then the legacy segment."""
    from_tokens = F.filter(
        F.transform(values_of(tokens, fv.ICC_PROFILE), _decode_profile), lambda p: p.isNotNull())
    parts = F.filter(
        F.transform(F.split(F.coalesce(_col(creator), F.lit("")), r"\|"), lambda x: F.trim(x)),
        lambda s: s.startswith("ICC:"))
    legacy = F.filter(
        F.transform(parts, lambda s: _decode_profile(F.trim(F.substring(s, F.lit(5), F.length(s))))),
        lambda p: p.isNotNull())
    return F.coalesce(F.get(from_tokens, F.lit(0)), F.get(legacy, F.lit(0)))
