"""Recipe labels of derived copies: build, parse, compare, resize geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import fixed_values as fv
from shelfmark.functions.numbers import recorded_number, whole_number


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def short_number(value) -> Column:
    """A number without trailing zeros (``1``, ``0.05``, ``2.5``)."""
    return F.regexp_replace(
        _col(value).cast("decimal(20,6)").cast("string"), r"\.?0+$", "")


def resize_label(mode, value, upscale) -> Column:
    """``@long2048``, ``@pct50+up`` ... or an empty text."""
    mode = _col(mode)
    tag = F.when(mode == "percent", F.lit("pct")).otherwise(mode)
    return F.when(mode.isNull() | (mode == ""), F.lit("")).otherwise(F.concat(
        F.lit("@"), tag, short_number(value),
        F.when(F.coalesce(_col(upscale), F.lit(False)), F.lit("+up")).otherwise(F.lit(""))))


def recipe_label(profile, mode, value, upscale, sharpen) -> Column:
    """The pixel part of a label."""
    sharpen = F.coalesce(_col(sharpen), F.lit("none"))
    return F.concat(
        F.coalesce(F.nullif(_col(profile), F.lit("")), F.lit("keep")),
        resize_label(mode, value, upscale),
        F.when(sharpen.isin("none", ""), F.lit("")).otherwise(F.concat(F.lit("+"), sharpen)))


def whole_image(distance, effort, buffering=None) -> Column:
    """Does the codec take the whole image at once (else it streams)?"""
    d, e = _col(distance), _col(effort)
    own = (e >= 10) | (e.isin(8, 9) & (d > 0.5)) | ((e == 7) & (d >= 3))
    return own if buffering is None else F.when(
        _col(buffering).isNotNull(), _col(buffering) == 0).otherwise(own)


def encode_suffix(distance, effort, floor: float = fv.DISTANCE_FLOOR, buffering=None) -> Column:
    """``/d3e9s``; a lossy distance below the floor is recorded as the floor."""
    d = _col(distance)
    effective = F.when((d > 0) & (d < floor), F.lit(floor)).otherwise(d)
    streamed = ~whole_image(effective, effort, buffering)
    return F.concat(
        F.lit("/d"), short_number(effective), F.lit("e"), _col(effort).cast("int").cast("string"),
        F.when(streamed, F.lit("s")).otherwise(F.lit("")))


def quality_suffix(quality) -> Column:
    """``/q70``, or nothing without a quality."""
    q = _col(quality)
    return F.when(F.coalesce(q, F.lit(0)) > 0, F.concat(F.lit("/q"), q.cast("string"))).otherwise(
        F.lit(""))


def parse_recipe(label) -> Column:
    """(recipe, d, e, streamed, rank) -- rank orders encodes at one distance."""
    text = F.coalesce(_col(label), F.lit(""))
    found = text.rlike(fv.ENCODE_SUFFIX_PATTERN)
    d = recorded_number(F.regexp_extract(text, fv.ENCODE_SUFFIX_PATTERN, 1))
    e = whole_number(F.regexp_extract(text, fv.ENCODE_SUFFIX_PATTERN, 2))
    streamed = F.when(found, F.regexp_extract(text, fv.ENCODE_SUFFIX_PATTERN, 3) == "s")
    capped = F.when(streamed & (d > 0), F.least(e, F.lit(fv.STREAMED_EFFORT_CAP))).otherwise(e)
    return F.struct(
        F.when(found, F.regexp_replace(text, fv.ENCODE_SUFFIX_PATTERN, "")).otherwise(text)
        .alias("recipe"),
        F.when(found, d).alias("d"),
        F.when(found, e).alias("e"),
        streamed.alias("streamed"),
        F.when(found, capped * 2 + F.when(streamed, 0).otherwise(1)).alias("rank"))


def rederive_reason(stored, wanted, check_encode=True, lower_effort=False) -> Column:
    """Why an existing derived copy must be redone, NULL to keep it."""
    have, want = parse_recipe(stored), parse_recipe(wanted)
    check = F.lit(check_encode) if isinstance(check_encode, bool) else check_encode
    lower = F.lit(lower_effort) if isinstance(lower_effort, bool) else lower_effort
    comparable = check & have["d"].isNotNull() & want["d"].isNotNull()
    apart = F.abs(have["d"] - want["d"]) > 1e-9
    # A record without the streaming mark may predate the mark.
    maybe_same = (have["e"] == want["e"]) & ~have["streamed"] & want["streamed"]
    encode = F.lit("encode settings changed")
    return (
        F.when(have["recipe"] != want["recipe"], F.lit("derivative recipe changed"))
        .when(comparable & apart, encode)
        .when(comparable & (want["rank"] > have["rank"]), encode)
        .when(comparable & lower & (want["rank"] < have["rank"]) & ~maybe_same, encode))


def quality_recipe_changed(stored, wanted) -> Column:
    """P24 for labels with a quality: an unrecorded quality is never compared."""
    have, want = _col(stored), _col(wanted)
    have_q = F.nullif(F.regexp_extract(have, fv.QUALITY_SUFFIX_PATTERN, 1), F.lit(""))
    want_q = F.nullif(F.regexp_extract(want, fv.QUALITY_SUFFIX_PATTERN, 1), F.lit(""))
    bases_differ = (F.regexp_replace(have, fv.QUALITY_SUFFIX_PATTERN, "")
                    != F.regexp_replace(want, fv.QUALITY_SUFFIX_PATTERN, ""))
    return bases_differ | F.coalesce(have_q != want_q, F.lit(False))


def resize_geometry(width, height, mode, value, upscale=False) -> Column:
    """P25: (width, height) after a resize, NULL when the size stays."""
    w, h = _col(width), _col(height)
    mode, value = _col(mode), _col(value).cast("double")
    upscale = F.lit(upscale) if isinstance(upscale, bool) else upscale
    scale = (
        F.when(mode == "long", value / F.greatest(w, h))
        .when(mode == "short", value / F.least(w, h))
        .when(mode == "percent", value / F.lit(100.0)))
    new_w = F.greatest(F.lit(1), F.bround(w * scale, 0).cast("int"))
    new_h = F.greatest(F.lit(1), F.bround(h * scale, 0).cast("int"))
    applies = (scale > 0) & ((scale <= 1.0) | upscale) & ((new_w != w) | (new_h != h))
    return F.when(applies, F.struct(new_w.alias("width"), new_h.alias("height")))
