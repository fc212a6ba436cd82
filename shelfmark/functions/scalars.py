"""Small scalar helpers: sizes, MIME names, samples, curves, digests, fields."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import fixed_values as fv
from shelfmark.functions.paths import stem_of, suffix_of


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def fmt_size(size) -> Column:
    """a size a person can read, informative below a gigabyte."""
    value = _col(size).cast("bigint")
    result = None
    for unit, power in (("TB", 4), ("GB", 3), ("MB", 2)):
        step = 1024 ** power
        # Tenths in whole numbers, ties to even: a step is a power of two, so
        # a tie is exact and a formatter's half-up would differ.
        tenths, rest = F.floor(value * 10 / step), F.pmod(value * 10, F.lit(step)) * 2
        up = (rest > step) | ((rest == step) & (tenths % 2 == 1))
        rounded = tenths + up.cast("bigint")
        text = F.concat(
            F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"),
            F.lit(f" {unit}"))
        result = (F.when(value >= step, text) if result is None
                  else result.when(value >= step, text))
    return result.otherwise(F.concat(
        F.bround(value / F.lit(1024.0), 0).cast("bigint").cast("string"), F.lit(" KB")))


def mime_of(path) -> Column:
    """MIME type by extension, a trailing ``.tmp`` ignored."""
    name = _col(path)
    bare = F.when(suffix_of(name) == ".tmp", stem_of(name)).otherwise(name)
    table = F.create_map(*[F.lit(x) for x in chain(*fv.MIME_BY_EXTENSION.items())])
    return F.try_element_at(table, suffix_of(bare))


def widen(samples) -> Column:
    """F8: 8-bit samples to 16 bits."""
    return F.transform(_col(samples), lambda x: x * 257)


def narrow(samples) -> Column:
    """F8: 16-bit samples to 8 bits, ties to even."""
    return F.transform(_col(samples), lambda x: F.rint(x / F.lit(257.0)).cast("int"))


def curve_forward(x, kind: int, params) -> Column:
    """a tone curve from encoded to linear (1: gamma, 4: the sRGB form)."""
    x = _col(x)
    if kind == 1:
        return F.pow(x, F.lit(float(params[0])))
    g, a, b, c, d = [float(p) for p in params[:5]]
    bent = F.pow(F.greatest(x * F.lit(a) + F.lit(b), F.lit(0.0)), F.lit(g))
    return F.when(x >= d, bent).otherwise(x * F.lit(c))


def curve_inverse(y, kind: int, params) -> Column:
    """linear back to encoded."""
    y = _col(y)
    if kind == 1:
        return F.pow(y, F.lit(1.0 / float(params[0])))
    g, a, b, c, d = [float(p) for p in params[:5]]
    knee = max(a * d + b, 0.0) ** g
    bent = (F.pow(y, F.lit(1.0 / g)) - F.lit(b)) / F.lit(a)
    return F.when(y >= knee, bent).otherwise(y / F.lit(c))


def content_id(content) -> Column:
    """digest of a digest, 16 hex digits -- the identity of some bytes."""
    return F.substring(F.sha2(F.unhex(F.sha2(_col(content).cast("binary"), 256)), 256), 1, 16)


def content_digest(content) -> Column:
    """the full SHA-256 of some bytes."""
    return F.sha2(_col(content).cast("binary"), 256)


def md5_of(content) -> Column:
    return F.md5(_col(content).cast("binary"))


def psnr(mse, peak: float = fv.PEAK_16BIT) -> Column:
    """PSNR in dB; infinite for identical samples."""
    mse = _col(mse)
    return F.when(mse <= 0, F.lit(float("inf"))).otherwise(
        F.lit(10.0) * F.log10(F.lit(peak * peak) / F.when(mse > 0, mse)))


def json_field(text, path: str) -> Column:
    """one scalar of a JSON record."""
    return F.get_json_object(_col(text), path)


def fill_fields(pairs=fv.FIELD_FILL, source: str = "iptc", target: str = "xmp") -> list[Column]:
    """F16: target fields, filled from the source only where they hold nothing.

    ``source`` and ``target`` are struct columns; array fields count as empty
    when they have no items.
    """
    columns = []
    for from_field, to_field in pairs:
        have, offer = F.col(f"{target}.`{to_field}`"), F.col(f"{source}.`{from_field}`")
        columns.append(F.coalesce(F.nullif(have, F.lit("")), F.nullif(offer, F.lit("")))
                       .alias(to_field))
    return columns


def fill_array(have, offer) -> Column:
    """F16 for a list field."""
    have, offer = _col(have), _col(offer)
    return F.when(F.coalesce(F.size(have), F.lit(0)) <= 0, offer).otherwise(have)
