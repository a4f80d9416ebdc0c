"""Scalar functions as Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Text = str | Column

#: Fixed value: relative and absolute tolerance at the image border.
EDGE = 1e-6


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(value: Text, digits: int = 4) -> Column:
    """Fixed digits, or a dash for null."""
    return F.coalesce(F.when(_c(value).isNotNull(), F.format_string(f"%.{digits}f", _c(value).cast("double"))), F.lit("—"))


def duration(seconds: Text, clamp: bool = False) -> Column:
    """HH:MM:SS of seconds rounded half to even; hours are unbounded. ``clamp``: not below zero."""
    s = F.bround(_c(seconds).cast("double"), 0).cast("long")
    s = F.greatest(s, F.lit(0).cast("long")) if clamp else s
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)))


def count_noun(value: Text, singular: str, plural: str) -> Column:
    return F.concat(_c(value).cast("string"), F.lit(" "), F.when(_c(value) == 1, singular).otherwise(plural))


def slug(value: Text) -> Column:
    """Lower case; runs of anything but a-z, 0-9, _ and - become one dash; no dashes at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(value)), r"[^a-z0-9_-]+", "-"), r"^-+|-+$", "")


#: What stands for a remaining time that is not known, or used up.
NO_HISTORY, OVER_HISTORY = "calculando; ainda não há histórico desta etapa", "acima do tempo histórico"


def eta(estimate: Text, elapsed: Text) -> Column:
    """What is left of an estimate, or why that is not known."""
    left = _c(estimate) - _c(elapsed)
    return F.when(_c(estimate).isNull(), NO_HISTORY).when(left <= 0, OVER_HISTORY).otherwise(F.concat(F.lit("~"), duration(left, clamp=True)))


def hue_wrap(background: Text, hue: Text) -> Column:
    """Signed shortest way between two hues of a circle of 256."""
    return F.pmod(_c(background) - _c(hue) + 128, F.lit(256)) - 128


def depth_scale(proximity: Text, far: float, near: float) -> Column:
    return F.lit(far) + (F.lit(near) - F.lit(far)) * _c(proximity)


def html_escape(value: Text) -> Column:
    out = _c(value)
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def base_name(path: Text) -> Column:
    return F.regexp_extract(_c(path), r"([^/\\]*)$", 1)


def stem(path: Text) -> Column:
    """File name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Text) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]+)$", 1))


def relative_to(path: Text, base: str) -> Column:
    """The path below ``base``, or as it is where it lies elsewhere."""
    root = base.rstrip("/") + "/"
    return F.when(F.startswith(_c(path), F.lit(root)), F.substring(_c(path), len(root) + 1, 1 << 30)).otherwise(_c(path))


def label_directory(images: Text) -> Column:
    """``root/images/split`` -> ``root/labels/split``; null where the parent is not named images."""
    return F.when(_c(images).rlike(r"(^|/)images/[^/]+/?$"), F.regexp_replace(_c(images), r"(^|/)images/([^/]+)/?$", "$1labels/$2"))


def f1(precision: Text, recall: Text) -> Column:
    p, r = _c(precision), _c(recall)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def curve_x(epoch: Text, first: float, last: float, left: float, width: float) -> Column:
    span = max(last - first, 1.0)
    return F.lit(left) + (_c(epoch) - F.lit(first)) / F.lit(span) * F.lit(width)


def curve_y(value: Text, top: float, height: float) -> Column:
    return F.lit(top) + (1 - clamp(_c(value).cast("double"), 0.0, 1.0)) * F.lit(height)


#: Stops of the heat palette (share, red, green, blue).
PALETTE = ((0.0, 255, 255, 255), (0.05, 210, 220, 255), (0.35, 35, 70, 255), (0.7, 0, 220, 100), (1.0, 255, 235, 0))


def colour_ramp(share: Text, channel: int) -> Column:
    """Piecewise-linear ramp over five stops; a value on a stop belongs to the interval that begins there."""
    x, out = clamp(_c(share).cast("double"), 0.0, 1.0), None
    for (a, *low), (b, *high) in zip(PALETTE, PALETTE[1:], strict=False):
        value = F.lit(float(low[channel])) + (x - a) / (b - a) * (high[channel] - low[channel])
        out = F.when(x < b, value) if out is None else out.when(x < b, value)
    return F.bround(out.otherwise(float(PALETTE[-1][channel + 1])), 0).cast("int")


def form_fields(page: Text) -> Column:
    """Map of name to value of the page's hidden form fields, in attribute order name, value; of a repeated name the last."""
    pattern = r'name="([^"]+)"\s+value="([^"]*)"'
    names, values = (F.regexp_extract_all(_c(page), F.lit(pattern), F.lit(k)) for k in (1, 2))
    fields = F.zip_with(names, values, lambda n, v: F.struct(n.alias("key"), v.alias("value")))
    last = F.filter(fields, lambda x, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), x["key"]))  # of a repeated name
    return F.map_from_entries(last)


def stable_hash(canonical: Text, length: int = 12) -> Column:
    """First hex digits of the SHA-256 of an already canonical JSON text."""
    return F.substring(F.sha2(_c(canonical), 256), 1, length)


def json_string(value: Text) -> Column:
    """A JSON string literal as canonical writers give it: quotes, backslashes and control characters escaped, the rest kept."""
    out = F.replace(F.replace(_c(value), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return F.concat(F.lit('"'), out, F.lit('"'))


def run_id(condition: Text, model: Text, seed: Text, digest: Text) -> Column:
    return F.concat_ws("__", _c(condition), _c(model), F.concat(F.lit("s"), _c(seed).cast("string")), F.substring(_c(digest), 1, 10))


def overlay(defaults: Text, own: Text) -> Column:
    """Keys of ``own`` win over ``defaults``."""
    return F.map_concat(F.map_filter(_c(defaults), lambda k, _: ~F.array_contains(F.map_keys(_c(own)), k)), _c(own))


def sample_seed(canonical: Text) -> Column:
    """Unsigned 64-bit seed from the first 16 hex digits of a SHA-256; a decimal, as it may exceed a long."""
    return F.conv(F.substring(F.sha2(_c(canonical), 256), 1, 16), 16, 10).cast("decimal(20,0)")
