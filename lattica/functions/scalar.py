"""Scalar expressions: masks, fills, arithmetic with the semantics stated, and text and URL parsing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed names of the comparisons.
_COMPARE = {"eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


def compare(value: Column, operator: str, other, fill=None) -> Column:
    """The comparison as a mask, or the value with ``fill`` wherever it holds."""
    hit = _COMPARE[operator](value, other if isinstance(other, Column) else F.lit(other))
    return hit if fill is None else F.when(hit, F.lit(fill)).otherwise(value)


def int_divide(a: Column, b) -> Column:
    """Division rounded towards minus infinity; null by zero."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.floor(F.try_divide(a, b)).cast("long")


def invert_uint8(value: Column) -> Column:
    """Complement plus two of an unsigned byte, modulo 256."""
    return F.pmod(F.lit(1) - value, F.lit(256))


def masked_out(value: Column, predicates: list[Column]) -> Column:
    """Zero where any predicate holds; at least one is needed."""
    if not predicates:
        raise ValueError("no predicates to combine")
    return F.when(reduce(or_, predicates), F.lit(0)).otherwise(value)


def filled(value: Column, masks: list[Column], fill) -> Column:
    """``fill`` wherever one of the masks is positive."""
    return reduce(lambda v, m: F.when(m > 0, F.lit(fill)).otherwise(v), masks, value)


def clamped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def label_colour(label: Column) -> list[Column]:
    """Red, green and blue of a label by a hash; zero stays black."""
    h = F.xxhash64(label)
    return [F.when(label == 0, F.lit(0)).otherwise(F.shiftright(h, s).bitwiseAND(F.lit(255).cast("long"))).cast("int") for s in (0, 8, 16)]


def affine_field(x: Column, y: Column, matrix) -> tuple[Column, Column]:
    """Displacement of (x, y) under a 2 x 3 matrix."""
    (a, b, c), (d, e, f) = matrix
    return a * x + b * y + c - x, d * x + e * y + f - y


def parse_point(text: Column) -> Column:
    """array(x, y, z) of a text with three fields split by blanks, commas or bars; null otherwise."""
    fields = F.filter(F.split(F.trim(text), r"[\s,|]+"), lambda s: s != "")
    return F.when(F.size(fields) == 3, F.transform(fields, lambda s: s.try_cast("double")))


def double_of_hex(text: Column) -> Column:
    """The IEEE double of 16 hex digits, most significant first: sign, exponent and fraction by bit functions."""
    high, low = (F.conv(F.substring(text, a, 8), 16, 10).cast("long") for a in (1, 9))
    exponent = F.shiftright(high, 20).bitwiseAND(F.lit(0x7FF))
    fraction = (high.bitwiseAND(F.lit(0xFFFFF)).cast("double") * 2.0**32 + low) / 2.0**52
    size = F.when(exponent == 0, fraction * 2.0**-1022).when(exponent == 0x7FF, F.when(fraction == 0, float("inf")).otherwise(float("nan"))).otherwise((1 + fraction) * F.pow(F.lit(2.0), exponent - 1023))
    return F.when(F.shiftright(high, 31) == 1, -size).otherwise(size)


def wkb_point(text: Column) -> Column:
    """array(x, y, z) of a little-endian binary point in hex, z 0 where it has two coordinates; null for other texts."""
    turned = lambda i: F.concat(*[F.substring(text, 11 + 16 * i + 2 * k, 2) for k in range(7, -1, -1)])
    x, y, z = (double_of_hex(turned(i)) for i in range(3))
    return F.when(text.rlike("^01[0-9A-Fa-f]{8}([0-9A-Fa-f]{32}|[0-9A-Fa-f]{48})$"), F.array(x, y, F.when(F.length(text) >= 58, z).otherwise(0.0)))


def any_point(text: Column) -> Column:
    """A point as plain text or as a binary point in hex."""
    return F.coalesce(wkb_point(F.trim(text)), parse_point(text))


def point_text(x: Column, y: Column, z: Column) -> Column:
    return F.concat(F.lit("POINT Z("), F.concat_ws(" ", *[c.cast("string") for c in (x, y, z)]), F.lit(")"))


def config_key(name: Column) -> Column:
    """struct(radius, n) of a name that ends in r<radius>_p<n>, else null."""
    pattern = r"r(\d+)_p(\d+)$"
    return F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 1).cast("int").alias("radius"), F.regexp_extract(name, pattern, 2).cast("int").alias("n")))


def bucket_of(url: Column) -> Column:
    """The bucket that an object-store URL names: the part after /b/, or the first path segment; null without any."""
    api = F.regexp_extract(url, r"/b/([^/?]+)", 1)
    path = F.regexp_extract(url, r"^[a-z]+://[^/]+/([^/?]+)", 1)
    return F.when(api != "", api).when(path != "", path)


def request_class(method: Column, path: Column) -> Column:
    """Billing class of a request: reads of objects B, deletions free, the rest (lists and writes) A."""
    listing = path.rlike(r"/o/?(\?|$)")
    return F.when(method == "DELETE", "free").when((method == "GET") & listing, "A").when(method.isin("GET", "HEAD"), "B").otherwise("A")


def egress_bytes(header: Column, body: Column) -> Column:
    """Length from the header, or of the body."""
    return F.coalesce(header.try_cast("bigint"), F.octet_length(body).cast("bigint"), F.lit(0).cast("bigint"))


def event_time(value: Column, default: Column | None = None) -> Column:
    """A timestamp of ISO text or of epoch seconds."""
    out = F.coalesce(F.try_to_timestamp(value), F.timestamp_seconds(value.try_cast("double")))
    return out if default is None else F.coalesce(out, default)


def valid_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9_-]+$")


def resolution_key(*axes: Column) -> Column:
    return F.concat_ws("_", *[a.cast("string") for a in axes])


def chain(df: DataFrame, *steps) -> DataFrame:
    """Steps (DataFrame -> DataFrame) applied in order."""
    return reduce(lambda d, step: d.transform(step), steps, df)


def reprefixed(name: Column, prefix: str) -> Column:
    """An id whose leading letters up to ``_r`` give way to another prefix; others stay."""
    return F.regexp_replace(name, "^[a-zA-Z_]+_r", f"{prefix}_r")


def skip_empty(df: DataFrame, fn: Callable[[DataFrame], DataFrame], column: str = "v") -> DataFrame:
    """``fn`` of an array in long form, or the array itself if it has no value other than zero: one look for a single row."""
    return df if df.where(F.col(column) != 0).isEmpty() else fn(df)
