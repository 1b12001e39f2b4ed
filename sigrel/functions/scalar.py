"""Column functions: integers, ranges, strings, durations, points and colours."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


# integers and ranges


def is_even(x) -> Column:
    return _c(x) % 2 == 0


def is_odd(x) -> Column:
    return _c(x) % 2 != 0


def is_pow2(x) -> Column:
    return (_c(x) > 0) & (F.bit_count(_c(x)) == 1)


def clog2(x) -> Column:
    """Least number of bits that tell ``x`` values apart; exact for all longs over 0, null otherwise."""
    return F.when(_c(x) > 0, F.when(_c(x) == 1, 0).otherwise(F.length(F.bin((_c(x) - 1).cast("long")))))


def clip_norm(x, lo=0.0, hi=1.0) -> Column:
    """Clip to a range and scale it to [0, 1]; the bounds may be swapped."""
    a, b = F.least(_c(lo), _c(hi)).cast("double"), F.greatest(_c(lo), _c(hi)).cast("double")
    return F.try_divide(F.least(F.greatest(_c(x).cast("double"), a), b) - a, b - a)


def int_to_base(x, base: int) -> Column:
    if not 1 < base < 36:
        raise ValueError("base must be from 2 to 35")
    return F.lower(F.conv(_c(x).cast("string"), 10, base))


def dot(xs, ys) -> Column:
    return F.aggregate(F.zip_with(_c(xs), _c(ys), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)


def l2_norm(xs) -> Column:
    return F.sqrt(F.aggregate(_c(xs), F.lit(0.0), lambda s, v: s + v.cast("double") * v))


def product(xs) -> Column:
    return F.aggregate(_c(xs), F.lit(1.0), lambda s, v: s * v)


def first_index(xs, value, default=None) -> Column:
    """0-based place of the first equal element, or ``default``."""
    return F.coalesce(F.nullif(F.array_position(_c(xs), value), F.lit(0)) - 1, F.lit(default).cast("long"))


# strings


def strip_suffix(t, suffix: str) -> Column:
    if not suffix:
        return _c(t)
    return F.when(_c(t).endswith(suffix), F.substring(_c(t), F.lit(1), F.length(_c(t)) - len(suffix))).otherwise(_c(t))


def strip_extension(name, ext: str) -> Column:
    """Remove a given extension, whatever its case; names that only start with a dot have none."""
    e = ext.removeprefix(".")
    has = _c(name).rlike(r"(?i)[^/.][^/]*\." + _quoted(e) + "$")
    return F.when(has, F.substring(_c(name), F.lit(1), F.length(_c(name)) - len(e) - 1)).otherwise(_c(name))


def append_extension(name, ext: str) -> Column:
    return F.when(F.lower(_c(name)).endswith("." + ext.lower()), _c(name)).otherwise(F.concat(_c(name), F.lit("." + ext)))


def _quoted(s: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in s)


def lower_camel_case(s) -> Column:
    """Words joined, the first letter lower and those of later words upper; runs of other characters become one _."""
    words = F.filter(F.split(_c(s), r"\s+"), lambda w: w != "")
    head = lambda w, f: F.concat(f(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    cased = F.transform(words, lambda w, i: F.when(i == 0, head(w, F.lower)).otherwise(head(w, F.upper)))
    return F.regexp_replace(F.array_join(cased, ""), r"\W+", "_")


def dedup_spaces(s) -> Column:
    return F.regexp_replace(_c(s), " +", " ")


def is_comment(s, mark: str = "#") -> Column:
    return F.regexp_replace(_c(s), r"^\s+", "").startswith(mark)


def detype(path) -> Column:
    """A dotted path without what follows its first ``[``, and of each part what follows its last ``:``."""
    return F.regexp_replace(F.regexp_replace(_c(path), r"(?s)\[.*$", ""), r"[^.]*:", "")


# durations

# Seconds in a week, a day, an hour and a minute.
_WEEK, _DAY, _HOUR, _MINUTE = 604800, 86400, 3600, 60


def to_seconds(weeks, days, hours, minutes, seconds) -> Column:
    return _c(weeks) * _WEEK + _c(days) * _DAY + _c(hours) * _HOUR + _c(minutes) * _MINUTE + _c(seconds)


def from_seconds(s) -> Column:
    """struct(weeks, days, hours, minutes, seconds) of a number of seconds."""
    whole = F.floor(_c(s)).cast("long")
    part = lambda size, within: F.floor(F.pmod(whole, F.lit(within)) / size).cast("long")
    seconds = _c(s).cast("double") - F.floor(_c(s).cast("double") / _MINUTE) * _MINUTE
    return F.struct(F.floor(whole / _WEEK).cast("long").alias("weeks"), part(_DAY, _WEEK).alias("days"), part(_HOUR, _DAY).alias("hours"), part(_MINUTE, _HOUR).alias("minutes"), seconds.alias("seconds"))


def duration_text(s) -> Column:
    """``1w2d3h4m5.000s``; parts that are 0 are left out, but for the seconds."""
    d = from_seconds(s)
    shown = lambda name, unit: F.when(d[name] > 0, F.concat(d[name].cast("string"), F.lit(unit))).otherwise("")
    return F.concat(shown("weeks", "w"), shown("days", "d"), shown("hours", "h"), shown("minutes", "m"), F.format_string("%.3fs", d["seconds"]))


# points: arrays of doubles


def pt_scale(pt, scale) -> Column:
    return F.transform(_c(pt), lambda p: p * _c(scale))


def pt_shift(pt, shift) -> Column:
    return F.zip_with(_c(pt), _c(shift), lambda p, s: p + s)


def pt_mirror(pt, mirror) -> Column:
    """Mirror around the hyperplanes given by ``mirror``; null leaves a coordinate as it is."""
    return F.zip_with(_c(pt), _c(mirror), lambda p, m: F.when(m.isNull(), p).otherwise(2 * m - p))


def pt_rotate(pt, rotation, center) -> Column:
    """Multiply by a rotation matrix (array of rows) around ``center``."""
    rel = F.zip_with(_c(pt), _c(center), lambda p, c: p - c)
    turned = F.transform(_c(rotation), lambda row: F.aggregate(F.zip_with(row, rel, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return F.zip_with(turned, _c(center), lambda p, c: p + c)


def pt_rotate_2d(pt, theta, center=None) -> Column:
    p, t = _c(pt), _c(theta)
    cx, cy = (_c(center)[0], _c(center)[1]) if center is not None else (F.lit(0.0), F.lit(0.0))
    x, y = p[0] - cx, p[1] - cy
    return F.array(F.cos(t) * x - F.sin(t) * y + cx, F.sin(t) * x + F.cos(t) * y + cy)


def pt_difference(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: y - x)


def pt_between(a, b, fraction=0.5) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: (y - x) * _c(fraction) + x)


def pt_distance(a, b) -> Column:
    return l2_norm(pt_difference(a, b))


# colours


def _hex2(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.floor(x).cast("long")), 2, "0"))


def rgb1d(a, gamma: float = 1.0) -> Column:
    """Grey of a value in [0, 1] as rrggbb, darker for larger ones; NaN and null are black."""
    v = _c(a).cast("double")
    h = _hex2(255 * F.pow(1 - v, F.lit(gamma)))
    return F.when(v.isNull() | F.isnan(v), "000000").otherwise(F.concat(h, h, h))


def rgb2d(a, b, gamma: float = 1.0) -> Column:
    """Colour of a pair of values in [0, 1]: darker for larger ones, hue by their angle; NaN and null count as 0."""
    x, y = (F.when(_c(v).isNull() | F.isnan(_c(v).cast("double")), 0.0).otherwise(_c(v).cast("double")) for v in (a, b))
    theta = 1 - F.pow(F.sqrt(x * x + y * y) / math.sqrt(2.0), F.lit(gamma))
    phi, quarter = F.atan2(x, y), 0.25 * math.pi
    green = F.pow(theta, 1 + F.greatest(F.lit(0.0), phi - quarter))
    blue = F.pow(theta, 1 + F.greatest(F.lit(0.0), quarter - phi))
    return F.concat(_hex2(255 * theta), _hex2(255 * green), _hex2(255 * blue))
