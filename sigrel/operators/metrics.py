"""Pair metrics as columns over six moments, and a registry of them by name.

The moments of a pair in a window are weighted means: ex, ey, exy, exx, eyy and emin, the mean of min(x, y). Values
are in [0, 1], so E|X-Y| = ex + ey - 2 emin and E(X-Y)^2 = exx + eyy - 2 exy. An undefined ratio is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def _m() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in ("ex", "ey", "exy", "exx", "eyy", "emin"))


def conditional() -> Column:
    """E[X|Y] = E[XY] / E[Y]; null if E[Y] is 0."""
    _, ey, exy, *_ = _m()
    return F.when(ey != 0, exy / ey)


def hamming() -> Column:
    ex, ey, *_, emin = _m()
    return 1 - (ex + ey - 2 * emin)


def tanimoto() -> Column:
    ex, ey, exy, *_ = _m()
    d = ex + ey - exy
    return F.when(d != 0, exy / d).otherwise(0.0)


def closeness() -> Column:
    _, _, exy, exx, eyy, _ = _m()
    return 1 - F.sqrt(F.greatest(F.lit(0.0), exx + eyy - 2 * exy))


def cosine() -> Column:
    _, _, exy, exx, eyy, _ = _m()
    return F.when((exx != 0) & (eyy != 0), F.least(F.lit(1.0), exy / (F.sqrt(exx) * F.sqrt(eyy)))).otherwise(0.0)


def covariance() -> Column:
    ex, ey, exy, *_ = _m()
    return 4 * F.abs(exy - ex * ey)


def dependence() -> Column:
    ex, ey, exy, *_ = _m()
    cex = F.when(ey != 0, exy / ey)
    return F.when(cex > ex, (cex - ex) / cex).otherwise(0.0)


METRICS: dict[str, Callable[[], Column]] = {"cex": conditional, "ham": hamming, "tmt": tanimoto, "cls": closeness, "cos": cosine, "cov": covariance, "dep": dependence}


def metric(name_or_function: str | Callable[[], Column]) -> Column:
    """A metric by name, or a caller's own function of the moment columns."""
    return METRICS[name_or_function]() if isinstance(name_or_function, str) else name_or_function()


def with_metrics(moments, names=None):
    """The moment table with one column for each metric."""
    return moments.withColumns({n: metric(n) for n in (names or METRICS)})
