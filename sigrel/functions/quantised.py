"""Arithmetic on n-bit numbers s that stand for (s + 1) / 2**n, in (0, 1]: columns of longs, n from 1 to 31."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import _c


def one(n: int) -> int:
    return (1 << n) - 1


def to_float(x, n: int) -> Column:
    return (_c(x) + 1) / F.lit(float(1 << n))


def from_float(x, n: int) -> Column:
    """x * (2**n - 1) cut off; not the inverse of :func:`to_float`."""
    return F.floor(_c(x).cast("double") * one(n)).cast("long")


def add(x, y, n: int) -> Column:
    """Wraps around."""
    return (_c(x) + _c(y) + 1).bitwiseAND(F.lit(one(n)))


def sub(x, y, n: int) -> Column:
    """Stops at the least number."""
    return F.greatest(F.lit(0), _c(x) - _c(y) - 1).bitwiseAND(F.lit(one(n)))


def reflect(x, n: int) -> Column:
    return sub(F.lit(one(n)), x, n)


def hadamard(x, y, n: int) -> Column:
    return F.shiftright(_c(x) * _c(y) + _c(x) + _c(y), n)


def power(x, k: int, n: int) -> Column:
    """k-th power by squaring, each product cut to n bits: one fold over the binary digits of k, lowest first."""
    if k == 0:
        return F.lit(one(n)).cast("long")
    if k == 1:
        return _c(x)
    start = F.struct(_c(x).cast("long").alias("base"), F.lit(one(n)).cast("long").alias("rest"))

    def step(s: Column, bit: Column) -> Column:
        rest = F.when(bit == 1, hadamard(s["base"], s["rest"], n)).otherwise(s["rest"])
        return F.struct(hadamard(s["base"], s["base"], n).cast("long").alias("base"), rest.cast("long").alias("rest"))

    return F.aggregate(F.array(*[F.lit(int(b)) for b in reversed(bin(k)[2:])]), start, step)["rest"]


def ratio(num, den, n: int) -> Column:
    """num / den bit by bit, with the divisor's cut-off halves, for 0 <= num <= den: one fold over the bits."""
    a, d = F.abs(_c(num)).cast("long"), F.abs(_c(den)).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("bits"), a.alias("rest"))

    def step(s: Column, i: Column) -> Column:
        takes = (s["rest"] >= 0) & (F.call_function("shiftleft", s["rest"], i) >= d)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(n) - i)
        return F.struct((s["bits"] + F.when(takes, bit).otherwise(F.lit(0).cast("long"))).alias("bits"), F.when(takes, s["rest"] - F.call_function("shiftright", d, i)).otherwise(s["rest"]).alias("rest"))

    got = F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step)["bits"]
    return F.when(a == 0, F.lit(0)).when(a == d, F.lit(one(n))).otherwise(got - 1).cast("long")


# aggregates


def mean(x, n: int) -> Column:
    """((sum + length) >> log2(length)) - 1; the length has to be a power of 2 (null otherwise)."""
    count = F.count(_c(x))
    return F.when(F.bit_count(count) == 1, F.floor((F.sum(_c(x)) + count) / count).cast("long") - 1)


def expectation(w, x, n: int) -> Column:
    return mean(hadamard(w, x, n), n)


def conditional(w, x, y, n: int) -> Column:
    """E[X|Y]."""
    return ratio(expectation(w, hadamard(x, y, n), n) + 1, expectation(w, y, n) + 1, n)


def dependence(w, x, y, n: int) -> Column:
    ex, ey, exy = expectation(w, x, n), expectation(w, y, n), expectation(w, hadamard(x, y, n), n)
    both = hadamard(ex, ey, n)
    return F.when((ex == 0) | (ey == 0) | (exy < both), F.lit(0).cast("long")).otherwise(reflect(ratio(both + 1, exy + 1, n), n))


def covariance(w, x, y, n: int) -> Column:
    ex, ey, exy = expectation(w, x, n), expectation(w, y, n), expectation(w, hadamard(x, y, n), n)
    both = hadamard(ex, ey, n)
    return F.when((ex == 0) | (ey == 0) | (both == 0) | (exy < both), F.lit(0).cast("long")).otherwise(sub(exy, both, n) * 4 + 3)
