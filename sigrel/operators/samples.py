"""Signals as sparse samples (signal, t, v) and intervals (signal, t0, t1, v): held values, windows, pairs, set operations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ROWS, neighbour, running


def hold(changes: DataFrame, end: int | None = None, keys: tuple[str, ...] = ("signal",), block: int | None = None, rows: int | None = None) -> DataFrame:
    """Changes (signal, t, v) -> intervals [t0, t1) on which the value is held; the last one ends at ``end`` or null.

    A signal is 0 before its first change, so intervals of 0 before it are left out. With ``block`` a signal is dealt
    into blocks of so many ticks, with ``rows`` into blocks of about so many rows: for few signals with very many changes.
    """
    c = neighbour(changes.select(*keys, "t", "v"), "t", "t1", "t", keys, block, ahead=True, rows=rows)
    return c.select(*keys, F.col("t").alias("t0"), F.coalesce("t1", F.lit(end).cast("long")).alias("t1"), "v").where("t1 is null or t1 > t0")


def window_starts(t: Column, size: int, overlap: int = 0, first: int = 0) -> Column:
    """Array of the starts u of the windows [u, u + size) that hold ``t``; a negative overlap leaves gaps."""
    stride = size - overlap
    if stride <= 0:
        raise ValueError("windows must move on")
    last = F.floor((t - first) / stride).cast("long")
    low = F.greatest(F.lit(0).cast("long"), F.ceil((t - first - size + 1) / stride).cast("long"))
    return F.when(low <= last, F.transform(F.sequence(low, last), lambda k: k * stride + first)).otherwise(F.array().cast("array<bigint>"))


def window_assign(df: DataFrame, size: int, overlap: int = 0, t: str = "t", first: int = 0) -> DataFrame:
    """Rows with u, the start of a window that holds them: none, one or several for each row."""
    return df.withColumn("u", F.explode(window_starts(F.col(t), size, overlap, first)))


def window_weight(i: Column, n: int, alpha: float = 0.0) -> Column:
    """sin(i * pi / (n - 1)) ** alpha; 1 everywhere for alpha 0 and for windows of one tick."""
    if alpha == 0 or n == 1:
        return F.lit(1.0)
    return F.pow(F.greatest(F.lit(0.0), F.sin(i * (math.pi / (n - 1)))), F.lit(float(alpha)))


def weight_sum(n: int, alpha: float = 0.0) -> float:
    if alpha == 0 or n == 1:
        return float(n)
    return math.fsum(max(0.0, math.sin(i * math.pi / (n - 1))) ** alpha for i in range(n))


def cumulative_weight(k: Column, n: int, alpha: int = 0) -> Column:
    """Sum of the weights of the ticks 0 .. k - 1 of a window of n ticks, in closed form, for a whole alpha.

    A power of a sine is a sum of sines or cosines of multiples of its angle, and the sum of sin(i a) or cos(i a) over
    i < k is sin(k a / 2) / sin(a / 2) times the sine or cosine of (k - 1) a / 2.
    """
    if alpha == 0 or n == 1:
        return k.cast("double")
    if alpha != int(alpha) or alpha < 0:
        raise ValueError("the power has to be a whole number")
    odd, half, out = alpha % 2, alpha // 2, F.lit(0.0)
    for j in range(half + odd):
        a = (alpha - 2 * j) * math.pi / (n - 1)
        sign = (-1) ** (half - j) * math.comb(alpha, j) * 2.0 ** (1 - alpha)
        mid = (F.sin if odd else F.cos)((k - 1) * (a / 2))
        ends = math.sin(a / 2)
        # a whole number of turns a tick: every cosine is 1, every sine 0
        out = out + (F.sin(k * (a / 2)) / ends * mid * sign if abs(ends) > 1e-12 else k.cast("double") * (0.0 if odd else sign))
    return out if odd else out + k.cast("double") * (math.comb(alpha, half) * 2.0**-alpha)


def asof(points: DataFrame, changes: DataFrame, keys: list[str], direction: str = "previous", t: str = "t", rows: int | None = ROWS) -> DataFrame:
    """Each point with the nearest change at or before it ("previous") or at or after it ("next"): change_t, change_v.

    Both sides are one ordered table, so there is no range join; over ``rows`` rows it is dealt into blocks of time, and
    each block gets the nearest change outside of it. Nulls where there is no such change. Of changes at one time, the
    largest value stands for ``previous`` and the least for ``next``.
    """
    back = direction == "previous"
    p = points.select(*keys, F.col(t).alias("t"), F.lit(None).cast(changes.schema["v"].dataType).alias("v"), F.lit(False).alias("change"))
    both = p.unionByName(changes.select(*keys, "t", "v", F.lit(True).alias("change"))).withColumn("later", F.col("change") != F.lit(back))
    # at one time, changes come before points
    best, of = (F.max, F.greatest) if back else (F.min, F.least)
    found = running(both, {"near": F.when(F.col("change"), F.struct("t", "v"))}, ["t", "later"], keys, rows, best, of, descending=not back).where("not change")
    return found.select(*keys, F.col("t").alias(t), F.col("near.t").alias("change_t"), F.col("near.v").alias("change_v"))


def pairs(samples: DataFrame, deltas: list[int], base: str = "signal", keys: tuple[str, ...] = ()) -> DataFrame:
    """Samples x at t with samples y of another base at t + delta: (keys, x, y, delta, t, vx, vy), an equi-join on time."""
    y = samples.withColumn("delta", F.explode(F.array(*[F.lit(d).cast("long") for d in deltas])))
    y = y.select(*keys, F.col("signal").alias("y"), F.col(base).alias("base_y"), "delta", (F.col("t") - F.col("delta")).alias("t"), F.col("v").alias("vy"))
    x = samples.select(*keys, F.col("signal").alias("x"), F.col(base).alias("base_x"), "t", F.col("v").alias("vx"))
    return x.join(y, [*keys, "t"]).where("base_x <> base_y").select(*keys, "x", "y", "delta", "t", "vx", "vy")


def interval_overlap(x: DataFrame, y: DataFrame, size: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Overlapping spans of two tables of intervals (signal, t0, t1, v), by an equi-join on buckets of ``size`` ticks.

    A span is found once: in the bucket where it starts. An interval without t1 is open; a span of two open ones is
    open too. Open intervals lie in all buckets up to the last start of any interval.
    """
    # one number: where the last interval starts, as no span starts later
    last = x.select("t0").union(y.select("t0")).agg(F.max("t0")).first()[0] or 0

    def cut(d: DataFrame, s: str) -> DataFrame:
        d = d.where("t1 is null or t1 > t0").select(*keys, F.col("signal").alias(s), F.col("t0").alias(f"{s}0"), F.col("t1").alias(f"{s}1"), F.col("v").alias(f"v{s}"))
        stop = F.least(F.coalesce(F.col(f"{s}1") - 1, F.lit(last)), F.lit(last))
        return d.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(f"{s}0") / size), F.floor(stop / size))))

    j = cut(x, "x").join(cut(y, "y"), [*keys, "bucket"])
    j = j.withColumn("t0", F.greatest("x0", "y0")).withColumn("t1", F.least("x1", "y1")).where("t1 is null or t0 < t1")
    return j.where(F.col("bucket") == F.floor(F.col("t0") / size)).select(*keys, "x", "y", "t0", "t1", "vx", "vy")


def occur_intersect(x: DataFrame, y: DataFrame) -> DataFrame:
    """Product of two occurrence tables (t, v); absent rows are 0."""
    return x.select("t", F.col("v").alias("a")).join(y.select("t", F.col("v").alias("b")), "t").select("t", (F.col("a") * F.col("b")).alias("v")).where("v <> 0")


def occur_union(x: DataFrame, y: DataFrame) -> DataFrame:
    """Larger value of two occurrence tables (t, v)."""
    return x.select("t", "v").unionByName(y.select("t", "v")).groupBy("t").agg(F.max("v").alias("v"))


def occur_symdiff(x: DataFrame, y: DataFrame) -> DataFrame:
    """Absolute difference of two occurrence tables (t, v)."""
    j = x.select("t", F.col("v").alias("a")).join(y.select("t", F.col("v").alias("b")), "t", "full")
    return j.select("t", F.abs(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("v")).where("v <> 0")


def derive_signals(samples: DataFrame, connections: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Signals that are a fold of others: dst at t takes its sources' values in order under and, or, xor.

    ``samples`` (keys, signal, t, v) has rows for ones only; ``connections`` (keys, dst, ord, src, op) is small and
    gives each source's place and the operation that takes it in (that of the first source is ignored).
    """
    every = connections.groupBy(*keys, "dst").agg(F.array_sort(F.collect_list(F.struct("ord", "src", "op"))).alias("sources"))
    on = samples.where("v <> 0").join(connections.select(*keys, F.col("src").alias("signal"), "dst"), [*keys, "signal"])
    seen = on.groupBy(*keys, "dst", "t").agg(F.collect_set("signal").alias("ones"))
    j = seen.join(every, [*keys, "dst"])
    bit = lambda s: F.when(F.array_contains("ones", s["src"]), 1).otherwise(0)
    step = lambda a, s: F.when(s["op"] == "and", F.least(a, bit(s))).when(s["op"] == "or", F.greatest(a, bit(s))).otherwise(F.abs(a - bit(s)))
    value = F.aggregate(F.slice("sources", F.lit(2), F.greatest(F.lit(0), F.size("sources") - 1)), bit(F.col("sources")[0]), step)
    return j.select(*keys, F.col("dst").alias("signal"), "t", value.alias("v")).where("v <> 0")
