"""Sub-sampling, down-sampling, padding of the last block, and the ladder of shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import neighbour


def _drawn(seed: int, *parts) -> Column:
    """A number below 2**32 from the md5 of a seed and other columns: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def drawn_offset(factor: int | Column, block: Column, algorithm: str = "xor", seed: int = 0, keys: tuple[str, ...] = ("signal",)) -> Column:
    """The tick of a block of ``factor`` ticks that stands for it, from 0: see :func:`subsample`."""
    f = F.lit(factor) if isinstance(factor, int) else factor
    if algorithm == "xor":
        if isinstance(factor, int) and factor & (factor - 1):
            raise ValueError("xor needs a factor that is a power of 2")
        return block.bitwiseAND(f - 1).bitwiseXOR(_drawn(seed, *keys) % f)
    if algorithm == "uniform":
        return _drawn(seed, *keys, block) % f
    raise ValueError("algorithm is xor or uniform")


def subsample(df: DataFrame, factor: int, algorithm: str = "xor", seed: int = 0, keys: tuple[str, ...] = ("signal",), t: str = "t", v: str = "v", padding: str | None = None) -> DataFrame:
    """One row of each block of ``factor`` ticks, at an offset drawn by a seeded hash; t becomes the block's number.

    "uniform" draws the offset of each block anew; "xor" takes (block & (factor - 1)) ^ r with one r a key (factor
    has to be a power of 2). With ``padding``, a mode of :func:`pad_tail`, rows are (keys, t, v) with t = 0..n-1 and
    the last block is filled up first, so that every block has a row; without it a block that lacks the drawn tick
    has none. An aligned input gets no extra block.
    """
    if padding:
        df = pad_tail(df, factor, padding, keys, t, v)
    block = F.floor(F.col(t) / factor).cast("long")
    return df.where(F.pmod(F.col(t), F.lit(factor)) == drawn_offset(factor, block, algorithm, seed, keys)).withColumn(t, block)


_MODES = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}


def downsample(df: DataFrame, factor: int, mode: str = "mean", keys: tuple[str, ...] = ("signal",), t: str = "t", v: str = "v") -> DataFrame:
    """One value of each block of ``factor`` ticks: its mean, median, min or max."""
    return df.groupBy(*keys, F.floor(F.col(t) / factor).cast("long").alias(t)).agg(_MODES[mode](v).cast("double").alias(v))


def pad_tail(df: DataFrame, factor: int, mode: str, keys: tuple[str, ...] = ("signal",), t: str = "t", v: str = "v") -> DataFrame:
    """Rows t = 0..n-1 of each key with the rows added that fill its last block: reflect, wrap, minimum, maximum, mean, median.

    ``reflect`` mirrors around the last row and ``wrap`` starts again at the first; the others add one value of all rows.
    """
    n = df.groupBy(*keys).agg((F.max(t) + 1).alias("_n"), F.min(v).alias("_minimum"), F.max(v).alias("_maximum"), F.avg(v).alias("_mean"), F.median(v).alias("_median"))
    missing = F.pmod(-F.col("_n"), F.lit(factor))
    if mode in ("reflect", "wrap"):
        at: Column = 2 * (F.col("_n") - 1) - F.col(t) if mode == "reflect" else F.col(t) + F.col("_n")
        more = df.join(n.select(*keys, "_n"), list(keys)).withColumn("_at", at).where((F.col("_at") >= F.col("_n")) & (F.col("_at") < F.col("_n") + missing))
        more = more.select(*keys, F.col("_at").alias(t), F.col(v).cast("double").alias(v))
    elif mode in ("minimum", "maximum", "mean", "median"):
        more = n.where(missing > 0).withColumn("_at", F.explode(F.sequence(F.col("_n"), F.col("_n") + missing - 1))).select(*keys, F.col("_at").alias(t), F.col(f"_{mode}").cast("double").alias(v))
    else:
        raise ValueError("mode is reflect, wrap, minimum, maximum, mean or median")
    return df.select(*keys, F.col(t).cast("long").alias(t), F.col(v).cast("double").alias(v)).unionByName(more)


def shift_set(spark: SparkSession, window: int, back: int, forward: int, zoom: int = 0) -> DataFrame:
    """(factor, delta) of a ladder of shifts whose step doubles from one octave to the next.

    Octave k >= 0 has step 2**k and reaches from zoom * (2**k - 1) up to zoom * (2**(k + 1) - 1) ticks to either
    side; both sides stop at the wanted number of shifts, and at half a window. Zoom under 2: one octave for all.
    Forward shifts include 0; those backward are counted from the far end of their octave.
    """
    bk, fw = min(back, window // 2), min(forward, window // 2)
    z = zoom if zoom > 1 else max(bk, fw, 1)
    octaves = spark.range(64).where(F.lit(z) * (F.pow(F.lit(2.0), "id") - 1) < max(bk, fw)).select(F.expr("shiftleft(1L, cast(id as int))").alias("factor"))
    low, high = F.lit(z) * (F.col("factor") - 1), F.lit(z) * (2 * F.col("factor") - 1)

    def side(limit: int, sign: int) -> Column:
        top = F.least(F.lit(limit).cast("long"), high)
        seq = F.sequence(low, top - 1, F.col("factor")) if sign > 0 else F.sequence(-top, -low - 1, F.col("factor"))
        return F.when(low < top, seq).otherwise(F.array().cast("array<bigint>"))

    return octaves.select("factor", F.explode(F.concat(side(bk, -1), side(fw, 1))).alias("delta"))


def non_negative_derivative(df: DataFrame, v: str = "v", keys: tuple[str, ...] = ("signal",), order: str = "t", name: str = "deriv") -> DataFrame:
    """max(0, x - previous - 1) of n-bit values; the first is compared with itself."""
    d = neighbour(df, v, "_had", order, keys)
    return d.withColumn(name, F.greatest(F.lit(0), F.col(v) - F.coalesce("_had", F.col(v)) - 1)).drop("_had")
