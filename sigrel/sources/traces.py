"""Address traces as change logs, and runs of result files as one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import ranked


def _address(hexed: Column) -> Column:
    """A whole number of up to 64 bits, which may be over the largest long."""
    return F.conv(hexed, 16, 10).cast("decimal(20,0)")


def trace_to_changes(lines: DataFrame, symbols: DataFrame, factor: int = 1, groups: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Trace lines ``time channel 0xaddress`` -> changes (t, signal, raw), and zeros at the first time for the others.

    Times are cut to multiples of ``factor``; channel 0 is a function's exit (0), 1 its entry (1), others x. A signal is
    ``group.symbol``, the group being the one whose range [low, high) holds the address (up to 64 bits); names keep letters,
    digits and _. Addresses without a symbol are ``unknown.<hex>``.
    """
    part = lambda i: F.regexp_extract("value", r"^\s*(\d+)\s+(\d+)\s+0[xX]([0-9a-fA-F]+)\s*$", i)
    x = lines.where(part(1) != "").select((F.floor(part(1).cast("long") / factor) * factor).alias("t"), part(2).cast("int").alias("ch"), _address(part(3)).alias("addr"), F.lower(part(3)).alias("text"))
    s = symbols.select(_address(F.regexp_replace("address", "^0[xX]", "")).alias("addr"), F.regexp_replace("name", r"[^A-Za-z0-9_]", "_").alias("symbol"))
    group = F.lit(None).cast("string")
    for name, (low, high) in (groups or {}).items():
        group = F.when((F.col("addr") >= F.lit(str(low)).cast("decimal(20,0)")) & (F.col("addr") < F.lit(str(high)).cast("decimal(20,0)")), name).otherwise(group)
    j = x.join(s, "addr", "left")
    signal = F.when(F.col("symbol").isNull(), F.concat(F.lit("unknown.0x"), F.col("text"))).otherwise(F.concat_ws(".", group, "symbol"))
    c = j.select("t", signal.alias("signal"), F.when(F.col("ch") == 0, "0").when(F.col("ch") == 1, "1").otherwise("x").alias("raw"))
    start = c.agg(F.min("t").alias("t"))
    begun = c.join(F.broadcast(start), "t", "left_semi").select("signal").distinct()
    zero = c.select("signal").distinct().join(begun, "signal", "left_anti").join(F.broadcast(start)).select("t", "signal", F.lit("0").alias("raw"))
    return c.unionByName(zero)


def rank_signals(changes: DataFrame) -> DataFrame:
    """Signals with their number of changes, most first: rank from 0."""
    n = changes.groupBy("signal").agg(F.count("*").alias("n"))
    same = Window.partitionBy("n").orderBy("signal")
    return ranked(n, "n").withColumn("rank", F.col("rank") + F.row_number().over(same) - 2)


def union_runs(spark: SparkSession, path: str, name_pattern: str, attributes: list[str], schema: str) -> DataFrame:
    """CSV runs with a header each as one table, with attributes taken from the groups of ``name_pattern`` in file paths."""
    df = spark.read.csv(path, header=True, schema=schema)
    name = F.col("_metadata.file_path")
    return df.select("*", *[F.regexp_extract(name, name_pattern, i + 1).alias(a) for i, a in enumerate(attributes)])
