"""Fixed-width binary files and counter packets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Formats of a record and their widths in bytes.
FORMATS = {"u8": 1, "u16": 2, "u32": 4, "u64": 8, "i8": 1, "i16": 2, "i32": 4, "i64": 8, "f16": 2, "f32": 4, "f64": 8}


#: Records that are decoded at once.
LOT = 1 << 14


def _lots(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(first, records): many records of a partition as one binary, with the index of the first one.

    Spark splits large files at record borders; the index follows the names of the files, then their records.
    """
    files = sorted(unquote(f) for f in spark.read.format("binaryFile").load(path).inputFiles())
    in_order = ",".join(f.replace("\\", "\\\\").replace(",", "\\,") for f in files) or path

    def lots(part: int, records: Iterator[bytes]) -> Iterator[tuple[int, int, bytearray]]:
        at = 0
        while lot := list(islice(records, LOT)):
            yield part, at, bytearray(b"".join(lot))
            at += len(lot)

    rdd = spark.sparkContext.binaryRecords(in_order, width).mapPartitionsWithIndex(lots)
    d = spark.createDataFrame(rdd, "part int, at long, records binary")
    # one row a partition of the file
    sizes = d.groupBy("part").agg(F.sum(F.octet_length("records") / width).cast("long").alias("n"))
    earlier = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return d.join(starts, "part").select((F.col("start") + F.col("at")).alias("first"), "records")


def decode_records(spark: SparkSession, path: str, fmt: str, little_endian: bool = True) -> DataFrame:
    """Records of files as (index, value, hex, bits); u64 values are decimals, floats doubles, other integers longs."""
    width = FORMATS[fmt]
    dtype = np.dtype(("<" if little_endian else ">") + fmt[0] + str(width))
    kind = {"u64": "decimal(20,0)"}.get(fmt, "double" if fmt[0] == "f" else "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from decimal import Decimal

        for first, records in (x for b in batches for x in zip(b["first"], b["records"])):
            v = np.frombuffer(records, dtype)
            value = [Decimal(int(x)) for x in v] if fmt == "u64" else v.astype(np.float64 if fmt[0] == "f" else np.int64)
            big = v.astype(v.dtype.newbyteorder(">"))
            texts = [big[i : i + 1].tobytes() for i in range(len(big))]
            yield pd.DataFrame({"index": np.arange(first, first + len(v)), "value": value, "hex": [x.hex() for x in texts], "bits": ["".join(f"{c:08b}" for c in x) for x in texts]})

    return _lots(spark, path, width).mapInPandas(run, f"index long, value {kind}, hex string, bits string")


def decode_counter_packets(spark: SparkSession, path: str, window: int, period: float | None = None) -> DataFrame:
    """5-byte packets as counts in windows of ``window`` samples, with their expectations and, given the sample period, times.

    The window number is one byte and wraps; ``index`` goes on.
    """
    names = ("win_num", "count_x", "count_y", "count_isect", "count_symdiff")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for first, records in (x for b in batches for x in zip(b["first"], b["records"])):
            v = np.frombuffer(records, np.uint8).reshape(-1, 5).astype(np.int32)
            yield pd.DataFrame({"index": np.arange(first, first + len(v))} | {n: v[:, i] for i, n in enumerate(names)})

    out = _lots(spark, path, 5).mapInPandas(run, "index long, " + ", ".join(f"{n} int" for n in names))
    out = out.withColumns({"ex": F.col("count_x") / window, "ey": F.col("count_y") / window, "exy": F.col("count_isect") / window, "ediff": F.col("count_symdiff") / window})
    return out.withColumn("seconds", F.col("index") * (window * period)) if period else out


def byte_histogram(df: DataFrame, column: str) -> DataFrame:
    """How often each byte value occurs in the UTF-8 text of a column: (byte, n)."""
    codes = F.regexp_extract_all(F.hex(F.encode(column, "utf-8")), F.lit("(..)"))
    return df.select(F.explode(codes).alias("h")).groupBy("h").agg(F.count("*").alias("n")).select(F.conv("h", 16, 10).cast("int").alias("byte"), "n")
