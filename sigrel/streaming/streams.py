"""The measures on streams: Structured Streaming over changes and occurrences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.samples import weight_sum, window_weight

_STATE = "last_t long, last_v int"


def stream_measures(changes: DataFrame) -> DataFrame:
    """(signal, t, v in 0/1) as a stream -> (signal, kind, t0, t1): rise and fall pulses, and orig and refl as they end.

    State is the time of a signal's last change and its value, which starts as 0 at 0. A pulse's end is its start + 1, so
    it is emitted with the pulse. Rows of one signal are taken in time order within a batch, of rows at one time the one
    with the larger value; rows that are not later than the last change are late and are dropped. A micro-batch's rows of
    one signal are sorted in memory, so bound micro-batches (maxFilesPerTrigger, maxOffsetsPerTrigger) where they can be large.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t0, v0 = state.get if state.exists else (0, 0)
        started = state.exists
        out = []
        rows = pd.concat([b[["t", "v"]] for b in batches]).sort_values(["t", "v"]).drop_duplicates("t", keep="last")
        rows = rows[rows["t"] > t0] if started else rows
        # only rows that change the value matter: those that differ from the row before, or from the state
        rows = rows[rows["v"] != rows["v"].shift(fill_value=v0)]
        for t, v in zip(rows["t"].tolist(), rows["v"].tolist()):
            out.append((key[0], "rise" if v else "fall", t, t + 1))
            if t > t0:
                out.append((key[0], "orig" if v0 else "refl", t0, t))
            t0, v0 = t, v
        state.update((t0, v0))
        yield pd.DataFrame(out, columns=["signal", "kind", "t0", "t1"])

    return changes.groupBy("signal").applyInPandasWithState(run, "signal string, kind string, t0 long, t1 long", _STATE, "append", GroupStateTimeout.NoTimeout)


def stream_expectation(occurrences: DataFrame, size: str, slide: str | None = None, late: str | None = "10 minutes", tick_s: int = 60, n: int | None = None, alpha: float = 0.0) -> DataFrame:
    """E[X] of occurrences (signal, ts, v) in tumbling or sliding windows; ``n`` ticks of ``tick_s`` seconds a window.

    The weight of an occurrence comes from its tick in the window; windows are final after the watermark
    (``late`` is null where the input has one already).
    """
    ticks = n or 1
    w = (occurrences.withWatermark("ts", late) if late else occurrences).withColumn("window", F.window("ts", size, slide or size))
    i = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.col("window.start"))) / tick_s)
    total = weight_sum(ticks, alpha)
    return w.groupBy("window", "signal").agg((F.sum(window_weight(i, ticks, alpha) * F.col("v")) / total).alias("ex"))


def stream_counters(x: DataFrame, y: DataFrame, size: str, late: str = "10 minutes") -> DataFrame:
    """Per window: occurrences of X, of Y, of both at one time, and of just one of them. x, y: (ts) with one row a time.

    Both streams are one with a flag for each side. Times are grouped first, which keeps the one event time that the
    windows of the second grouping go by; no stream-stream join is needed.
    """
    both = x.select("ts", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(y.select("ts", F.lit(0).alias("x"), F.lit(1).alias("y"))).withWatermark("ts", late)
    at = both.groupBy("ts").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return at.groupBy(F.window("ts", size).alias("window")).agg(F.sum("x").alias("count_x"), F.sum("y").alias("count_y"), F.sum(F.col("x") * F.col("y")).alias("count_isect"), F.sum(F.abs(F.col("x") - F.col("y"))).alias("count_symdiff"))


def stream_clean(changes: DataFrame, late: str = "10 minutes", keys: tuple[str, ...] = ("signal", "ts", "raw")) -> DataFrame:
    """Changes without late rows and without those repeated within the watermark."""
    return changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def stream_last(changes: DataFrame, late: str = "10 minutes", keys: tuple[str, ...] = ("signal",), seq: str = "seq", value: str = "raw") -> DataFrame:
    """Of the changes of one signal at one time the last by ``seq``, once the watermark has passed that time; late rows go."""
    return changes.withWatermark("ts", late).groupBy(*keys, "ts").agg(F.max_by(value, seq).alias(value))
