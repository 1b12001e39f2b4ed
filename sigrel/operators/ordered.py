"""What depends on order, in two steps: within blocks of the order, then over the blocks, so that no window has to hold a
whole signal or a whole table.

Blocks are ranges of the order column cut at its quantiles, so they hold about equally many rows however the values are
spread, and a key's share of a block is no larger than the block. Rows with one value of the first order column stay in
one block. What passes between blocks is one row a key and block. A keyed table of up to ``rows`` rows takes one window
a key instead, with the same result; a table without keys is always dealt into blocks. Keys must not be null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a block, about.
ROWS = 1 << 20
#: Blocks at most; beyond that they hold more rows.
BLOCKS = 1 << 14


def _place(df: DataFrame, column: str) -> Column:
    """A double that doesn't fall where the column rises."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def blocked(df: DataFrame, order: str, keys: Sequence[str] = (), rows: int | None = ROWS) -> DataFrame | None:
    """``df`` with ``_block``, or None where one window a key will do (keys without ``rows``: always); kept if it has one.

    Counts the rows and takes quantiles of the order column (``BLOCKS`` numbers at most), which reads that column twice;
    the quantiles become part of the plan, so every use of it agrees on the blocks.
    """
    if "_block" in df.columns:
        return df
    if keys and rows is None:
        return None
    rows = rows or ROWS
    many = df.count()
    if keys and many <= rows:
        return None
    n = min(BLOCKS, max(-(-many // rows), 1 if keys else df.sparkSession.sparkContext.defaultParallelism))
    at = df.select(_place(df, order).alias("at"))
    cuts = at.agg(F.percentile_approx("at", [k / n for k in range(1, n)], 8 * n)).first()[0] if n > 1 and many else None
    splits = [-float("inf"), *sorted({x for x in cuts or () if x is not None}), float("inf")]
    if len(splits) == 2:
        return df.withColumn("_block", F.lit(0))
    dealt = Bucketizer(splits=splits, inputCol="_place", outputCol="_block", handleInvalid="keep").transform(df.withColumn("_place", F.coalesce(_place(df, order), F.lit(-float("inf")))))
    return dealt.withColumn("_block", F.col("_block").cast("int")).drop("_place")


def _asc(order: Sequence[str], descending: bool = False) -> list[Column]:
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in order]


def _windows(keys: Sequence[str], order: Sequence[str], descending: bool = False) -> tuple[WindowSpec, WindowSpec]:
    """Rows of a block in order, and blocks of a key in order."""
    return Window.partitionBy(*keys, "_block").orderBy(*_asc(order, descending)), Window.partitionBy(*keys).orderBy(*_asc(["_block"], descending))


def running(df: DataFrame, totals: dict[str, Column], order: Sequence[str], keys: Sequence[str] = (), rows: int | None = ROWS, how: Callable[[Column], Column] = F.sum, join: Callable[[Column, Column], Column] = lambda a, b: a + b, descending: bool = False) -> DataFrame:
    """Each total over the rows of a key up to and with each row: sums, or another aggregate ``how`` whose parts ``join``.

    Nulls count as nothing. ``descending`` turns the order round. Rows with equal ``order`` are told apart in no stated way.
    """
    d = blocked(df, order[0], keys, rows)
    to_here = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    if d is None:
        w = to_here(Window.partitionBy(*keys).orderBy(*_asc(order, descending)))
        return df.withColumns({name: how(c).over(w) for name, c in totals.items()})
    inside, across = _windows(keys, order, descending)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    per = d.groupBy(*keys, "_block").agg(*[how(c).alias(f"_t{i}") for i, c in enumerate(totals.values())])
    per = per.select(*keys, "_block", *[how(F.col(f"_t{i}")).over(before).alias(f"_t{i}") for i in range(len(totals))])
    out = d.withColumns({f"_r{i}": how(c).over(to_here(inside)) for i, c in enumerate(totals.values())}).join(per, [*keys, "_block"])
    return out.withColumns({name: F.coalesce(join(F.col(f"_t{i}"), F.col(f"_r{i}")), F.col(f"_r{i}"), F.col(f"_t{i}")) for i, name in enumerate(totals)}).select(*[c for c in df.columns if c not in totals], *totals)


def numbered(df: DataFrame, order: str | Sequence[str], name: str = "number", keys: Sequence[str] = (), rows: int | None = ROWS) -> DataFrame:
    """Rows of a key numbered from 0 in order."""
    out = running(df.withColumn("_one", F.lit(1).cast("long")), {name: F.col("_one")}, [order] if isinstance(order, str) else list(order), keys, rows)
    return out.withColumn(name, F.col(name) - 1).drop("_one").select(*[c for c in df.columns if c != name], name)


def carried(df: DataFrame, columns: Sequence[str], order: str = "t", keys: Sequence[str] = (), rows: int | None = ROWS) -> DataFrame:
    """Each column's last value that isn't null up to a row."""
    held = running(df, {f"_{i}": F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"))) for i, c in enumerate(columns)}, [order], keys, rows, lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a))
    return held.withColumns({c: F.col(f"_{i}")["v"] for i, c in enumerate(columns)}).select(*df.columns)


def neighbour(df: DataFrame, value: str, name: str, order: str | Sequence[str] = "t", keys: Sequence[str] = ("signal",), block: int | None = None, ahead: bool = False, rows: int | None = ROWS) -> DataFrame:
    """Column ``name``: the ``value`` of a key's row before (or ``ahead``: after) in ``order``, null where there is none.

    Rows of a key with different ``order`` are told apart. With ``block`` the blocks are ranges of so many ticks, which
    needs no pass over the data before.
    """
    order = [order] if isinstance(order, str) else list(order)
    d = df.withColumn("_block", F.floor(F.col(order[0]) / block)) if block else blocked(df, order[0], keys, rows)
    step = F.lead if ahead else F.lag
    if d is None:
        return df.withColumn(name, step(value).over(Window.partitionBy(*keys).orderBy(*_asc(order))))
    inside, across = _windows(keys, order)
    held = F.struct(F.col(value).alias("v"))
    edge = d.groupBy(*keys, "_block").agg((F.min_by if ahead else F.max_by)(held, F.struct(*order)).alias("_edge"))
    edge = edge.select(*keys, "_block", step("_edge").over(across).alias("_next"))
    out = d.withColumn("_near", step(held).over(inside)).join(edge, [*keys, "_block"])
    return out.withColumn(name, F.coalesce("_near", "_next")["v"]).select(*[c for c in df.columns if c != name], name)


def recent(df: DataFrame, value: Column, k: int, name: str, order: Sequence[str] = ("t",), keys: Sequence[str] = ("signal",), rows: int | None = ROWS) -> DataFrame:
    """Column ``name``: the values, not null, of the k rows of a key before each row, oldest first; fewer at the start.

    Each block gets the last k rows before it as a halo: those of the k blocks before it, as each has a row.
    """
    if k < 1:
        return df.withColumn(name, F.filter(F.array(value), lambda _: F.lit(False)))
    d = blocked(df, order[0], keys, rows)
    if d is None:
        return df.withColumn(name, F.collect_list(value).over(Window.partitionBy(*keys).orderBy(*_asc(order)).rowsBetween(-k, -1)))
    inside, across = _windows(keys, order)
    d = d.withColumn("_v", value)
    back = Window.partitionBy(*keys, "_block").orderBy(*[F.col(c).desc_nulls_last() for c in order])
    tail = d.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= k)
    tail = tail.groupBy(*keys, "_block").agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("_n", "_v")))), lambda s: s["_v"]).alias("_tail"))
    halo = F.flatten(F.collect_list("_tail").over(across.rowsBetween(-k, -1)))
    halo = tail.select(*keys, "_block", halo.alias("_halo"))
    out = d.withColumn("_own", F.collect_list("_v").over(inside.rowsBetween(-k, -1))).join(halo, [*keys, "_block"])
    both = F.concat("_halo", "_own")
    return out.withColumn(name, F.slice(both, F.greatest(F.lit(1), F.size(both) - k + 1), k)).select(*[c for c in df.columns if c != name], name)


def ranked(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Rank of each row by ``value``, largest first, equal ones alike: the window runs over distinct values only."""
    per = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, value, (F.coalesce(F.sum("_n").over(w), F.lit(0)) + 1).cast("int").alias(name))
    return df.join(per, [*keys, value]).select(*df.columns, name)
