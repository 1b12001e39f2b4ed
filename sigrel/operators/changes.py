"""Change logs as tables (t, seq, var_id, raw): cleaning, description, wide and nested forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ROWS, carried, neighbour, numbered, ranked


def clean_changes(changes: DataFrame, drop_redundant: bool = False, events: Sequence[str] = (), keys: tuple[str, ...] = (), rows: int | None = ROWS) -> DataFrame:
    """The last value of each variable and time; with ``drop_redundant`` only where it differs from the one before.

    Variables in ``events`` are never redundant. Over ``rows`` rows, a variable is dealt into blocks of time, and the
    last value of the blocks before is carried into each.
    """
    last = Window.partitionBy(*keys, "var_id", "t").orderBy(F.desc("seq"))
    out = changes.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    if drop_redundant:
        had = neighbour(out.withColumn("_held", F.struct("raw")), "_held", "_had", "t", [*keys, "var_id"], rows=rows)
        same = F.col("_had").isNotNull() & F.col("raw").eqNullSafe(F.col("_had.raw"))
        keep = ~same | F.col("var_id").isin(list(events)) if events else ~same
        out = had.where(keep).drop("_held", "_had")
    return out


def describe_changes(changes: DataFrame, keys: tuple[str, ...] = (), rows: int | None = ROWS) -> DataFrame:
    """Of each variable: changes, changes of value (the first counts), first and last time, rank by changes."""
    x = neighbour(changes, "raw", "_had", ["t", "seq"], [*keys, "var_id"], rows=rows).withColumn("_new", ~F.col("raw").eqNullSafe(F.col("_had")))
    d = x.groupBy(*keys, "var_id").agg(F.count("*").alias("changes"), F.sum(F.col("_new").cast("long")).alias("toggles"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return ranked(d, "changes", keys)


def describe_chunks(changes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Of each time: how many variables change (the number of a chunk is its place in time order)."""
    c = changes.groupBy(*keys, "t").agg(F.count("*").alias("changes"))
    return numbered(c, "t", keys=keys)


# Words for states in wide tables.
ONES, ZEROS = ("1", "yes", "y", "true", "t"), ("0", "no", "n", "false", "f")
UNKNOWN, HIGH_Z = ("x", "2", "unknown", "neither"), ("z", "3", "highz", "both")


def _lookup(types: dict[str, tuple[str, int]], i: int) -> Column:
    out = F.lit(None).cast("int" if i else "string")
    for name, entry in types.items():
        out = F.when(F.col("var_id") == name, F.lit(entry[i])).otherwise(out)
    return out


def _state(cell: Column) -> Column:
    c = F.lower(F.trim(cell))
    known = F.when(c.isin(*ONES), "1").when(c.isin(*ZEROS), "0").when(c.isin(*UNKNOWN), "x").when(c.isin(*HIGH_Z), "z")
    return known.when(c.isNotNull(), F.raise_error(F.concat(F.lit("no word for a state: "), c)).cast("string"))


def _bare(digits: Column) -> Column:
    return F.regexp_replace(digits, "^0+(?=.)", "")


def _binary(c: Column) -> Column:
    """Binary digits of 0x or 0b text of any width, or of decimal text of up to 38 digits (longer ones are an error)."""
    hexed = F.transform(F.split(F.substring(c, 3, 1 << 20), ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0"))
    part, whole = F.lit(1 << 42).cast("decimal(14,0)"), F.expr("try_cast(_number as decimal(38,0))")
    low = whole % part
    mid = F.floor((whole - low) / part).cast("decimal(26,0)")
    high = F.floor((mid - mid % part) / part)
    bits = lambda x: F.lpad(F.conv(x.cast("long").cast("string"), 10, 2), 42, "0")
    long = F.concat(bits(high), bits(mid % part), bits(low))
    decimal = F.when(F.length(c) <= 18, F.conv(c, 10, 2)).when(whole.isNotNull(), _bare(long)).otherwise(F.raise_error(F.concat(F.lit("no number of up to 38 digits: "), c)).cast("string"))
    return F.when(c.startswith("0x"), _bare(F.array_join(hexed, ""))).when(c.startswith("0b"), F.substring(c, 3, 1 << 20)).otherwise(decimal)


def _within(c: Column, digits: Column, width: Column) -> Column:
    """The digits of a negative number as two's complement of the variable's width; other numbers as they are."""
    minus = F.lpad(F.right(digits, width), width, "1")
    return F.when(c.startswith("-"), minus).otherwise(digits)


def wide_to_changes(df: DataFrame, types: dict[str, tuple[str, int]], time_col: str | None = None, time_mul: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """A wide table -> (keys, t, var_id, raw) of cells that change; ``types`` gives (kind, width) of each column.

    A cell of ``-`` or nothing is no value. Events are ``*``; they are emitted whenever they occur. One-bit cells are
    words for states (another word is an error), real ones r<number>, strings s<text>, integers, parameters and wider
    ones b<digits> from decimal, 0x or 0b text of any width; a negative number (of 18 digits at most) is the two's
    complement of its variable's width. Without a time column
    rows are numbered by ``_row`` (a column the caller gives, as rows of a table have no order of their own).
    """
    t = F.floor(F.col(time_col).cast("double") * float(time_mul)).cast("long") if time_col else F.col("_row").cast("long")
    long = df.select(*keys, t.alias("t"), *[F.col(c).cast("string").alias(c) for c in types]).unpivot([*keys, "t"], list(types), "var_id", "cell")
    long = long.withColumn("cell", F.when(~F.trim("cell").isin("-", ""), F.trim("cell")))
    of = lambda i: _lookup(types, i)
    kind, width, c = of(0), of(1), F.lower("cell")
    long = long.withColumn("_number", F.when(~kind.isin("real", "string", "event") & ~c.rlike("^0[xb]"), c))
    one_bit = (width == 1) & ~kind.isin("integer", "parameter")
    raw = F.when(kind == "event", F.when(F.col("cell") == "*", "1")).when(kind == "real", F.concat(F.lit("r"), c.cast("double").cast("string"))).when(kind == "string", F.concat(F.lit("s"), "cell")).when(one_bit, _state(F.col("cell"))).otherwise(F.concat(F.lit("b"), _within(c, _binary(c), width)))
    long = long.withColumn("raw", raw).withColumn("_event", kind == "event").where("raw is not null")
    w = Window.partitionBy(*keys, "var_id").orderBy("t")
    return long.withColumn("_before", F.lag("raw").over(w)).where(F.col("_event") | ~F.col("raw").eqNullSafe(F.col("_before"))).select(*keys, "t", "var_id", "raw")


def _hex(digits: Column, width: Column) -> Column:
    """Hex of a binary text of any width, four digits at a time."""
    n = F.ceil(width / 4).cast("int")
    padded = F.lpad(digits, (n * 4), "0")
    groups = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lower(F.conv(F.substr(padded, i * 4 + 1, F.lit(4)), 2, 16)))
    text = F.regexp_replace(F.array_join(groups, ""), "^0+(?=.)", "")
    return F.concat(F.lit("0x"), text)


def changes_to_wide(changes: DataFrame, variables: dict[str, tuple[str, int]], keys: tuple[str, ...] = ()) -> DataFrame:
    """One row a time with the last known value of each variable, as text: ``-`` before there is one.

    Events are ``*`` at their times and ``-`` else; reals have 6 decimals; vectors are hex, or 0b.. if they have x or z.
    """
    of = lambda i: _lookup(variables, i)
    kind, width, raw = of(0), of(1), F.col("raw")
    digits = F.regexp_replace(F.lower(raw), "^b", "")
    cell = F.when(kind == "event", "*").when(kind == "string", F.substring(raw, 2, 1 << 20)).when(kind == "real", F.format_string("%.6f", F.regexp_replace(raw, "^[rR]", "").cast("double"))).when(width == 1, digits).when(digits.rlike("[xz]"), F.concat(F.lit("0b"), digits)).otherwise(_hex(digits, width))
    wide = changes.where(F.col("var_id").isin(list(variables))).select(*keys, "t", "var_id", cell.alias("cell")).groupBy(*keys, "t").pivot("var_id", list(variables)).agg(F.max("cell"))
    if not keys:
        plain = {c: f"c{i}" for i, c in enumerate(variables)}
        renamed = wide.select("t", *[F.col(f"`{c}`").alias(p) for c, p in plain.items()])
        full = carried(renamed, [plain[c] for c, k in variables.items() if k[0] != "event"])
        return full.select("t", *[F.coalesce(p, F.lit("-")).alias(c) for c, p in plain.items()])
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    held = {c: F.coalesce(F.col(f"`{c}`") if k[0] == "event" else F.last(F.col(f"`{c}`"), ignorenulls=True).over(w), F.lit("-")) for c, k in variables.items()}
    return wide.select(*keys, "t", *[v.alias(c) for c, v in held.items()])


def nest_changes(changes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row a time with an array of struct(var_id, raw) in the order of seq."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "var_id", "raw"))), lambda s: F.struct(s["var_id"].alias("var_id"), s["raw"].alias("raw")))
    return changes.groupBy(*keys, "t").agg(listed.alias("changes"))


def unnest_changes(nested: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return nested.select(*keys, "t", F.posexplode("changes").alias("seq", "c")).select(*keys, "t", F.col("seq").cast("long"), "c.var_id", "c.raw")


def to_json_lines(nested: DataFrame) -> DataFrame:
    return nested.select(F.to_json(F.struct(*nested.columns)).alias("value"))


def from_json_lines(lines: DataFrame, schema: str = "t bigint, changes array<struct<var_id:string,raw:string>>") -> DataFrame:
    return lines.select(F.from_json("value", schema).alias("j")).select("j.*")
