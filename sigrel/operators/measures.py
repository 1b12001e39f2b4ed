"""Measures over change logs: sampling, decoding, events, states, thresholds, smoothed values and their siblings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip_norm
from .ordered import ROWS, blocked, neighbour, recent
from .samples import hold

# The siblings of each type of measure, those that only lead to a normal one, and the keys of a measure.
SIBLINGS = {"event": ("orig",), "bstate": ("orig", "refl", "rise", "fall"), "threshold": ("orig", "refl", "rise", "fall"), "normal": ("orig",)}
INTERMEDIATE = {"normal": ("raw", "smooth")}
MEASURE_KEYS = ("type", "name", "hook", "subs", "geq", "leq")


def sample_filter(changes: DataFrame, start: int = 0, stop: int = 0, step: int = 1) -> DataFrame:
    """Changes from start to stop (both included, 0: no end) that lie on multiples of step, rebased to (t - start) div step."""
    out = changes.where((F.col("t") >= start) & (F.col("t") % step == 0))
    if stop:
        out = out.where(F.col("t") <= stop)
    return out.withColumn("t", F.floor((F.col("t") - start) / step).cast("long"))


def decode_state(raw: Column, bit: Column | int | None = None) -> Column:
    """0 or 1 of a value's text with x as 0 and z as 1: a bit counted from the right, or whether any is set. Any width."""
    digits = F.translate(F.regexp_replace(F.lower(raw), "^b", ""), "xz", "01")
    if bit is None:
        return F.when(digits.contains("1"), 1).otherwise(0)
    b = F.lit(bit) if isinstance(bit, int) else bit
    return F.when((F.length(digits) > b) & (F.substr(digits, F.length(digits) - b, F.lit(1)) == "1"), 1).otherwise(0)


def decode_number(raw: Column) -> Column:
    """A double of a real (r...) or an unsigned binary value of any width; x as 0 and z as 1.

    Digits are taken in lots of 32, the highest first; over 53 bits the value is that of the nearest doubles on the way.
    """
    digits = F.regexp_replace(F.translate(F.regexp_replace(F.lower(raw), "^b", ""), "xz", "01"), "^0+(?=.)", "")
    real = F.regexp_extract(raw, r"^[rR](.*)$", 1)
    lots = F.ceil(F.length(digits) / 32).cast("int")
    padded = F.lpad(digits, lots * 32, "0")
    long = F.aggregate(F.sequence(F.lit(0), lots - 1), F.lit(0.0), lambda a, i: a * float(1 << 32) + F.conv(F.substr(padded, i * 32 + 1, F.lit(32)), 2, 10).cast("double"))
    return F.when(real != "", real.cast("double")).when(F.length(digits) <= 63, F.conv(digits, 2, 10).cast("double")).otherwise(long)


def measure_event(changes: DataFrame, keys: tuple[str, ...] = ("signal",), level: bool = False, end: int | None = None) -> DataFrame:
    """Occurrences as intervals of one tick: (keys, t0, t1, v = 1). With ``level`` the signal is a state of one bit
    (keys, t, v in 0/1), whose ones last until it changes, or until ``end``."""
    if level:
        return hold(changes, end, keys).where("v = 1").withColumn("v", F.lit(1.0))
    return changes.select(*keys, "t").distinct().select(*keys, F.col("t").alias("t0"), (F.col("t") + 1).alias("t1"), F.lit(1.0).alias("v"))


def edges(levels: DataFrame, keys: tuple[str, ...] = ("signal",), block: int | None = None, rows: int | None = None) -> DataFrame:
    """Level changes (keys, t, v in 0/1) with rise and fall against the value before, which is 0 at first.

    With ``block`` a signal is dealt into blocks of so many ticks, with ``rows`` into blocks of about so many rows."""
    d = neighbour(levels, "v", "_b", "t", keys, block, rows=rows)
    was = F.coalesce("_b", F.lit(0))
    return d.withColumn("rise", ((F.col("v") == 1) & (was == 0)).cast("int")).withColumn("fall", ((F.col("v") == 0) & (was == 1)).cast("int")).drop("_b")


def siblings(levels: DataFrame, end: int | None = None, keys: tuple[str, ...] = ("signal",), rows: int | None = ROWS) -> DataFrame:
    """A level's sibling measures as intervals of ones: (keys, sibling, t0, t1); pulses are one tick long.

    ``refl`` is where the level is 0, from tick 0 on.
    """
    dealt = blocked(levels, "t", keys, rows)
    e = edges(levels if dealt is None else dealt, keys)
    e = neighbour(neighbour(e, "t", "_before", "t", keys, rows=None), "t", "t1", "t", keys, ahead=True, rows=None)
    e = e.withColumn("t1", F.coalesce("t1", F.lit(end).cast("long"))).withColumn("first", F.col("_before").isNull())
    span = lambda on, name, a, b: F.when(on, F.struct(F.lit(name).alias("sibling"), a.alias("t0"), b.alias("t1")))
    t = F.col("t")
    each = F.array(
        span(F.col("v") == 1, "orig", t, F.col("t1")), span(F.col("v") == 0, "refl", t, F.col("t1")), span(F.col("first") & (t > 0), "refl", F.lit(0).cast("long"), t),
        span(F.col("rise") == 1, "rise", t, t + 1), span(F.col("fall") == 1, "fall", t, t + 1),
    )
    out = e.select(*keys, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("s"))
    return out.select(*keys, "s.sibling", "s.t0", "s.t1").where("t1 is null or t1 > t0")


def threshold(v: Column, geq: float | None = None, leq: float | None = None) -> Column:
    """1 where a value passes: one bound alone; inside if geq < leq; else outside, where either bound holds."""
    if geq is None and leq is None:
        raise ValueError("a threshold needs a bound")
    if geq is None:
        ok = v <= leq
    elif leq is None:
        ok = v >= geq
    elif geq < leq:
        ok = (v >= geq) & (v <= leq)
    else:
        ok = (v >= geq) | (v <= leq)
    return F.when(ok, 1).otherwise(0)


def measure_threshold(values: DataFrame, geq: float | None = None, leq: float | None = None, end: int | None = None, keys: tuple[str, ...] = ("signal",), rows: int | None = ROWS) -> DataFrame:
    """Threshold a held value (keys, t, v) and give the siblings of the state."""
    return siblings(values.withColumn("v", threshold(F.col("v"), geq, leq)), end, keys, rows)


def fir(df: DataFrame, coeffs: Sequence[float], value: str = "v", keys: tuple[str, ...] = ("signal",), order: str = "t", name: str = "smooth", rows: int | None = ROWS) -> DataFrame:
    """Finite impulse response over consecutive rows, the newest first; before the first row the values are 0.

    Over ``rows`` rows, blocks of the order get the last len(coeffs) - 1 values before them as a halo.
    """
    now = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    d = recent(df, now, len(coeffs) - 1, "_back", [order], keys, rows)
    out = now * float(coeffs[0])
    for i, c in enumerate(coeffs[1:], 1):
        out = out + F.coalesce(F.get("_back", F.size("_back") - i), F.lit(0.0)) * float(c)
    return d.withColumn(name, out).drop("_back")


def measure_normal(changes: DataFrame, geq: float = 0.0, leq: float = 1.0, coeffs: Sequence[float] = (1.0,), end: int | None = None, keys: tuple[str, ...] = ("signal",), rows: int | None = ROWS) -> DataFrame:
    """A held value, smoothed tick by tick, then clipped and scaled to [0, 1]: intervals (keys, t0, t1, v).

    A held value is constant once all taps see it, so only the first len(coeffs) ticks of an interval are expanded;
    the rest stays one interval. Taps that reach before the first change see 0. Over ``rows`` rows, blocks of time get
    the intervals before them that their taps can see as a halo.
    """
    n = len(coeffs)
    iv = hold(changes, end, keys, rows=rows)
    own = F.struct("t0", "t1", "v")
    # enough earlier changes to cover n - 1 ticks back: the taps read the intervals around the tick
    x = recent(iv, own, n - 1, "around", ["t0"], keys, rows).withColumn("around", F.concat("around", F.array(own)))
    last = F.when(F.col("t1").isNull(), F.col("t0") + n - 1).otherwise(F.least(F.col("t1") - 1, F.col("t0") + n - 1))
    x = x.withColumn("at", F.explode(F.sequence("t0", last)))

    def tap(i: int) -> Column:
        t = F.col("at") - i
        hit = F.filter("around", lambda r: (r["t0"] <= t) & (r["t1"].isNull() | (r["t1"] > t)))
        return F.coalesce(F.try_element_at(hit, F.lit(1))["v"].cast("double"), F.lit(0.0))

    total = F.lit(0.0)
    for i, c in enumerate(coeffs):
        total = total + tap(i) * float(c)
    stop = F.when(F.col("at") < F.col("t0") + n - 1, F.col("at") + 1).otherwise(F.col("t1"))
    return x.select(*keys, F.col("at").alias("t0"), stop.alias("t1"), clip_norm(total, geq, leq).alias("v"), total.alias("smooth"))


def split_measure_name(name: Column) -> Column:
    """struct(mtype, sibling, base) of ``type.sibling.base...``; null where there are fewer than 3 parts."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) >= 3, F.struct(parts[0].alias("mtype"), parts[1].alias("sibling"), F.array_join(F.slice(parts, F.lit(3), F.greatest(F.lit(0), F.size(parts) - 2)), ".").alias("base")))


def unit_interval_names(names: DataFrame, name: str = "name") -> DataFrame:
    """The rows whose measure has values in [0, 1]: known types and siblings, but for raw and smooth ones."""
    p = split_measure_name(F.col(name))
    ok = [(p["mtype"] == k) & p["sibling"].isin(*v) for k, v in SIBLINGS.items()]
    return names.where(F.coalesce(F.array_max(F.array(*ok)), F.lit(False)))


def sibling_names(names: DataFrame) -> DataFrame:
    """Every sibling measure of each measure in ``names`` (mtype, base): adds sibling and name."""
    table = F.create_map(*[x for k, v in SIBLINGS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    out = names.withColumn("sibling", F.explode(table[F.col("mtype")]))
    return out.withColumn("name", F.concat_ws(".", "mtype", "sibling", "base"))


def check_measures(measures: DataFrame, strict: bool = False) -> DataFrame:
    """Violations (name, rule) of measures (name, hook, mtype, geq, leq): rows that a job can't use.

    A column ``keys``, where there is one, lists the keys that a measure was written with; unknown ones count too."""
    m = F.col("mtype")
    rules = {
        "unknown type": ~F.coalesce(m.isin(*SIBLINGS), F.lit(False)),
        "no hook": F.coalesce(F.trim("hook"), F.lit("")) == "",
        "no name": F.coalesce(F.trim("name"), F.lit("")) == "",
        "threshold without bound": (m == "threshold") & F.col("geq").isNull() & F.col("leq").isNull(),
        "unknown key": F.size(F.array_except("keys", F.array(*map(F.lit, MEASURE_KEYS)))) > 0 if "keys" in measures.columns else F.lit(False),
        "empty range": (m == "normal") & (F.coalesce("geq", F.lit(0.0)) >= F.coalesce("leq", F.lit(1.0))),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    out = measures.withColumn("rule", F.explode(found)).select("name", "rule")
    return out.where(F.raise_error(F.concat(F.lit("measure "), F.col("name"), F.lit(": "), F.col("rule"))).isNotNull()) if strict else out


def bind_measures(measures: DataFrame, variables: DataFrame, prefix: str = "") -> DataFrame:
    """Measures with var_id, kind, width and bit, found by prefix + hook with any ``[..]`` left out; ``problem`` says what is wrong."""
    plain = lambda c: F.regexp_replace(c, r"\[[^\]]*\]", "")
    hook = F.concat(F.lit(prefix), F.col("hook"))
    bit = F.regexp_extract("hook", r"\[(\d+)\]\s*$", 1)
    m = measures.withColumn("path", plain(hook)).withColumn("bit", F.when(bit != "", bit.cast("int")))
    v = variables.groupBy(plain(F.col("name")).alias("path")).agg(F.min(F.struct("var_id", "kind", "width")).alias("v"))
    out = m.join(v, "path", "left").select(*measures.columns, "path", "bit", "v.var_id", "v.kind", "v.width")
    return out.withColumn("problem", F.when(F.col("var_id").isNull(), "no such variable").when(F.col("bit") >= F.col("width"), "bit outside of width"))


def unit_interval_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows of each column outside [0, 1], nulls and NaNs apart: one row a column."""
    parts = []
    for c in cols:
        v = F.col(c).cast("double")
        parts += [F.count_if(v < 0).alias(f"{c}|low"), F.count_if((v > 1) & ~F.isnan(v)).alias(f"{c}|high"), F.count_if(v.isNull() | F.isnan(v)).alias(f"{c}|undefined"), F.count("*").alias(f"{c}|rows")]
    one = df.agg(*parts)
    pick = lambda c: F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{k}`").alias(k) for k in ("low", "high", "undefined", "rows")])
    return one.select(F.explode(F.array(*map(pick, cols))).alias("r")).select("r.*")


def comparison_report(df: DataFrame, rules: dict[str, tuple[str, str, float | str]]) -> DataFrame:
    """Violations of rules name -> (column, one of eq leq geq lt gt, number or column): (rule, violations, rows)."""
    ops = {"eq": lambda a, b: a == b, "leq": lambda a, b: a <= b, "geq": lambda a, b: a >= b, "lt": lambda a, b: a < b, "gt": lambda a, b: a > b}
    bad = {n: ~F.coalesce(ops[op](F.col(c), F.col(v) if isinstance(v, str) else F.lit(v)), F.lit(False)) for n, (c, op, v) in rules.items()}
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(b).alias(f"r{i}") for i, b in enumerate(bad.values())])
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations"), F.col("rows")) for i, n in enumerate(bad)])
    return one.select(F.explode(each).alias("r")).select("r.*")
