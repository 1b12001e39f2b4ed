"""Two-step scans against plain Python, with ties, gaps, nulls and skewed times, and what their plans hold."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sigrel.operators import changes as ch
from sigrel.operators import measures as me
from sigrel.operators import ordered as od
from sigrel.operators import samples as sa
from sigrel.operators import series as se
from sigrel.operators import text_jobs as tj


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = []
    for s in "abc":
        for t in sorted(rng.sample([*range(60), *range(10**9, 10**9 + 40)], {"a": 70, "b": 9, "c": 1}[s])):
            out.append((s, t, None if rng.random() < 0.2 else float(rng.randrange(4))))
    return out


def by_key(rows):
    out = {}
    for s, t, v in sorted(rows, key=lambda r: r[:2]):
        out.setdefault(s, []).append((t, v))
    return out


def windows(df):
    """Partition and order columns of the windows of a plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return re.findall(r"windowspecdefinition\(([^)]*)", plan)


def test_scans_equal_plain_ones(spark, rows):
    d = spark.createDataFrame(rows, "signal string, t long, v double")
    key = by_key(rows)
    for n in (1, 7, 1000):
        got = {(r["signal"], r["t"]): r for r in od.numbered(od.running(d, {"sum": F.col("v"), "top": F.col("v") * 2}, ["t"], ["signal"], n), "t", "k", ["signal"], n).collect()}
        back = {(r["signal"], r["t"]): r["x"] for r in od.recent(d, F.coalesce("v", F.lit(-1.0)), 3, "x", ["t"], ["signal"], n).collect()}
        held = {(r["signal"], r["t"]): r["v"] for r in od.carried(d, ["v"], "t", ["signal"], n).collect()}
        near = {(r["signal"], r["t"]): r["x"] for r in od.neighbour(d, "v", "x", "t", ["signal"], rows=n, ahead=True).collect()}
        for s, x in key.items():
            last, seen = None, []
            for k, (t, v) in enumerate(x):
                seen += [v] * (v is not None)
                last = v if v is not None else last
                assert got[s, t]["k"] == k and got[s, t]["sum"] == (sum(seen) if seen else None) and held[s, t] == last
                assert back[s, t] == [-1.0 if w is None else w for _, w in x[max(0, k - 3) : k]]
                assert near[s, t] == (x[k + 1][1] if k + 1 < len(x) else None)
    whole = {r["t"]: r["number"] for r in od.numbered(d.where("signal = 'a'"), "t").collect()}
    assert whole == {t: k for k, (t, _) in enumerate(key["a"])}
    for col, order in (("date_add(date'2020-01-01', cast(t % 1000 as int))", sorted(t % 1000 for t, _ in key["a"])), ("lpad(cast(t as string), 12, 'a')", None)):
        one = d.where("signal = 'a'").select(F.expr(col).alias("o"), "t").dropDuplicates(["o"])
        got = [r["number"] for r in od.numbered(one, ["o"], rows=6).orderBy("o").collect()]
        assert got == list(range(len(got)))
    assert od.running(d.where("t < 0"), {"s": F.col("v")}, ["t"]).count() == 0


def test_asof_fir_normal_and_cleaning_in_blocks(spark, rows):
    d = spark.createDataFrame(rows, "signal string, t long, v double")
    key = by_key(rows)
    points = spark.createDataFrame([(s, t) for s in "abz" for t in range(-1, 70, 3)] + [("a", 10**9 + 5)], "signal string, at long")
    double = d.unionByName(d.withColumn("v", F.col("v") + 1))  # two changes at each time
    text = lambda df: sorted(map(str, df.collect()))
    for n in (5, 1000):
        for how in ("previous", "next"):
            got = {(r["signal"], r["at"]): (r["change_t"], r["change_v"]) for r in sa.asof(points, double.where("v is not null"), ["signal"], how, "at", n).collect()}
            for (s, at), found in got.items():
                x = [(t, v + up) for t, v in key.get(s, ()) if v is not None for up in (0, 1) if (t <= at if how == "previous" else t >= at)]
                assert found == ((max if how == "previous" else min)(x) if x else (None, None))
        fir = {(r["signal"], r["t"]): r["smooth"] for r in me.fir(d, [0.5, 0.25, 0.25], rows=n).collect()}
        for s, x in key.items():
            for k, (t, _) in enumerate(x):
                assert fir[s, t] == sum(c * (x[k - i][1] or 0) for i, c in enumerate((0.5, 0.25, 0.25)) if k >= i)
    v = d.na.fill(0.0)
    level = v.withColumn("v", (F.col("v") > 1).cast("int"))
    c = v.select(F.col("signal").alias("var_id"), "t", F.col("t").alias("seq"), F.col("v").cast("string").alias("raw"))
    for make in (lambda n: me.measure_normal(v, 0.0, 3.0, [0.5, 0.3, 0.2], rows=n), lambda n: me.siblings(level, 10**10, rows=n), lambda n: ch.clean_changes(c, True, rows=n), lambda n: ch.describe_changes(c, rows=n), lambda n: sa.hold(v, rows=n)):
        assert text(make(None)) == text(make(4))
    for df in (sa.asof(points, d, ["signal"], t="at", rows=4), me.fir(d, [0.5, 0.5], rows=4), me.measure_normal(v, coeffs=[0.5, 0.5], rows=4), ch.clean_changes(c, True, rows=4)):
        inside = [w for w in windows(df) if not re.match(r"(signal|var_id)#\w+, _block#\w+ ASC", w)]
        assert inside and all("_block#" in w or "seq#" in w for w in inside)


def test_tables_without_keys(spark, rows):
    one = spark.createDataFrame([(t, 0.0 if v is None else v) for s, t, v in rows if s == "a"], "t long, v double")
    x = by_key(rows)["a"]
    values = [v or 0.0 for _, v in x]
    got = se.series_transform(one.withColumn("w", F.col("v") + 2), ["v", "w"], "t", base=True, add=1.0, mul=2.0, diff=True, product="p", rows=5).orderBy("t").collect()
    y = [(v - values[0] + 1) * 2 for v in values]
    assert [r["v"] for r in got] == [0.0, *(b - a for a, b in zip(y, y[1:]))] and [r["p"] for r in got] == [r["v"] * r["w"] for r in got]
    total = [r["total"] for r in se.running_total(one, "v", ["t"], rows=5).orderBy("t").collect()]
    assert total == [sum(values[: k + 1]) for k in range(len(values))]
    chunks = {r["chunk"]: r["items"] for r in se.chunk(one, 4, "v", ["t"], fill=-1.0, rows=5).collect()}
    filled = values + [-1.0] * (-len(values) % 4)
    assert chunks == {k: filled[4 * k : 4 * k + 4] for k in range(len(filled) // 4)}
    lines = spark.createDataFrame([(t, f"x ({t % 7}m{t % 11}s)") for t, _ in x], "o long, value string")
    done = [r["finish"] for r in tj.annotated_durations(lines, r"(.*) \((.*)\)", "o", rows=5).orderBy("o").collect()]
    assert done == [sum(t % 7 * 60 + t % 11 for t, _ in x[: k + 1]) for k in range(len(x))]
    for df in (se.running_total(one, "v", ["t"]), se.chunk(one, 4, "v", ["t"]), tj.annotated_durations(lines, r"(.*) \((.*)\)", "o"), se.series_transform(one, ["v"], "t", base=True, diff=True)):
        assert all(re.match(r"_block#", w) for w in windows(df))
