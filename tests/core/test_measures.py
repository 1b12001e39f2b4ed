"""Measures, scalar functions, resampling and change logs on small tables with known results."""

import pytest
from pyspark.sql import functions as F

from sigrel.functions import quantised as q
from sigrel.functions import scalar as sc
from sigrel.operators import changes as ch
from sigrel.operators import evaluate as ev
from sigrel.operators import measures as me
from sigrel.operators import params as pa
from sigrel.operators import resample as rs
from sigrel.operators import text_jobs as tj

BASIC = [(0, 0.0), (2, 1.0), (3, 2.0), (5, 5.0), (10, 15.0), (11, 8.0), (20, 1.0)]


def values(spark, rows):
    return spark.createDataFrame([("s", t, v) for t, v in rows], "signal string, t long, v double")


def test_threshold_siblings(spark):
    got = {(r["sibling"], r["t0"], r["t1"]) for r in me.measure_threshold(values(spark, BASIC), 2.0, 7.0, 25).collect()}
    assert ("rise", 3, 4) in got and ("fall", 10, 11) in got
    assert {x for x in got if x[0] == "orig"} == {("orig", 3, 5), ("orig", 5, 10)}
    assert sum(b - a for k, a, b in got if k == "refl") == 25 - 7


def test_normal_with_fir(spark):
    rows = [(0, 0.0), (2, 1.0), (3, 2.0), (5, 5.0), (10, 15.0), (11, 8.0), (20, 0.0)]
    got = {}
    for r in me.measure_normal(values(spark, rows), 0.0, 9.0, [0.25] * 4, 24).collect():
        for t in range(r["t0"], r["t1"]):
            got[t] = (r["smooth"], r["v"])
    want = {2: 0.25, 3: 0.75, 4: 1.25, 5: 2.5, 6: 3.5, 7: 4.25, 8: 5, 9: 5, 10: 7.5, 11: 8.25, 12: 9, 13: 9.75, 14: 8}
    for t, x in want.items():
        assert got[t][0] == pytest.approx(x), t
        assert got[t][1] == pytest.approx(min(1, x / 9))


def test_decode_state(spark):
    df = spark.createDataFrame([("b10x", 0), ("bz01", 2), ("0", 0), ("b" + "1" + "0" * 199, 199), ("b1", 5)], "raw string, bit int")
    assert [r[0] for r in df.select(me.decode_state(F.col("raw"))).collect()] == [1, 1, 0, 1, 1]
    assert [r[0] for r in df.select(me.decode_state(F.col("raw"), F.col("bit"))).collect()] == [0, 1, 0, 1, 0]


def test_check_and_bind(spark):
    m = spark.createDataFrame([("a", "top.x[3]", "bstate", None, None), ("b", "", "threshold", None, None), ("c", "top.y", "normal", 2.0, 1.0), ("d", "q", "odd", None, None)], "name string, hook string, mtype string, geq double, leq double")
    assert {(r["name"], r["rule"]) for r in me.check_measures(m).collect()} == {("b", "no hook"), ("b", "threshold without bound"), ("c", "empty range"), ("d", "unknown type")}
    v = spark.createDataFrame([("!", "top.x[7:0]", 8, "reg"), ('"', "top.y", 2, "reg")], "var_id string, name string, width int, kind string")
    got = {r["name"]: (r["var_id"], r["bit"], r["problem"]) for r in me.bind_measures(m, v).collect()}
    assert got["a"] == ("!", 3, None) and got["d"][2] == "no such variable"


@pytest.mark.parametrize("args, want", [((50, 10, 10, 2), {(1, -2), (1, -1), (1, 0), (1, 1), (2, -6), (2, -4), (2, 2), (2, 4), (4, -10), (4, 6)}), ((5, 50, 50, 0), {(1, -2), (1, -1), (1, 0), (1, 1)}), ((50, 0, 1, 0), {(1, 0)})])
def test_shift_ladder(spark, args, want):
    assert {(r["factor"], r["delta"]) for r in rs.shift_set(spark, *args).collect()} == want


def test_confusion_case(spark):
    r = ev.with_scores(spark.createDataFrame([(0.1, 0.2, 0.3, 0.4)], "tp double, fp double, fn double, tn double")).first()
    want = dict(tpr=1 / 4, tnr=2 / 3, ppv=1 / 3, npv=4 / 7, acc=1 / 2, bacc=11 / 24, mcc=-0.08908708, bmi=-1 / 12)
    for k, v in want.items():
        assert r[k] == pytest.approx(v, abs=1e-8)


@pytest.mark.parametrize("n", [2, 3, 8, 16, 31])
def test_quantised(spark, n):
    one = (1 << n) - 1
    h, qq = one >> 1, one >> 2
    t = qq + h
    df = spark.createDataFrame([(0, qq), (1, h), (2, qq), (3, h), (4, t)], "i long, x long")
    assert rs.non_negative_derivative(df.withColumn("signal", F.lit("s")), "x", order="i").orderBy("i").select("deriv").toPandas()["deriv"].tolist()[0] == 0
    r = spark.range(1).select(q.ratio(F.lit(3), F.lit(4), n).alias("a"), q.ratio(F.lit(3), F.lit(4), n).alias("b"), q.ratio(F.lit(5), F.lit(5), n).alias("c"), q.power(F.lit(one), 5, n).alias("p")).first()
    assert r["a"] == r["b"] == (3 << n) // 4 - 1
    assert r["c"] == one and r["p"] == one
    pair = spark.createDataFrame([(0, 0), (one, one)], "x long, y long")
    d = pair.agg(q.dependence(F.lit(one), "x", "y", n).alias("d"), q.mean("x", n).alias("m")).first()
    assert d["d"] == h and d["m"] == h


def test_strings_and_durations(spark):
    df = spark.createDataFrame([("foo -. Bar baz 123",), ("FooBar",), ("foo Bar    baz",)], "s string")
    assert [r[0] for r in df.select(sc.lower_camel_case("s")).collect()] == ["foo_BarBaz123", "fooBar", "fooBarBaz"]
    r = spark.range(1).select(sc.duration_text(F.lit(788645)).alias("a"), sc.duration_text(F.lit(245.678)).alias("b"), sc.to_seconds(F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.lit(5)).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == ("1w2d3h4m5.000s", "4m5.678s", 788645)
    c = spark.range(1).select(sc.rgb1d(F.lit(0.0)), sc.rgb1d(F.lit(0.5)), sc.rgb1d(F.lit(1.0)), sc.rgb2d(F.lit(0.5), F.lit(0.5))).first()
    assert list(c) == ["ffffff", "7f7f7f", "000000", "7f7f7f"]


def test_clean_last_wins(spark):
    c = spark.createDataFrame([(6, 0, "!", "1"), (8, 1, "!", "0"), (8, 2, "!", "1"), (1, 3, "!", "0")], "t long, seq long, var_id string, raw string")
    assert [(r["t"], r["raw"]) for r in ch.clean_changes(c).orderBy("t").collect()] == [(1, "0"), (6, "1"), (8, "1")]
    assert [(r["t"], r["raw"]) for r in ch.clean_changes(c, drop_redundant=True).orderBy("t").collect()] == [(1, "0"), (6, "1")]


def test_templates(spark):
    t = spark.createDataFrame([("event", 0, "FOO{}-{}-{}", "p.{2}{0}", [["blue", "red"], ["123", "456"], ["0..3"]])], "mtype string, seq int, name string, hook string, subs array<array<string>>")
    got = [(r["idx"], r["name"], r["hook"]) for r in pa.expand_templates(t, 3).orderBy("idx").collect()]
    assert len(got) == 12 and got[0] == (0, "FOOblue-123-0", "p.0blue") and got[11] == (11, "FOOred-456-2", "p.2red")


def test_tabs(spark):
    df = spark.createDataFrame([("a\tb",), ("12345678\tx",), ("  # no",)], "value string")
    assert [r[0] for r in tj.normalise_lines(df, spaces=False).collect()] == ["a       b", "12345678        x"]
