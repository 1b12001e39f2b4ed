"""Operators with values that reach beyond the given tables: wide vectors, open intervals, last-wins streams, features."""

import pytest
from pyspark.sql import functions as F

from sigrel.functions import scalar as sc
from sigrel.operators import changes as ch
from sigrel.operators import evaluate as ev
from sigrel.operators import measures as me
from sigrel.operators import relate as re_
from sigrel.operators import resample as rs
from sigrel.operators import samples as sa
from sigrel.sources import change_files as cf
from sigrel.streaming import streams as st


def test_wide_cells_of_any_width(spark):
    big = (1 << 199) + 12345
    rows = [(0, hex(big), str((1 << 120) + 7), "hello x", "17", "t"), (1, bin(5), "9", "-", "0x1F", "both"), (2, "0x0", "18446744073709551616", "y", "0", "n")]
    df = spark.createDataFrame(rows, "t long, h string, d string, s string, i string, b string")
    types = {"h": ("reg", 200), "d": ("reg", 128), "s": ("string", 1), "i": ("integer", 1), "b": ("wire", 1)}
    got = {(r["t"], r["var_id"]): r["raw"] for r in ch.wide_to_changes(df, types, "t").collect()}
    assert got[0, "h"] == "b" + format(big, "b") and got[1, "h"] == "b101" and got[2, "h"] == "b0"
    assert got[0, "d"] == "b" + format((1 << 120) + 7, "b") and got[1, "d"] == "b1001" and got[2, "d"] == "b1" + "0" * 64
    assert got[0, "s"] == "shello x" and (1, "s") not in got and got[0, "i"] == "b10001" and got[1, "i"] == "b11111"
    assert [got[k, "b"] for k in range(3)] == ["1", "z", "0"]
    back = {r["t"]: r for r in ch.changes_to_wide(ch.wide_to_changes(df, types, "t"), types).collect()}
    assert back[0]["h"] == hex(big) and back[1]["s"] == "hello x"
    with pytest.raises(Exception, match="no word for a state"):
        ch.wide_to_changes(spark.createDataFrame([(0, "on")], "t long, b string"), {"b": ("wire", 1)}, "t").collect()
    with pytest.raises(Exception, match="38 digits"):
        ch.wide_to_changes(spark.createDataFrame([(0, "9" * 50)], "t long, d string"), {"d": ("reg", 200)}, "t").collect()


def test_open_intervals_overlap(spark):
    x = spark.createDataFrame([("a", 0, None, 1.0), ("b", 5, 9, 1.0), ("c", 40, 50, 1.0)], "signal string, t0 long, t1 long, v double")
    y = spark.createDataFrame([("p", 7, None, 1.0), ("q", 45, 46, 1.0), ("r", 9, 9, 1.0)], "signal string, t0 long, t1 long, v double")
    for size in (1, 8, 100):
        got = {(r["x"], r["y"], r["t0"], r["t1"]) for r in sa.interval_overlap(x, y, size).collect()}
        assert got == {("a", "p", 7, None), ("b", "p", 7, 9), ("c", "p", 40, 50), ("a", "q", 45, 46), ("c", "q", 45, 46)}
    assert sa.interval_overlap(x.where("t0 < 0"), y, 8).count() == 0


def test_event_level_and_names(spark):
    c = spark.createDataFrame([("a", 1, 1), ("a", 4, 0), ("a", 9, 1)], "signal string, t long, v int")
    assert [(r["t0"], r["t1"]) for r in me.measure_event(c, level=True, end=12).orderBy("t0").collect()] == [(1, 4), (9, 12)]
    n = spark.createDataFrame([("normal.raw.a.b",), ("normal.orig.a",), ("event.rise.a",), ("bstate.fall.a.b",), ("odd.orig.a",), ("short",)], "name string")
    assert sorted(r[0] for r in me.unit_interval_names(n).collect()) == ["bstate.fall.a.b", "normal.orig.a"]
    m = spark.createDataFrame([("m", "h", "event", None, None, ["name", "hook", "colour"]), ("n", "h", "event", None, None, ["geq"])], "name string, hook string, mtype string, geq double, leq double, keys array<string>")
    assert [(r["name"], r["rule"]) for r in me.check_measures(m).collect()] == [("m", "unknown key")]


def test_features_of_pairs(spark):
    s = spark.createDataFrame([("a", t, 1.0) for t in (0, 2)] + [("b", t, 1.0) for t in (2, 3)] + [("c", 1, 1.0)], "signal string, t long, v double")
    f = {(r["x"], r["y"]): r for r in ev.with_features(re_.pair_moments(s, [0], 4)).collect()}
    ab = f["a", "b"]
    assert (ab["ediff"], ab["cex_xy"], ab["cex_yx"], ab["exy"]) == (0.5, 0.5, 0.5, 0.25) and f["a", "c"]["exy"] == 0 and f["a", "c"]["cex_xy"] == 0
    assert all(set(names) <= set(ab.asDict()) for names in ev.FEATURE_SETS.values())


def test_small_columns(spark):
    df = spark.createDataFrame([("module:a.b[3:0].c", 0), ("x:y:z.w", 94), ("plain", 94**3 + 5)], "p string, r long")
    got = df.select(sc.detype("p").alias("d"), cf.variable_id("r").alias("i")).collect()
    assert [r["d"] for r in got] == ["a.b", "z.w", "plain"]

    def ref(x):
        out = ""
        while x or not out:
            x, a = divmod(x, 94)
            out = chr(33 + a) + out
        return out

    assert [r["i"] for r in got] == [ref(0), ref(94), ref(94**3 + 5)]
    ids = spark.range(0, 900_000, 7919).select("id", cf.variable_id("id").alias("v")).collect()
    assert all(r["v"] == ref(r["id"]) for r in ids)


def test_subsample_keeps_every_block(spark):
    d = spark.createDataFrame([("a", t, float(t)) for t in range(21)], "signal string, t long, v double")
    for how in ("xor", "uniform"):
        got = rs.subsample(d, 8, how, 3, padding="reflect").orderBy("t").collect()
        assert [r["t"] for r in got] == [0, 1, 2] and all(r["v"] // 8 == r["t"] or r["t"] == 2 for r in got)


def test_streams_last_and_counters(spark, tmp_path):
    rows = [("a", 10, 1, "x"), ("a", 10, 2, "y"), ("b", 10, 3, "z"), ("a", 4000, 4, "w"), ("b", 99999, 5, "end")]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "signal string, s long, seq long, raw string").select("signal", F.timestamp_seconds("s").alias("ts"), "seq", "raw").write.parquet(src)
    schema = spark.read.parquet(src).schema

    def run(name, df):
        q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(str(tmp_path / name)).collect()

    read = lambda: spark.readStream.schema(schema).parquet(src)
    got = {(r["signal"], int(r["ts"].timestamp())): r["raw"] for r in run("last", st.stream_last(read()))}
    assert {k: v for k, v in got.items() if k[1] < 99999} == {("a", 10): "y", ("b", 10): "z", ("a", 4000): "w"}
    x, y = (read().where(F.col("signal") == k).select("ts") for k in "ab")
    counts = {int(r["window"]["start"].timestamp()): (r["count_x"], r["count_y"], r["count_isect"], r["count_symdiff"]) for r in run("counters", st.stream_counters(x, y, "1 hour"))}
    assert counts == {0: (1, 1, 1, 0), 3600: (1, 0, 0, 1)}


def test_two_steps_equal_one_window(spark):
    import random

    from pyspark.sql import Window

    from sigrel.operators import ordered as od

    rng = random.Random(4)
    rows = [(s, t, rng.choice([0, 1, None])) for s in "ab" for t in sorted(rng.sample(range(500), 60))]
    d = spark.createDataFrame(rows, "signal string, t long, v int")
    w = Window.partitionBy("signal").orderBy("t")
    for ahead in (False, True):
        got = od.neighbour(d, "v", "n", block=7, ahead=ahead).collect()
        want = d.withColumn("n", (F.lead if ahead else F.lag)("v").over(w)).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
    one = d.where("signal = 'a'").drop("signal")
    full = {r["t"]: r["v"] for r in od.carried(one, ["v"], rows=7).collect()}
    last = None
    for _, t, v in [r for r in rows if r[0] == "a"]:
        last = v if v is not None else last
        assert full[t] == last
    assert [r["number"] for r in od.numbered(one, "t", rows=9).orderBy("t").collect()] == list(range(60))
    assert od.numbered(one.where("t < 0"), "t").count() == 0
    x = spark.createDataFrame([("p", 3), ("q", 3), ("r", 9), ("s", 1)], "k string, n long")
    assert {r["k"]: r["rank"] for r in od.ranked(x, "n").collect()} == {"r": 1, "p": 2, "q": 2, "s": 4}
    held = sa.hold(d.where("v is not null"), 600).collect()
    assert sorted(map(str, held)) == sorted(map(str, sa.hold(d.where("v is not null"), 600, block=16).collect()))


def test_pattern_tables_in_lots(spark, monkeypatch):
    from sigrel.operators import text_jobs as tj

    lines = spark.createDataFrame([(i, f"w{i} x") for i in range(20)], "line int, value string")
    p = spark.createDataFrame([(f"^w{i} ",) for i in range(0, 20, 3)], "pattern string")
    for limit in (2, 100):
        monkeypatch.setattr(tj, "PATTERNS", limit)
        assert sorted(r["line"] for r in tj.filter_lines(lines, p).collect()) == [i for i in range(20) if i % 3]
        assert sorted(r["line"] for r in tj.filter_lines(lines, p, invert=True).collect()) == [i for i in range(20) if i % 3 == 0]
