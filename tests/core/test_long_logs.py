"""Values beyond 53, 63 and 64 bits, places in very long files, and measures read from the segments of a range."""

import random
import shutil
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigrel.operators import changes as ch
from sigrel.operators import measures as me
from sigrel.sources import change_files as cf
from sigrel.sources import traces as tr


def test_numbers_of_any_width(spark):
    rng = random.Random(3)
    numbers = [0, 1, (1 << 63) - 1, 1 << 63, 1 << 64, (1 << 200) - 1, *(rng.getrandbits(k) for k in (40, 64, 65, 96, 97, 200))]
    got = [r["d"] for r in spark.createDataFrame([(i, f"b{n:b}") for i, n in enumerate(numbers)] + [(99, "bx1z"), (100, "r-2.5"), (101, "b000" + "1" * 70)], "i int, raw string").select("i", me.decode_number(F.col("raw")).alias("d")).orderBy("i").collect()]
    assert got == [pytest.approx(float(n), rel=1e-15) for n in numbers] + [3.0, -2.5, float((1 << 70) - 1)]
    c = spark.createDataFrame([("s", 0, f"b{1 << 100:b}"), ("s", 5, "b1")], "signal string, t long, raw string").withColumn("v", me.decode_number(F.col("raw")))
    assert {(r["sibling"], r["t0"], r["t1"]) for r in me.measure_threshold(c, 2.0**99, None, 9).collect()} == {("orig", 0, 5), ("refl", 5, 9), ("rise", 0, 1), ("fall", 5, 6)}


def test_addresses_of_64_bits(spark):
    lines = spark.createDataFrame([("10 1 0xffffffff81000000",), ("20 0 0xFFFFFFFF81000000",), ("20 1 0xffffffffffffffff",), ("30 1 0x10",)], "value string")
    symbols = spark.createDataFrame([("0xffffffff81000000", "func", "start_kernel"), ("0x10", "func", "low")], "address string, type string, name string")
    got = {(r["t"], r["signal"], r["raw"]) for r in tr.trace_to_changes(lines, symbols, 1, {"k": (1 << 63, 1 << 64)}).collect()}
    assert got == {(10, "k.start_kernel", "1"), (20, "k.start_kernel", "0"), (20, "unknown.0xffffffffffffffff", "1"), (30, "low", "1"), (10, "unknown.0xffffffffffffffff", "0"), (10, "low", "0")}


def test_negative_integers(spark):
    df = spark.createDataFrame([(0, "-5", "-1", "7"), (1, "5", "-128", "-8")], "t long, a string, b string, c string")
    got = {(r["t"], r["var_id"]): r["raw"] for r in ch.wide_to_changes(df, {"a": ("integer", 32), "b": ("reg", 8), "c": ("reg", 80)}, "t").collect()}
    assert got == {(0, "a"): "b" + f"{(1 << 32) - 5:b}", (1, "a"): "b101", (0, "b"): "b11111111", (1, "b"): "b10000000", (0, "c"): "b111", (1, "c"): "b" + f"{(1 << 80) - 8:b}"}


def test_places_in_very_long_files(spark):
    rows = [(block, line, f"{i}") for i, (block, line) in enumerate([(0, 5), (0, (1 << 33) + 7), (1 << 43, 1), (1 << 62, 2)])]
    at = spark.createDataFrame(rows, "block long, line long, raw string").select(F.lit(0).cast("long").alias("t"), F.lit("x").alias("var_id"), F.struct("block", "line").alias("seq"), "raw")
    assert [r["raw"] for r in ch.clean_changes(at).collect()] == ["3"]
    d = ch.describe_changes(at, rows=1).first()
    assert (d["changes"], d["toggles"]) == (4, 4)


def test_logs_there_and_back_in_order(spark, tmp_path):
    v = spark.createDataFrame([("a", "top.a", 1, "wire", ""), ("b", "top.b", 4, "reg", "")], "var_id string, name string, width int, kind string, bit_sel string")
    c = spark.createDataFrame([(5, 1, "a", "1"), (5, 2, "b", "b11"), (5, 3, "a", "0"), (9, 4, "b", "bx")], "t long, seq long, var_id string, raw string")
    cf.write_changes(v, c, str(tmp_path / "one"))
    for k in range(2):  # what is read is written again, with places as seq
        _, variables, changes = cf.read_changes(spark, str(tmp_path / ("one", "two")[k]), parts=True)
        names = {r["var_id"]: r["name"] for r in variables.collect()}
        assert [(r["t"], names[r["var_id"]], r["raw"]) for r in changes.orderBy("seq").collect()] == [(5, "top.a", "1"), (5, "top.b", "b0011"), (5, "top.a", "0"), (9, "top.b", "bxxxx")]
        if not k:
            cf.write_changes(variables, changes, str(tmp_path / "two"))


def test_ranges_read_their_segments_only(spark, tmp_path):
    rng = random.Random(5)
    rows = [(kind, s, t, float(rng.randrange(3))) for kind in ("normal", "bstate") for s in "abc" for t in sorted(rng.sample(range(300), {"a": 40, "b": 3, "c": 12}[s]))]
    path = str(tmp_path / "store")
    cf.store_measures(spark.createDataFrame(rows, "mtype string, signal string, t long, v double"), path, every=32)

    def value(kind, s, at):
        return next((v for k, x, t, v in reversed(rows) if (k, x) == (kind, s) and t <= at), 0.0)

    def want(start, finish):
        out = {(k, s, start, v) for k in ("normal", "bstate") for s in "abc" if (v := value(k, s, start))}
        return out | {(k, s, t, v) for k, s, t, v in rows if start < t < finish and value(k, s, t - 1) != v}

    for start, finish in ((0, 300), (64, 70), (95, 96), (96, 97), (130, 200), (290, 400), (500, 600)):
        got = {(r["mtype"], r["signal"], r["t"], r["v"]) for r in cf.load_measures(spark, path, None, start, finish).collect()}
        assert got == want(start, finish)
    everything = {(r["signal"], r["t"]) for r in cf.load_measures(spark, path, ["a"]).collect()}
    assert everything == {(s, t) for k, s, t, v in rows if s == "a" and value(k, s, t - 1) != v}
    for folder in (tmp_path / "store").glob("mtype=*/every=*/segment=*"):  # history before and after isn't needed
        if int(folder.name.split("=")[1]) not in (4, 5, 6):
            shutil.rmtree(folder)
    assert {(r["mtype"], r["signal"], r["t"], r["v"]) for r in cf.load_measures(spark, path, None, 130, 200).collect()} == want(130, 200)
    cf.store_measures(spark.createDataFrame([], "mtype string, signal string, t long, v double"), str(tmp_path / "none"))


def test_a_header_is_read_batch_by_batch_in_time_that_follows_its_length():
    n = 100_000
    lines = ["$comment", "two", "lines $end", "$scope module top $end", *(f"$var reg 16 i{k} u{k} $end" for k in range(n)), "$upscope $end", "$enddefinitions $end"]
    pdf = pd.DataFrame({"src": "a", "block": 0, "line": range(len(lines)), "value": lines})
    other = pd.DataFrame({"src": "b", "block": 0, "line": [0, 1], "value": ["$var wire 1 x y [3] $end", "$enddefinitions $end"]})
    batches = [pdf[:2], pdf[2:3], pdf[3 : n // 2], pd.concat([pdf[n // 2 :], other])]
    began = time.process_time()
    got = list(cf._header_rows(iter(batches)))
    assert time.process_time() - began < 10
    rows = pd.concat(got)
    assert len(got) == 5 and max(map(len, got)) < 0.6 * n and len(rows) == n + 2
    assert list(rows[rows.what == "comment"].text) == ["two lines"]
    assert list(rows[rows.src == "a"].name[1:]) == [f"top.u{k}" for k in range(n)]
    assert rows.iloc[-1].tolist()[:7] == ["b", "var", "x", "y", 1, "wire", "[3]"]
    for bad, what in ((["$var wire 1 x y $end"], "doesn't end"), (["$odd", "$enddefinitions"], "not known"), (["$var odd 1 x y $end"], "no variable")):
        with pytest.raises(ValueError, match=what):
            list(cf._header_rows(iter([pd.DataFrame({"src": "a", "block": 0, "line": range(len(bad)), "value": bad})])))


def header_lines(named, texts):
    """The header one variable after the other; named: (name, kind, width, id, bits) in order of names."""
    out, scope = [f"${word} {text} $end" for word, text in texts], []
    for name, kind, width, new_id, bits in named:
        *parts, leaf = name.split(".")
        same = 0
        while same < min(len(parts), len(scope)) and parts[same] == scope[same]:
            same += 1
        out += ["$upscope $end"] * (len(scope) - same)
        for p in parts[same:]:
            of, _, own = p.rpartition(":")
            out.append(f"$scope {of or 'module'} {own} $end")
        scope = parts
        out.append(" ".join(x for x in ("$var", kind, str(width), new_id, leaf, bits, "$end") if x))
    return out + ["$upscope $end"] * len(scope) + ["$enddefinitions $end"]


def test_a_written_header_is_not_collected(spark, tmp_path):
    rng = random.Random(8)
    names = sorted({".".join([*(rng.choice(("top", "b", "begin:x", ":y", "a:b:c", "é")) for _ in range(rng.randrange(4))), f"n{k % 9}"]) for k in range(60)})
    rows = [(f"v{k}", x, 1 + k % 3, rng.choice(("reg", "wire")), rng.choice((None, "", "[2:0]"))) for k, x in enumerate(names)]
    for some in (rows, rows[:1], []):
        variables = spark.createDataFrame(some, "var_id string, name string, width int, kind string, bit_sel string")
        changes = spark.createDataFrame([(t, t, r[0], "b1") for t, r in enumerate(some)], "t long, seq long, var_id string, raw string")
        where = str(tmp_path / f"log{len(some)}")
        cf.write_changes(variables, changes, where, timescale="1 ns", comment="hello", date="now")
        got = "\n".join(p.read_text() for p in sorted((tmp_path / f"log{len(some)}").glob("part-*"))).split("\n")
        got = [x for x in got if x]
        ids = [r["i"] for r in spark.range(len(some)).orderBy("id").select(cf.variable_id("id").alias("i")).collect()]
        want = header_lines([(name, kind, width, i, bits) for (_, name, width, kind, bits), i in zip(some, ids)], [("comment", "hello"), ("date", "now"), ("timescale", "1 ns")])
        assert got[: len(want)] == want and len(got) == len(want) + 2 * len(some)
