"""Files: change logs there and back, binary records, packets, traces, runs, the measure store, and streams."""

import struct

import pytest
from pyspark.sql import functions as F

from sigrel.operators import series as se
from sigrel.operators import text_jobs as tj
from sigrel.sources import binary_files as bf
from sigrel.sources import change_files as cf
from sigrel.sources import traces as tr
from sigrel.streaming import streams as st

LOG = """$date today $end
$version one $end
$timescale 1 ns $end
$scope module TOP $end
$var wire 1 C clk $end
$var event 1 E look $end
$var real 64 V aReal $end
$scope module blk $end
$var wire 1 C i_clk $end
$var reg 8 Q counter $end
$upscope $end
$upscope $end
$enddefinitions $end
#0
0C
b0 Q
#2
1C
b1x Q
1E
r123.456 V
nonsense
#1
0C
"""


def test_change_files(spark, tmp_path):
    (tmp_path / "a.vcd").write_text(LOG)
    files, variables, changes = cf.read_changes(spark, str(tmp_path / "a.vcd"))
    assert files.first()["timescale"] == "1 ns"
    assert {(r["var_id"], r["name"], r["width"], r["kind"]) for r in variables.collect()} == {("C", "TOP.clk", 1, "wire"), ("C", "TOP.blk.i_clk", 1, "wire"), ("E", "TOP.look", 1, "event"), ("V", "TOP.aReal", 64, "real"), ("Q", "TOP.blk.counter", 8, "reg")}
    got = [(r["t"], r["var_id"], r["raw"]) for r in changes.orderBy("seq").collect()]
    assert got == [(0, "C", "0"), (0, "Q", "b0"), (2, "C", "1"), (2, "Q", "b1x"), (2, "E", "1"), (2, "V", "r123.456"), (1, "C", "0")]
    cf.write_changes(variables, changes, str(tmp_path / "out"), comment="hello")
    _, v2, c2 = cf.read_changes(spark, str(tmp_path / "out"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert "b00000000 " in text and "b0000001x " in text and "r123.456000 " in text and text.count("#") >= 3
    assert v2.count() == variables.count()


def test_unknown_commands_fail(spark, tmp_path):
    (tmp_path / "b.vcd").write_text("$odd x $end\n$enddefinitions $end\n#0\n")
    with pytest.raises(Exception, match="not known"):
        cf.read_changes(spark, str(tmp_path / "b.vcd"))[1].collect()


def test_carried_time_over_blocks(spark, tmp_path):
    lines, want, t = [], [], 0
    for i in range(400):
        if i % 7 == 0:
            t = (i * 37) % 101
            lines.append(f"#{t}")
        lines.append(f"{i % 2}v{i}")
        want.append((f"v{i}", t))
    (tmp_path / "c.vcd").write_text("$enddefinitions $end\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        _, _, changes = cf.read_changes(spark, str(tmp_path / "c.vcd"))
        assert {(r["var_id"], r["t"]) for r in changes.collect()} == set(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_records_and_packets(spark, tmp_path):
    (tmp_path / "u16").write_bytes(struct.pack("<4H", 1, 513, 65535, 7))
    got = bf.decode_records(spark, str(tmp_path / "u16"), "u16").orderBy("index").collect()
    assert [r["value"] for r in got] == [1, 513, 65535, 7] and got[1]["hex"] == "0201" and got[0]["bits"] == "0" * 15 + "1"
    assert [r["value"] for r in bf.decode_records(spark, str(tmp_path / "u16"), "u16", False).orderBy("index").collect()] == [256, 258, 65535, 1792]
    (tmp_path / "p").write_bytes(bytes([0, 10, 20, 5, 20, 1, 0, 0, 0, 0]))
    p = bf.decode_counter_packets(spark, str(tmp_path / "p"), 100, 0.01).orderBy("index").collect()
    assert (p[0]["count_x"], p[0]["exy"], p[1]["win_num"], p[1]["seconds"]) == (10, 0.05, 1, 1.0)


def test_trace(spark):
    lines = spark.createDataFrame([("135 1 0x60000010",), ("262 0 0x60000010",), ("400 1 0x70000020",), ("410 1 0x50000000",)], "value string")
    symbols = spark.createDataFrame([("0x60000010", "f", "run"), ("0x70000020", "f", "st op")], "address string, type string, name string")
    got = {(r["t"], r["signal"], r["raw"]) for r in tr.trace_to_changes(lines, symbols, 130, {"acpu": (0x60000000, 0x70000000), "scpu": (0x70000000, 0x80000000)}).collect()}
    assert got == {(130, "acpu.run", "1"), (260, "acpu.run", "0"), (390, "scpu.st_op", "1"), (390, "unknown.0x50000000", "1"), (130, "scpu.st_op", "0"), (130, "unknown.0x50000000", "0")}


def test_runs_and_store(spark, tmp_path):
    for n in ("run-a_x", "run-b_y"):
        (tmp_path / f"{n}.csv").write_text("Wall time,Step,Value\n1.0,0,0.5\n2.0,1,0.25\n")
    runs = tr.union_runs(spark, str(tmp_path / "run-*.csv"), r"run-(\w)_(\w)", ["inputs", "net"], "wall double, step int, value double")
    assert {(r["inputs"], r["net"]) for r in runs.collect()} == {("a", "x"), ("b", "y")} and runs.count() == 4
    m = spark.createDataFrame([("bstate", "s", t, v) for t, v in ((0, 0.0), (2, 1.0), (3, 1.0), (9, 0.0))], "mtype string, signal string, t long, v double")
    cf.store_measures(m, str(tmp_path / "store"))
    got = cf.load_measures(spark, str(tmp_path / "store"), ["s"], 5, 20)
    assert {(r["t"], r["v"]) for r in got.collect()} == {(5, 1.0), (9, 0.0)}


def test_lines_there_and_back(spark, tmp_path):
    (tmp_path / "in.txt").write_text("# no\n  Two   Words\t.\nlast  \n")
    lines = tj.read_lines(spark, str(tmp_path / "in.txt"), fold=True)
    assert [r["value"] for r in lines.orderBy("line").collect()] == ["two words .", "last"]
    tj.write_lines(tj.read_lines(spark, str(tmp_path / "in.txt"), comments=True), str(tmp_path / "out"), comments=True, fold=True)
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["# no", "two words .", "last"]


def test_dedupe_and_chunk(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "seq int, k string")
    got = lambda keep: sorted((r["place"], r["seq"], r["k"]) for r in se.dedupe(df, ["k"], "seq", keep).collect())
    assert got("first") == [(0, 0, "a"), (1, 1, "b")] and got("last") == [(0, 2, "a"), (1, 1, "b")] and got("moved") == [(1, 1, "b"), (2, 2, "a")]


def _run(spark, df, tmp_path, rows, schema, build):
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(str(tmp_path / "in"))
    out = build(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(str(tmp_path / "o")).collect()


def test_stream_measures(spark, tmp_path):
    rows = [("s", 2, 1), ("s", 5, 0), ("s", 3, 1), ("r", 0, 1)]
    got = {tuple(r) for r in _run(spark, None, tmp_path, rows, "signal string, t long, v int", st.stream_measures)}
    assert got == {("s", "rise", 2, 3), ("s", "refl", 0, 2), ("s", "fall", 5, 6), ("s", "orig", 2, 5), ("r", "rise", 0, 1)}


def test_stream_clean(spark, tmp_path):
    import datetime as dt

    t = [dt.datetime(2024, 1, 1, 0, m) for m in range(5)]
    rows = [("s", t[0], "1"), ("s", t[0], "1"), ("s", t[1], "0")]
    got = _run(spark, None, tmp_path, rows, "signal string, ts timestamp, raw string", st.stream_clean)
    assert len(got) == 2


def test_byte_histogram(spark):
    got = {r["byte"]: r["n"] for r in bf.byte_histogram(spark.createDataFrame([("aab",), (None,), ("é",)], "text string"), "text").collect()}
    assert got == {97: 2, 98: 1, 0xC3: 1, 0xA9: 1}
