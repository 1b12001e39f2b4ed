"""Sibling expectations beside relation tables, against dense series in numpy."""

import numpy as np

from sigrel.operators import measures as me
from sigrel.operators import relate as re_
from sigrel.operators.samples import weight_sum


def dense(changes: dict[str, list[tuple[int, int]]], end: int) -> dict[tuple[str, str], np.ndarray]:
    out = {}
    for name, rows in changes.items():
        v = np.zeros(end)
        for t, x in rows:
            v[t:] = x
        was = np.r_[0, v[:-1]]
        out |= {(name, "orig"): v, (name, "refl"): 1 - v, (name, "rise"): (v > was) * 1.0, (name, "fall"): (v < was) * 1.0}
    return out


def test_expectations_equal_dense_series(spark):
    rng = np.random.default_rng(4)
    end = 90
    changes = {n: sorted({int(t): int(rng.integers(2)) for t in rng.integers(0, end, 12)}.items()) for n in "abc"} | {"still": [(0, 1)], "late": [(80, 1), (85, 0)]}
    levels = spark.createDataFrame([(n, t, v) for n, rows in changes.items() for t, v in rows], "base string, t long, v int")
    sib = me.siblings(levels, end, ("base",))
    series = dense(changes, end)
    for size, overlap, alpha in ((16, 0, 0), (16, 4, 2), (32, 16, 1)):
        stride, total = size - overlap, weight_sum(size, alpha)
        table = spark.createDataFrame([(x, y, u) for x in changes for y in changes for u in range(0, end, stride)], "x string, y string, u long")
        got = re_.with_siblings(table.selectExpr("concat('threshold.rise.', x) as x", "y", "u"), sib, size, end, overlap, alpha, ("x",), lambda c: me.split_measure_name(c)["base"]).collect()
        w = np.array([1.0 if not alpha else max(0.0, np.sin(i * np.pi / (size - 1))) ** alpha for i in range(size)])
        assert len(got) == table.count()
        for r in got:
            for k in re_.SIBLINGS:
                part = series[r["x"].split(".")[2], k][r["u"] : r["u"] + size]
                assert abs(r[f"ex_{k}"] - (w[: len(part)] * part).sum() / total) < 1e-9, (r, k)


def test_both_sides_and_names_that_clash(spark):
    levels = me.siblings(spark.createDataFrame([("a", 2, 1), ("a", 5, 0), ("b", 0, 1)], "base string, t long, v int"), 8, ("base",))
    table = spark.createDataFrame([("a", "b", 0, "kept", 1.5), ("a", "b", 0, "kept", 1.5), ("none", None, 0, None, None)], "x string, y string, u long, base string, e_orig double")
    got = re_.with_siblings(table, levels, 8, 8).orderBy("x").collect()
    assert [r["x"] for r in got] == ["a", "a", "none"]
    assert [got[0][f"e{s}_{k}"] for s in "xy" for k in re_.SIBLINGS] == [3 / 8, 5 / 8, 1 / 8, 1 / 8, 1.0, 0.0, 1 / 8, 0.0]
    assert [got[2][f"e{s}_{k}"] for s in "xy" for k in re_.SIBLINGS] == [0.0, 1.0, 0.0, 0.0] * 2
    assert got[0]["base"] == "kept" and got[0]["e_orig"] == 1.5
