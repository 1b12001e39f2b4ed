"""Metric cases with known values, and sparse moments against dense arithmetic."""

import numpy as np
import pytest

from sigrel.operators import metrics as mt
from sigrel.operators import relate
from sigrel.operators.samples import asof, hold, pairs, window_assign

CASES = {
    # x, y, ex, cex, ham, tmt, cls, cos, cov, dep
    "opposite": ([1, 0, 1, 0], [0, 1, 0, 1], 0.5, 0, 0, 0, 0, 0, 1, 0),
    "independent": ([0, 1, 0, 1], [0, 0, 1, 1], 0.5, 0.5, 0.5, 1 / 3, 1 - 0.5**0.5, 0.5, 0, 0),
    "same": ([0, 1, 0, 1], [0, 1, 0, 1], 0.5, 1, 1, 1, 1, 1, 1, 0.5),
    "skewed": ([1, 1, 0, 1], [0, 0, 1, 1], 0.75, 0.5, 0.25, 0.25, 1 - 0.75**0.5, 1 / 6**0.5, 0.5, 0),
    "all one": ([1, 1, 1, 1], [1, 1, 1, 1], 1, 1, 1, 1, 1, 1, 0, 0),
}


@pytest.mark.parametrize("case", CASES)
def test_known_values(spark, case):
    x, y, ex, *want = CASES[case]
    rows = [("x", t, float(v)) for t, v in enumerate(x) if v] + [("y", t, float(v)) for t, v in enumerate(y) if v]
    s = spark.createDataFrame(rows, "signal string, t long, v double")
    r = mt.with_metrics(relate.pair_moments(s, [0], 4)).where("x = 'x' and y = 'y'").first()
    assert r["ex"] == pytest.approx(ex)
    for name, value in zip(("cex", "ham", "tmt", "cls", "cos", "cov", "dep"), want):
        assert r[name] == pytest.approx(value, abs=1e-12), name


def test_sparse_equals_dense(spark):
    rng = np.random.default_rng(1)
    n, size, deltas = 64, 16, [-2, -1, 0, 1]
    v = {k: np.where(rng.random(n) < 0.5, 0, rng.random(n)) for k in "abc"}
    s = spark.createDataFrame([(k, t, float(x)) for k, a in v.items() for t, x in enumerate(a) if x], "signal string, t long, v double")
    got = {(r["x"], r["y"], r["delta"], r["u"]): r for r in mt.with_metrics(relate.pair_moments(s, deltas, size, alpha=2.0)).collect()}
    w = np.sin(np.arange(size) * np.pi / (size - 1)) ** 2
    checked = 0
    for (x, y, d, u), r in got.items():
        if u + d < 0 or u + size + d > n:
            continue
        a, b = v[x][u : u + size], v[y][u + d : u + d + size]
        e = lambda z: (w * z).sum() / w.sum()
        assert r["ham"] == pytest.approx(1 - e(abs(a - b)))
        assert r["cls"] == pytest.approx(1 - e((a - b) ** 2) ** 0.5)
        assert r["cov"] == pytest.approx(4 * abs(e(a * b) - e(a) * e(b)))
        assert r["tmt"] == pytest.approx(e(a * b) / (e(a) + e(b) - e(a * b)))
        assert r["tmt"] <= r["cos"] + 1e-12
        checked += 1
    assert checked > 60


def test_pair_join_has_no_cross_product(spark):
    s = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0)], "signal string, t long, v double")
    for df in (pairs(s, [0, 1]), relate.pair_moments(s, [0, 1], 4), relate.relation_edges(s, [0], 4, "dep", 0.1, "cov", 0.1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_asof_and_hold(spark):
    c = spark.createDataFrame([("s", t, float(t)) for t in (5, 6, 7, 10)], "signal string, t long, v double")
    p = spark.createDataFrame([("s", t) for t in (4, 8, 11)], "signal string, t long")
    got = lambda how: {r["t"]: r["change_t"] for r in asof(p, c, ["signal"], how).collect()}
    assert got("previous") == {4: None, 8: 7, 11: 10}
    assert got("next") == {4: 5, 8: 10, 11: None}
    assert sorted((r["t0"], r["t1"]) for r in hold(c, 12).collect()) == [(5, 6), (6, 7), (7, 10), (10, 12)]


@pytest.mark.parametrize("size, overlap", [(4, 0), (4, 2), (4, -3)])
def test_windows(spark, size, overlap):
    got = {(r["t"], r["u"]) for r in window_assign(spark.range(30).select("id").withColumnRenamed("id", "t"), size, overlap).collect()}
    assert got == {(t, u) for u in range(0, 40, size - overlap) for t in range(u, u + size) if t < 30}


def test_empty(spark):
    s = spark.createDataFrame([], "signal string, t long, v double")
    assert relate.relation_edges(s, [0], 4, "ham", 0.1).count() == 0
