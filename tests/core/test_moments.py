"""Moments from intervals and over ladders of shifts against dense arrays."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigrel.operators import metrics as mt
from sigrel.operators import relate as re_
from sigrel.operators import resample as rs
from sigrel.operators import samples as sa

MEANS = ("ex", "ey", "exy", "exx", "eyy", "emin")


def weights(n, alpha):
    return np.ones(n) if alpha == 0 or n == 1 else np.maximum(0, np.sin(np.arange(n) * np.pi / (n - 1))) ** alpha


def means(w, x, y):
    return [float((w * z).sum() / w.sum()) for z in (x, y, x * y, x * x, y * y, np.minimum(x, y))]


def held(rng, signals, ticks):
    """Intervals of held values, some of the signals set nearly always."""
    rows, dense = [], {}
    for s in signals:
        dense[s], t, v = np.zeros(ticks), 0, 0.0
        while t < ticks:
            end = min(ticks, t + rng.choice((1, 2, 3, 9, 40)))
            v = rng.choice((0.0, 0.25, 0.5, 1.0)) if s != "busy" else rng.choice((1.0, 1.0, 1.0, 0.0))
            dense[s][t:end] = v
            rows.append((s, t, None if end == ticks else end, v))
            t = end
    return rows, dense


@pytest.mark.parametrize(("n", "alpha"), [(1, 2), (2, 2), (8, 0), (8, 1), (9, 2), (16, 3), (7, 4), (1000, 5)])
def test_cumulative_weights(spark, n, alpha):
    got = [r[0] for r in spark.range(n + 1).select(sa.cumulative_weight(F.col("id"), n, alpha)).collect()]
    assert np.allclose(got, np.concatenate([[0], np.cumsum(weights(n, alpha))]), atol=1e-9)


@pytest.mark.parametrize(("size", "overlap", "alpha", "bucket"), [(16, 0, 0, None), (16, 6, 2, 5), (10, -3, 1, 64)])
def test_moments_of_intervals(spark, size, overlap, alpha, bucket):
    rows, dense = held(random.Random(size), ("a", "b", "busy"), 90)
    iv = spark.createDataFrame(rows, "signal string, t0 long, t1 long, v double")
    got = {(r["x"], r["y"], r["delta"], r["u"]): [r[c] for c in MEANS] for r in re_.interval_moments(iv, [-3, 0, 5], size, overlap, alpha, end=90, bucket=bucket).collect()}
    padded = {s: np.concatenate([v, np.zeros(200)]) for s, v in dense.items()}
    assert len({k[3] for k in got}) >= 4
    for (x, y, delta, u), m in got.items():
        xs, ys = padded[x][u : u + size], padded[y][u + delta : u + delta + size]
        assert np.allclose(m, means(weights(size, alpha), xs, ys), atol=1e-9)
    ticks = spark.createDataFrame([(s, t, float(v[t])) for s, v in dense.items() for t in range(90) if v[t]], "signal string, t long, v double")
    want = {(r["x"], r["y"], r["delta"], r["u"]): [r[c] for c in MEANS] for r in re_.pair_moments(ticks, [-3, 0, 5], size, overlap, alpha).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in got)


def test_long_windows_expand_no_tick(spark):
    n = 1 << 20
    iv = spark.createDataFrame([("a", 0, n // 2, 1.0), ("b", n // 4, None, 0.5), ("c", 5, 6, 1.0)], "signal string, t0 long, t1 long, v double")
    m = {(r["x"], r["y"]): r for r in re_.interval_moments(iv, [0], n, end=3 * n).where("u = 0").collect()}
    assert m["a", "b"]["exy"] == 0.125 and m["a", "b"]["emin"] == 0.125 and m["b", "a"]["ex"] == 0.375 and m["a", "c"]["exy"] == 1 / n
    assert re_.interval_moments(iv.where("t0 < 0"), [0], 8, end=9).count() == 0


def coarse(v, factor, offset):
    blocks = len(v) // factor
    return np.array([v[b * factor + offset(b)] for b in range(blocks)])


@pytest.mark.parametrize(("size", "stride", "alpha", "zoom"), [(16, None, 0, 2), (24, 8, 2, 3), (16, 20, 1, 0)])
def test_ladder_of_shifts(spark, size, stride, alpha, zoom):
    import hashlib

    rng = random.Random(size)
    _, dense = held(rng, ("a", "b", "busy"), 150)
    ticks = spark.createDataFrame([(s, t, float(v[t])) for s, v in dense.items() for t in range(150) if v[t]], "signal string, t long, v double")
    back, forward = 8, 6
    ladder = rs.shift_set(spark, size, back, forward, zoom)
    steps = {(r["factor"], r["delta"]) for r in ladder.collect()}
    got = {(r["factor"], r["delta"], r["u"], r["x"], r["y"]): [r[c] for c in MEANS] for r in re_.ladder_moments(ticks, ladder, size, back, forward, stride, alpha, seed=4).collect()}
    assert {k[:2] for k in got} == steps and len({k[2] for k in got}) >= 5
    for (f, delta, u, x, y), m in got.items():
        begin = u - back
        full = {s: np.array([v[t] if 0 <= t < 150 else 0.0 for t in range(begin, u + size + forward + 1 + f)]) for s, v in dense.items()}
        drawn = lambda s: int(hashlib.md5(f"4|{s}".encode()).hexdigest()[:8], 16)  # noqa: E731, B023
        low = {s: coarse(v, f, lambda b, s=s, f=f: (b & (f - 1)) ^ (drawn(s) % f)) for s, v in full.items()}
        first, blocks, step = back // f, size // f, delta // f
        place = lambda s, i: np.array([low[s][k] if 0 <= k < len(low[s]) else 0.0 for k in range(i, i + blocks)])  # noqa: E731, B023
        assert u + delta >= 0 and np.allclose(m, means(weights(blocks, alpha), place(x, first), place(y, first + step)), atol=1e-9)
    for a, b in (("dep", "cov"), ("ham", None)):
        edges = {(r["factor"], r["delta"], r["u"], r["x"], r["y"]) for r in re_.ladder_edges(ticks, ladder, size, back, forward, a, 0.1, b, 0.05, stride=stride, alpha=alpha, seed=4).collect()}
        rows = mt.with_metrics(spark.createDataFrame([(*k, *v) for k, v in got.items()], "factor long, delta long, u long, x string, y string, " + ", ".join(f"{c} double" for c in MEANS)))
        want = rows.where(f"{a} > 0.1" + (f" and {b} > 0.05" if b else ""))
        assert edges == {(r["factor"], r["delta"], r["u"], r["x"], r["y"]) for r in want.collect()} and edges


@pytest.mark.parametrize(("vectors", "ticks"), [(3, 7), (256, 4096)])
def test_all_pairs_in_tiles(spark, vectors, ticks):
    rng, n = random.Random(vectors), 40
    v = {(s, i): np.array([rng.choice((0.0, 0.0, 0.5, 1.0)) for _ in range(n)]) for s, k in (("a", 11), ("b", 2), ("c", 1)) for i in rng.sample(range(-50, 1000), k)}
    v["a", 5000] = np.zeros(n)  # without a sample, so no vector
    rows = [(s, i, t, float(x)) for (s, i), z in v.items() for t, x in enumerate(z) if x]
    got = {(r["system"], r["x"], r["y"]): r for r in re_.all_pairs(spark.createDataFrame(rows, "system string, idx long, t long, v double"), n, vectors=vectors, ticks=ticks).collect()}
    have = sorted({(s, i) for s, i, *_ in rows})
    assert set(got) == {(s, i, j) for s, i in have for z, j in have if s == z and i < j}
    for (s, i, j), r in got.items():
        x, y = v[s, i], v[s, j]
        assert np.isclose(r["exy"], (x * y).mean()) and np.isclose(r["emin"], np.minimum(x, y).mean()) and np.isclose(r["ham"], 1 - np.abs(x - y).mean()) and np.isclose(r["cov"], 4 * abs((x * y).mean() - x.mean() * y.mean()))


@pytest.mark.parametrize("whole", [True, False])
def test_pairs_leave_a_tile_in_batches(monkeypatch, whole):
    rows = [(k, 0 if whole else k % 2, [k % 5, 5], [0.5, 1.0], 1.5, 1.25) for k in range(9)]
    found = []
    for many in (1 << 16, 10):
        monkeypatch.setattr(re_, "PAIRS", many)
        tile = re_._Tile((pa.scalar("a"),), whole)
        tile.add(rows[::2], 6)  # in two parts: the sums go on
        tile.add(rows, 6)
        batches = list(tile.batches([pa.string(), pa.int64()], ["system", "x", "y", "sx", "sxx", "sy", "syy", "sxy", "smin"]))
        assert len(batches) > 1 if many == 10 else len(batches) == 1
        found.append(sorted(tuple(r.values()) for b in batches for r in b.to_pylist()))
    assert found[0] == found[1] and len(found[0]) == (36 if whole else 20)
    assert ("a", 0, 5, 3.0, 2.5, 1.5, 1.25, 1.25, 1.5) in found[0]


def test_pairs_of_a_tile_are_not_shuffled(spark):
    """Repeated samples, vectors of zeros and of nulls and null keys are taken as ever."""
    rows = [("a", i, t, float((i * t) % 3) / 2) for i in range(9) for t in range(5)] + [("a", 3, 1, 0.5)] * 2 + [("a", 20, 0, 0.0), ("a", 21, 0, None), ("a", None, 0, 1.0), (None, 1, 0, 1.0), (None, 2, 0, 1.0)]
    for vectors, ticks in ((2, 2), (100, 100)):
        pairs = re_.all_pairs(spark.createDataFrame(rows, "system string, idx long, t long, v double"), 5, vectors=vectors, ticks=ticks)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("MapInArrow")] and "Join" not in plan[: plan.index("MapInArrow")]
        got = {(r["system"], r["x"], r["y"]): r for r in pairs.collect()}
        idx = [*range(9), 20, 21]
        assert set(got) == {("a", x, y) for x in idx for y in idx if x < y} and pairs.count() == len(got)
        assert got["a", 20, 21]["ey"] is None and got["a", 20, 21]["ex"] == got["a", 20, 21]["exy"] == 0
        assert np.isclose(got["a", 2, 3]["ey"], (0 + 0 + 0 + 0 + 0 + 2 * 0.5) / 5) and np.isclose(got["a", 2, 3]["exy"], 0.5 * 1.0 / 5)


def test_rounding_as_by_decimals(spark):
    from sigrel.plans.queries import r6

    values = [0.0, -0.0, -1e-9, 1 / 128, -1 / 128, 0.0000005, 2.5e-6, 0.1234565, 0.12345649999, 1e13 + 0.3, -3.7, float("nan"), float("inf"), None, *(random.Random(1).uniform(-2, 2) for _ in range(500))]
    both = spark.createDataFrame([(v,) for v in values], "v double").select(r6("v").alias("a"), F.round("v", 6).alias("b"))
    assert all(repr(r["a"]) == repr(r["b"]) for r in both.collect())
