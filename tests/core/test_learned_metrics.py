"""Nets trained by informedness: gradients against differences, sums against numpy, odd tables, and what is learned."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigrel.operators import learn as le


def pairs_of(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        ex, ey, exy = (float(v) for v in rng.random(3))
        rows.append((i, ex, ey, exy if i % 17 else None, int(exy > ex * ey + 0.3)))
    return spark.createDataFrame(rows, "id int, ex double, ey double, exy double, known int")


@pytest.mark.parametrize("layers", [le.NETS[i] for i in (0, 2, 3, 4, 7, 9)])
@pytest.mark.parametrize("objective", ["informedness", "markedness"])
def test_gradient_is_that_of_the_counts(layers, objective):
    rng = np.random.default_rng(1)
    x, y = rng.normal(0, 1, (60, 3)), (rng.random(60) < 0.4).astype(float)
    net = le.Net.start("withIsect", layers, 5)
    value, grad = le.gain(net.sums(x, y), objective)
    # by hand: the soft counts of all rows
    a = x
    for (w, b), name in zip(net.layers(), net.activations):
        z = a @ w + b
        a = {"qsig": np.clip(z / 4 + 0.5, 0, 1), "relu": np.maximum(z, 0), "tanh": np.tanh(z), "sigmoid": 1 / (1 + np.exp(-z))}[name]
    p = a[:, 0]
    tp, fp, fn, tn = (y * p).sum(), ((1 - y) * p).sum(), (y * (1 - p)).sum(), ((1 - y) * (1 - p)).sum()
    want = tp / (tp + fn) + tn / (tn + fp) - 1 if objective == "informedness" else tp / (tp + fp) + tn / (tn + fn) - 1
    assert value == pytest.approx(want, abs=1e-12)
    start = net.theta.copy()
    for i in range(len(start)):
        both = []
        for step in (1e-6, -1e-6):
            net.theta = start.copy()
            net.theta[i] += step
            both.append(le.gain(net.sums(x, y), objective)[0])
        assert grad[i] == pytest.approx((both[0] - both[1]) / 2e-6, abs=1e-5)


def test_sums_do_not_depend_on_the_deal_of_rows(spark):
    d = pairs_of(spark)
    nets = le.sweep(("withIsect", "perfCntrs"), le.NETS[-2:])
    p = d.toPandas().fillna(0.0)
    for parts in (1, 7):
        got = le.confusion_sums(d.repartition(parts), nets)
        for i, n in enumerate(nets):
            assert np.allclose(got[i], n.sums(p[list(n.inputs)].to_numpy(), p["known"].to_numpy()))


def test_nets_learn_what_their_inputs_hold(spark):
    d = pairs_of(spark)
    nets = le.sweep(("withIsect", "perfCntrs"), (le.NETS[2], le.NETS[8]))
    trained = le.train_nets(d, nets, held_out=F.col("id") % 4 == 0, steps=60)
    assert all(np.array_equal(n.theta, m.theta) for n, m in zip(nets, le.sweep(("withIsect", "perfCntrs"), (le.NETS[2], le.NETS[8]))))
    t = {(r["features"], r["net"]): r for r in le.sweep_table(spark, trained).collect()}
    assert len(t) == 4 and sum(r["best"] for r in t.values()) == 2
    good, poor = (max(r["held_out"] for k, r in t.items() if k[0] == f) for f in ("withIsect", "perfCntrs"))
    assert good > 0.75 and good > poor + 0.1
    best = max(trained, key=lambda x: x["informedness"])
    # the column is the same net, and gives the same counts
    s = best["net"].score(d).where("id % 4 <> 0").toPandas()
    hard, known = s["score"] > 0.5, s["known"] == 1
    assert (hard & known).sum() / known.sum() - (hard & ~known).sum() / (~known).sum() == pytest.approx(best["informedness"])


def test_tables_without_a_kind_of_row(spark):
    d = pairs_of(spark, 20)
    nets = le.sweep(("withIsect",), le.NETS[-1:])
    for odd in (d.limit(0), d.withColumn("known", F.lit(1)), d.withColumn("known", F.lit(None).cast("int"))):
        got = le.train_nets(odd, nets, steps=2)
        assert (got[0]["soft"], got[0]["informedness"], got[0]["held_out"]) == (None, None, None) and np.array_equal(got[0]["net"].theta, nets[0].theta)
    assert le.sweep_table(spark, got).first()["best"]
    with pytest.raises(ValueError):
        le.gain(np.zeros(8), "no such")
