"""Learned metrics: many small nets trained at once on labelled pairs, by the informedness of their soft confusion counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import FEATURE_SETS, score_model

# The nets of the sweep, as (units, activation) of the hidden layers and the activation of the output.
NETS = (
    ((8, "qsig"), (8, "qsig"), "sigmoid"),
    ((8, "sigmoid"), (8, "sigmoid"), "sigmoid"),
    ((8, "tanh"), (8, "tanh"), "sigmoid"),
    ((8, "relu"), (8, "relu"), "sigmoid"),
    ((4, "sigmoid"), (4, "sigmoid"), "sigmoid"),
    ((4, "tanh"), (4, "tanh"), "sigmoid"),
    ((4, "qsig"), (4, "qsig"), "sigmoid"),
    ((4, "qsig"), "qsig"),
    ((2, "qsig"), "sigmoid"),
    ((2, "qsig"), (2, "qsig"), "sigmoid"),
)

#: What each sum of a pass starts with; the gradients of tp and of fp follow, as long as the net's parameters each.
SUMS = ("tp", "fp", "hard_tp", "hard_fp", "p", "n")

# value and slope by the value of the sum z and of the unit
_UNITS = {
    "qsig": (lambda z: np.clip(z / 4 + 0.5, 0, 1), lambda z, a: np.where(np.abs(z) < 2, 0.25, 0.0)),
    "relu": (lambda z: np.maximum(z, 0), lambda z, a: (z > 0).astype(float)),
    "sigmoid": (lambda z: 0.5 * (1 + np.tanh(z / 2)), lambda z, a: a * (1 - a)),
    "tanh": (np.tanh, lambda z, a: 1 - a * a),
}


@dataclass
class Net:
    """A feed-forward net over named inputs; ``theta`` has the weights (inputs x units) and biases of each layer in turn."""

    features: str
    inputs: tuple[str, ...]
    units: tuple[int, ...]
    activations: tuple[str, ...]
    seed: int
    theta: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def start(cls, features: str, layers: Sequence, seed: int, inputs: Sequence[str] | None = None) -> Net:
        """A net of random weights, equal for equal arguments."""
        *hidden, last = layers
        net = cls(features, tuple(inputs or FEATURE_SETS[features]), (*(u for u, _ in hidden), 1), (*(a for _, a in hidden), last), seed)
        rng, sizes = np.random.default_rng([seed, len(net.inputs), *net.units]), (len(net.inputs), *net.units)
        net.theta = np.concatenate([np.r_[rng.normal(0, np.sqrt(2 / (i + o)), i * o), np.zeros(o)] for i, o in zip(sizes, sizes[1:])])
        return net

    @property
    def name(self) -> str:
        return "_".join(f"{u}{a}" for u, a in zip(self.units, self.activations))

    def layers(self, theta: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(weights, biases) of each layer, as views."""
        theta, at, out = self.theta if theta is None else theta, 0, []
        for i, o in zip((len(self.inputs), *self.units), self.units):
            out.append((theta[at : at + i * o].reshape(i, o), theta[at + i * o : at + (i + 1) * o]))
            at += (i + 1) * o
        return out

    def sums(self, x: np.ndarray, known: np.ndarray) -> np.ndarray:
        """SUMS of rows, and the gradients of their tp and fp."""
        acts, zs = [x], []
        for (w, b), name in zip(self.layers(), self.activations):
            zs.append(acts[-1] @ w + b)
            acts.append(_UNITS[name][0](zs[-1]))
        p = acts[-1][:, 0]
        hard, y = p > 0.5, known > 0.5
        out = [np.array([p[y].sum(), p[~y].sum(), (hard & y).sum(), (hard & ~y).sum(), y.sum(), (~y).sum()], float)]
        for rows in (y, ~y):
            grad = np.zeros_like(self.theta)
            d = rows[:, None].astype(float)
            for k in range(len(zs) - 1, -1, -1):
                d = d * _UNITS[self.activations[k]][1](zs[k], acts[k + 1])
                gw, gb = self.layers(grad)[k]
                gw += acts[k].T @ d
                gb += d.sum(0)
                d = d @ self.layers()[k][0].T
            out.append(grad)
        return np.concatenate(out)

    def score(self, pairs: DataFrame, name: str = "score") -> DataFrame:
        """The net's estimate as a column of built-in functions."""
        w = self.layers()
        return score_model(pairs, self.inputs, [a.tolist() for a, _ in w], [b.tolist() for _, b in w], self.activations, name)


def confusion_sums(data: DataFrame, nets: Sequence[Net], label: str = "known") -> dict[int, np.ndarray]:
    """The sums of every net over all rows in one pass: each task adds up its own rows, Spark adds up the tasks.

    What reaches the driver is one vector a net, whatever the rows; an empty table gives zeros.
    """
    columns = sorted({c for n in nets for c in n.inputs})
    place = {c: i for i, c in enumerate(columns)}
    rows = data.select(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns], F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("_known"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            x, known = b[columns].to_numpy(float), b["_known"].to_numpy(float)
            got = [n.sums(x[:, [place[c] for c in n.inputs]], known) for n in nets]
            total = got if total is None else [s + g for s, g in zip(total, got)]
        if total is not None:
            yield pd.DataFrame({"net": range(len(nets)), "sums": total})

    parts = rows.mapInPandas(run, "net int, sums array<double>")
    added = parts.groupBy("net").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")).collect()
    out = {i: np.zeros(len(SUMS) + 2 * len(n.theta)) for i, n in enumerate(nets)}
    return out | {r["net"]: np.array(r["sums"]) for r in added}


def gain(sums: np.ndarray, objective: str = "informedness", hard: bool = False) -> tuple[float | None, np.ndarray]:
    """The objective of the counts (null where undefined) and its gradient.

    "informedness" is tp / p - fp / n, "markedness" tp / (tp + fp) + tn / (tn + fn) - 1.
    """
    tp, fp, p, n = sums[2 if hard else 0], sums[3 if hard else 1], sums[4], sums[5]
    d_tp, d_fp = np.split(sums[len(SUMS) :], 2)
    if objective == "informedness":
        return (tp / p - fp / n, d_tp / p - d_fp / n) if p and n else (None, 0 * d_tp)
    if objective != "markedness":
        raise ValueError(f"no objective {objective!r}")
    yes, tn, fn = tp + fp, n - fp, p - tp
    no = tn + fn
    if not yes or not no:
        return None, 0 * d_tp
    return tp / yes + tn / no - 1, (fp * d_tp - tp * d_fp) / yes**2 + (tn * d_tp - fn * d_fp) / no**2


def train_nets(pairs: DataFrame, nets: Sequence[Net], label: str = "known", held_out: Column | None = None, steps: int = 60, rate: float = 0.05, objective: str = "informedness") -> list[dict]:
    """Train all ``nets`` side by side on the pairs that aren't ``held_out``, each step one pass over the data.

    A step adds up the soft counts and their gradients over all rows (no mini-batches, so no row is left out and the
    order of rows doesn't matter) and moves every net by Adam. Undefined inputs and null labels are 0. Returns one
    dictionary a net: net, soft (its objective on what it was trained on), informedness (of score > 0.5) there and on
    the held-out rows, null where undefined (no row of a kind); without rows of both kinds nothing is trained.
    """
    nets = [Net(n.features, n.inputs, n.units, n.activations, n.seed, n.theta.copy()) for n in nets]
    columns = sorted({c for n in nets for c in n.inputs})
    data = pairs.select(*columns, label, F.coalesce(held_out, F.lit(False)).alias("_out") if held_out is not None else F.lit(False).alias("_out")).persist()
    learn, rest = data.where("not _out"), data.where("_out")
    try:
        slow, fast = [np.zeros_like(n.theta) for n in nets], [np.zeros_like(n.theta) for n in nets]
        for step in range(1, steps + 1):
            sums = confusion_sums(learn, nets, label)
            if step == 1 and not all(s[4] and s[5] for s in sums.values()):
                break
            for i, n in enumerate(nets):
                g = -gain(sums[i], objective)[1]
                slow[i] += 0.1 * (g - slow[i])
                fast[i] += 0.01 * (g * g - fast[i])
                n.theta -= rate * (slow[i] / (1 - 0.9**step)) / (np.sqrt(fast[i] / (1 - 0.99**step)) + 1e-8)
        own, other = confusion_sums(learn, nets, label), confusion_sums(rest, nets, label)
    finally:
        data.unpersist()
    return [{"net": n, "soft": gain(own[i], objective)[0], "informedness": gain(own[i], hard=True)[0], "held_out": gain(other[i], hard=True)[0]} for i, n in enumerate(nets)]


def sweep(sets: Sequence[str] = tuple(FEATURE_SETS), layouts: Sequence = NETS, seeds: Sequence[int] = (1,)) -> list[Net]:
    """Nets of random weights for every set of inputs, layout and seed."""
    return [Net.start(s, layers, seed) for s in sets for layers in layouts for seed in seeds]


def sweep_table(spark, trained: Sequence[dict]) -> DataFrame:
    """One row a trained net: features, net, seed, parameters, soft, informedness, held_out, and whether it is the best of its inputs.

    The best has the largest informedness on what it was trained on; ties go to the fewer parameters, then to the name.
    """
    key = lambda t: (-(-2.0 if t["informedness"] is None else t["informedness"]), len(t["net"].theta), t["net"].name, t["net"].seed)
    best = {f: min((t for t in trained if t["net"].features == f), key=key) for f in {t["net"].features for t in trained}}
    num = lambda v: None if v is None else float(v)
    rows = [(t["net"].features, t["net"].name, t["net"].seed, len(t["net"].theta), num(t["soft"]), num(t["informedness"]), num(t["held_out"]), t is best[t["net"].features]) for t in trained]
    return spark.createDataFrame(rows, "features string, net string, seed int, parameters int, soft double, informedness double, held_out double, best boolean")
