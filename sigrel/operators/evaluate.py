"""Known relations, confusion counts, classifier statistics, score summaries, and learned metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import with_metrics

SCORES = ("tpr", "tnr", "ppv", "npv", "acc", "bacc", "mcc", "bmi")


def known_pairs(connections: DataFrame, n_src: int, keys: tuple[str, ...] = ("system",)) -> DataFrame:
    """Connections (keys, dst, src) as pairs (keys, x, y), x < y: sources come first, destinations are moved up by n_src."""
    a, b = F.col("src"), F.col("dst") + F.lit(n_src)
    return connections.select(*keys, F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()


def label_pairs(pairs: DataFrame, known: DataFrame, on: Sequence[str] = ("x", "y")) -> DataFrame:
    """Pairs with known = 1 where the pair is in ``known``, else 0."""
    return pairs.join(known.select(*on).distinct().withColumn("known", F.lit(1)), list(on), "left").withColumn("known", F.coalesce("known", F.lit(0)))


def scores(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Eight statistics of (maybe fractional) confusion counts; null where undefined."""
    div = F.try_divide
    tpr, tnr = div(tp, tp + fn), div(tn, tn + fp)
    return {
        "tpr": tpr, "tnr": tnr, "ppv": div(tp, tp + fp), "npv": div(tn, tn + fn),
        "acc": div(tp + tn, tp + fp + fn + tn), "bacc": (tpr + tnr) / 2,
        "mcc": div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "bmi": tpr + tnr - 1,
    }


def with_scores(counts: DataFrame) -> DataFrame:
    c = [F.col(n).cast("double") for n in ("tp", "fp", "fn", "tn")]
    return counts.withColumns(scores(*c))


def confusion(df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), cube: bool = False) -> DataFrame:
    """Confusion counts of two 0/1 columns and their statistics, in one aggregate; grouped, or over a cube of ``by``."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    g = df.cube(*by) if cube else df.groupBy(*by)
    n = lambda c: F.count_if(c).cast("double")
    return with_scores(g.agg(n(t & p).alias("tp"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"), n(~t & ~p).alias("tn")))


def soft_confusion(pairs: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("system",)) -> DataFrame:
    """Fuzzy counts of known (0/1) against each metric's estimate in [0, 1], for each group and metric, with statistics."""
    long = pairs.unpivot([*by, "known"], list(metrics), "metric", "est")
    k, e = F.col("known").cast("double"), F.coalesce("est", F.lit(0.0))
    s = lambda a, b: F.sum(F.least(a, b))
    counts = long.groupBy(*by, "metric").agg(s(k, e).alias("tp"), s(1 - k, e).alias("fp"), s(k, 1 - e).alias("fn"), s(1 - k, 1 - e).alias("tn"))
    return with_scores(counts)


def score_summary(scored: DataFrame, kind: str = "system_type", names: Sequence[str] = SCORES) -> DataFrame:
    """Means over systems, nulls left out, for each kind of system and metric and (kind null) for all systems."""
    k = scored.withColumn("_kind", F.explode(F.array(F.col(kind).cast("string"), F.lit(None).cast("string"))))
    return k.groupBy(F.col("_kind").alias(kind), "metric").agg(*[F.avg(n).alias(n) for n in names])


def score_density(scored: DataFrame, bins: int = 20, names: Sequence[str] = SCORES, by: Sequence[str] = ("metric",)) -> DataFrame:
    """How many systems have a score in each of ``bins`` equal parts of [0, 1]: (by, score, bin, n)."""
    long = scored.unpivot(list(by), list(names), "score", "value").where("value is not null")
    at = F.least(F.lit(bins), F.greatest(F.lit(1), F.width_bucket("value", F.lit(0.0), F.lit(1.0), F.lit(bins))))
    return long.groupBy(*by, "score", at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def export_pairs(pairs: DataFrame, path: str | None = None) -> DataFrame:
    """One row a pair as text with 6 decimals, undefined values as 0; written as CSV if a path is given."""
    num = [c for c, t in pairs.dtypes if t in ("double", "float")]
    fixed = lambda c: F.format_string("%.6f", F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))).alias(c)
    out = pairs.select(*[fixed(c) if c in num else c for c in pairs.columns])
    if path:
        out.write.mode("overwrite").option("header", True).csv(path)
    return out


# learned metrics

ACTIVATIONS = {
    "qsig": lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / 4 + 0.5)),
    "relu": lambda x: F.greatest(F.lit(0.0), x),
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "tanh": F.tanh,
}

# What each named set of inputs holds.
FEATURE_SETS = {
    "fullAssist": ("ex", "ey", "exy", "ediff", "cex_xy", "cex_yx", "cls", "cos", "cov", "dep", "tmt"),
    "perfCntrs": ("ex", "ey"),
    "withIsectSymdiff": ("ex", "ey", "exy", "ediff"),
    "withIsect": ("ex", "ey", "exy"),
    "withSymdiff": ("ex", "ey", "ediff"),
    "withAssist": ("ex", "ey", "exy", "ediff", "cov", "dep", "tmt"),
}


def with_features(moments: DataFrame) -> DataFrame:
    """The moment table with all that a pair can be judged by: ediff = E|X-Y|, cex_xy = E[X|Y], cex_yx = E[Y|X], metrics."""
    m = with_metrics(moments)
    return m.withColumns({"ediff": 1 - F.col("ham"), "cex_xy": F.col("cex"), "cex_yx": F.when(F.col("ex") != 0, F.col("exy") / F.col("ex"))})


def score_model(pairs: DataFrame, inputs: Sequence[str], weights: Sequence, biases: Sequence, activations: Sequence[str], name: str = "score") -> DataFrame:
    """A feed-forward net as one column: weights[l][i][j] from input i to unit j of layer l. Undefined inputs are 0."""
    layer = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in inputs]
    out = pairs
    for n, (w, b, act) in enumerate(zip(weights, biases, activations)):
        units = []
        for j in range(len(b)):
            z = F.lit(float(b[j]))
            for i, x in enumerate(layer):
                z = z + x * float(w[i][j])
            units.append(ACTIVATIONS[act](z))
        out = out.withColumns({f"_{n}_{j}": u for j, u in enumerate(units)})
        layer = [F.col(f"_{n}_{j}") for j in range(len(units))]
    made = [c for c in out.columns if c.startswith("_") and c not in pairs.columns]
    return out.withColumn(name, layer[0]).drop(*made)


def fit_model(pairs: DataFrame, features: str | Sequence[str], hidden: Sequence[int] = (4, 4), label: str = "known", seeds: Sequence[int] = (1, 2), iterations: int = 60):
    """Train multilayer perceptrons on labelled pairs and keep the one with the best informedness on them.

    The loss is that of pyspark.ml's classifier (cross entropy), not negated informedness; the choice among seeds
    uses informedness. Returns (model, informedness, feature names).
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler

    names = list(FEATURE_SETS[features] if isinstance(features, str) else features)
    data = pairs.select(F.col(label).cast("double").alias("label"), *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
    data = VectorAssembler(inputCols=names, outputCol="features").transform(data).select("label", "features").persist()
    best = None
    for seed in seeds:
        model = MultilayerPerceptronClassifier(layers=[len(names), *hidden, 2], maxIter=iterations, seed=seed).fit(data)
        got = confusion(model.transform(data).select(F.col("label").alias("t"), F.col("prediction").alias("p")), "t", "p").first()["bmi"]
        if best is None or (got or -1) > best[1]:
            best = (model, got or -1.0)
    data.unpersist()
    return best[0], best[1], names
