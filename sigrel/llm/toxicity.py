"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocabulary import Vocabulary, ngram_buckets, sums

#: Bound of the training sample: rows of each label.
SAMPLE_ROWS = 1500


@dataclass
class ToxicityModel:
    """``embedding`` has a vector for each n-gram bucket; a word's is their mean, a text's the mean of its words'."""

    embedding: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    sizes: tuple[int, ...]

    def word_logits(self) -> np.ndarray:
        """What each bucket adds to the log odds of label 1 (the model is linear in the embeddings)."""
        return (self.embedding @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float32)

    @property
    def odds_bias(self) -> float:
        return float(self.bias[1] - self.bias[0])


def _word_means(values: np.ndarray, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n = np.diff(starts)
    s = np.add.reduceat(values[buckets], starts[:-1], axis=0)
    return s / (n[:, None] if values.ndim > 1 else n)


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, dim: int = 2, buckets: int = 1 << 17, sizes: tuple[int, ...] = (3, 4, 5), steps: int = 100, sure: float = 6.0, decay: float = 3e-5, seed: int = 7) -> ToxicityModel:
    """Weighted cross entropy over embeddings, softmax and bias together, by accelerated gradient steps.

    Every n-gram of the sample is trained. Its vector is learned in a scale of its own: that of its spread over texts,
    less the nearer its log odds are to chance (``sure`` standard errors count in full), so that the penalty on the
    vectors holds back n-grams that would be learned by heart.
    """
    vocabulary: dict[bytes, int] = {}
    rows, cols = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, text in enumerate(texts):
        words = text.lower().encode("utf-8", "surrogatepass").split()
        cols.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words)))
        rows.append(np.full(len(words), i))
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 1, (dim, 2))
    w /= np.linalg.norm(w[:, 1] - w[:, 0])
    b = np.zeros(2)
    if not len(rows) or len(set(labels.tolist())) < 2:
        b[1] = np.log((weights[labels == 1].sum() + 0.5) / (weights[labels == 0].sum() + 0.5))
        return ToxicityModel(np.zeros((buckets, dim), np.float32), w, b, sizes)
    grams, gstarts = ngram_buckets(list(vocabulary), sizes, buckets)
    per_word = np.diff(gstarts)
    word_of = np.repeat(np.arange(len(vocabulary)), per_word)
    pair, count = np.unique(rows * len(vocabulary) + cols, return_counts=True)
    doc, word = pair // len(vocabulary), pair % len(vocabulary)
    share = count / np.bincount(rows, minlength=len(texts))[doc]
    wt = weights / weights.sum()

    def of_texts(e: np.ndarray) -> np.ndarray:
        words = np.bincount(word_of, e[grams], len(vocabulary)) / per_word
        return np.bincount(doc, share * words[word], len(texts))

    def of_grams(r: np.ndarray) -> np.ndarray:
        words = np.bincount(word, share * r[doc], len(vocabulary)) / per_word
        return np.bincount(grams, words[word_of], buckets)

    seen = [np.bincount(grams, np.bincount(word[labels[doc] == k], minlength=len(vocabulary))[word_of], buckets) for k in (0, 1)]
    n0, n1 = ((labels == k).sum() + 1.0 for k in (0, 1))
    odds = np.log((seen[1] + 0.5) / n1) - np.log((seen[0] + 0.5) / n0)
    trust = np.minimum(1, np.abs(odds) / np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5)) / sure) ** 4
    spread = np.sqrt(np.bincount(grams, np.bincount(word, share * share, len(vocabulary))[word_of], buckets) / len(texts))
    scale = trust / np.maximum(spread, 1e-4)
    mean = of_grams(wt) * scale  # texts are taken as differences from their mean, which goes into the bias at the end
    out = lambda v: np.stack([of_texts(v[:, k] * scale) - mean @ v[:, k] for k in range(dim)], 1)
    back = lambda g: np.stack([of_grams(g[:, k]) * scale - mean * g[:, k].sum() for k in range(dim)], 1)
    x = rng.normal(size=buckets)
    for _ in range(12):  # the largest curvature, by power iteration
        x = of_grams(wt * (of_texts(x * scale) - mean @ x)) * scale
        curve = np.linalg.norm(x)
        x /= max(curve, 1e-30)
    curve = max(curve, 1e-30) / 4 * 1.1
    y = np.eye(2)[labels]
    b[1] = np.log(wt[labels == 1].sum() / wt[labels == 0].sum())
    v, ahead, at_b, t = np.zeros((buckets, dim)), np.zeros((buckets, dim)), b.copy(), 1.0
    for _ in range(steps):
        docs = out(ahead)
        z = docs @ w + at_b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        gz = (p - y) * wt[:, None]
        rate = 1 / (curve * max(1.0, ((w[:, 1] - w[:, 0]) ** 2).sum()))
        v_next, b_next = ahead - rate * (back(gz @ w.T) + decay * curve * ahead), at_b - gz.sum(0)
        w = w - 0.01 * (docs.T @ gz)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, at_b = v_next + (t - 1) / t_next * (v_next - v), b_next + (t - 1) / t_next * (b_next - b)
        v, b, t = v_next, b_next, t_next
    return ToxicityModel((v * scale[:, None]).astype(np.float32), w, b - (mean @ v) @ w, sizes)


def fit(docs: DataFrame, labels: DataFrame, learn=None, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from a bounded sample of labelled rows: for each label the ``sample_rows`` rows of least hash, whole texts.

    ``learn`` is a condition on doc_id that says which rows may be learned from. Classes weigh as often as they
    occur among all labelled rows. A doc_id labelled twice has the greater label; of several texts under one doc_id
    the greatest is in the sample. Null and empty texts are left out; without rows of both labels all texts get one
    score.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null")
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    there = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        picked = part if picked is None else picked.union(part)
    # at most 2 * sample_rows ids: a bounded side
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").where(F.length("text") > 0)
    some = rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))

    def work(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("doc_id")
        y = sample["toxic"].to_numpy(np.int64)
        seen = np.bincount(y, minlength=2)
        m = train(list(sample["text"]), y, np.array([there.get(k, 0) / max(1, seen[k]) for k in (0, 1)])[y])
        return pd.DataFrame({"embedding": [m.embedding.astype(np.float32).tobytes()], "softmax": [m.softmax.astype(np.float64).tobytes()], "bias": [m.bias.astype(np.float64).tobytes()]})

    # the sample is bounded, so one task can train on it; only the model comes to the driver
    made = some.groupBy(F.lit(0).alias("sample")).applyInPandas(work, "embedding binary, softmax binary, bias binary").first()
    if made is None:
        return train([], np.empty(0, np.int64), np.empty(0))
    softmax = np.frombuffer(made["softmax"], np.float64).reshape(-1, 2)
    return ToxicityModel(np.frombuffer(made["embedding"], np.float32).reshape(-1, len(softmax)), softmax, np.frombuffer(made["bias"], np.float64), (3, 4, 5))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The columns of ``docs`` with score (0 to 1) and predicted (1 where score >= threshold), over whole texts.

    Null and empty texts get the score of the bias alone. Rows that are equal get equal scores, texts of any length count as a whole; extra columns pass
    through (a column named score or predicted is replaced); an empty table gives an empty one.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(model.word_logits())
    bias, sizes = model.odds_bias, model.sizes

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        values = table.value

        def work(words: list[bytes]) -> np.ndarray:
            return _word_means(values, *ngram_buckets(words, sizes, len(values))).astype(np.float32)

        vocabulary = Vocabulary(work, lower=True)
        for texts in batches:
            v, starts = vocabulary.batch(texts.array)
            z = bias + sums(v, starts) / np.maximum(1, np.diff(starts))
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -60, 60))))

    score = F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)
    out = docs.withColumn("score", score(F.col("text").cast("string")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
