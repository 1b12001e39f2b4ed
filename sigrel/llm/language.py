"""Language ID: nearest centroid among several clustered TF-IDF centroids of each language, with rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the training sample: rows of a language, and rows in all, shared evenly by however many languages.
SAMPLE_ROWS, SAMPLE_TOTAL = 400, 8000
UNKNOWN = "und"


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each, of length 1
    owner: np.ndarray  # place in langs of each centroid
    reach: np.ndarray  # least cosine of each centroid's own texts, with some room: further ones are rejected
    sizes: tuple[int, ...]


def _counts(texts, sizes: tuple[int, ...], buckets: int) -> np.ndarray:
    """Hashed character n-gram counts of each whole text in lower case; runs of other characters count as one blank."""
    out = np.zeros((len(texts), buckets), np.float32)
    for row, text in enumerate(texts):
        if not text:
            continue
        c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = (c >= 0x61) & (c <= 0x7A) | (c >= 0xAA)
        keep = letter | np.r_[True, letter[:-1]]
        c = np.where(letter, c, 32)[keep].astype(np.uint32)
        h = np.zeros(len(c), np.uint32)
        for n in range(1, max(sizes) + 1):
            if len(c) < n:
                break
            h = (h[: len(c) - n + 1] * np.uint32(0x01000193)) ^ c[n - 1 :]
            if n in sizes:
                mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
                out[row] += np.bincount((mixed >> np.uint32(12)) % np.uint32(buckets), minlength=buckets)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-9)


def _vectors(texts, idf: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    x = _counts(texts, sizes, len(idf))
    return _unit(np.log1p(x) * idf)


def train(counts: np.ndarray, langs: list[str], clusters: int = 3, sizes: tuple[int, ...] = (1, 2, 3), room: float = 0.7, seed: int = 3) -> LanguageModel:
    """idf over the sample's n-gram counts, then spherical k-means with ``clusters`` centroids in each language.

    Without a row the model has no language."""
    names, buckets = sorted(set(langs)), counts.shape[1]
    idf = np.log((1 + len(langs)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    x = _unit(np.log1p(counts) * idf)
    which = np.array([names.index(v) for v in langs], np.int64)
    rng = np.random.default_rng(seed)
    centroids, owner, reach = [], [], []
    for k in range(len(names)):
        own = x[which == k]
        c = own[rng.permutation(len(own))[: min(clusters, len(own))]]
        for _ in range(12):
            near = (own @ c.T).argmax(1)
            c = _unit(np.stack([own[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))]))
        cos = own @ c.T
        for j in range(len(c)):
            mine = cos[cos.argmax(1) == j, j]
            centroids.append(c[j])
            owner.append(k)
            reach.append(room * (np.quantile(mine, 0.01) if len(mine) else 1.0))
    return LanguageModel(names, idf, np.array(centroids, np.float32).reshape(-1, buckets), np.array(owner, np.int64), np.array(reach), sizes)


def _has_letter(text) -> bool:
    return isinstance(text, str) and any(c.isalpha() for c in text)


def fit(docs: DataFrame, learn=None, sample_rows: int = SAMPLE_ROWS, sample_total: int = SAMPLE_TOTAL, buckets: int = 1 << 12, sizes: tuple[int, ...] = (1, 2, 3)) -> LanguageModel:
    """Learn from text and lang of a bounded sample: of each language the ``sample_rows`` rows of least hash, or fewer
    if that makes more than ``sample_total`` rows in all (one a language at least).

    Rows with a null lang or id or without a letter are not learned from; ``learn`` is a condition on doc_id. Of rows
    that repeat a lang and doc_id one is in the sample, that of least hash of the text. The n-grams of whole texts
    are counted by Spark, so a sampled row is a vector of ``buckets`` numbers on the driver, whatever its length.
    A table without such rows gives a model that knows no language.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    d = d.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if learn is not None:
        d = d.where(learn)
    # the least hashes of each language, found before any text is moved: first of each of its lots, then of the rest
    d = d.withColumn("text_key", F.xxhash64("text"))
    ids = d.groupBy("lang", "doc_id").agg(F.min("text_key").alias("text_key")).withColumn("at", F.xxhash64("doc_id"))
    order = [F.col("at"), F.col("doc_id")]
    ids = ids.withColumn("place", F.row_number().over(Window.partitionBy("lang", F.pmod("at", F.lit(64))).orderBy(*order))).where(F.col("place") <= sample_rows)
    ids = ids.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= sample_rows)
    ids = ids.orderBy("place", "lang").limit(sample_total).select("lang", "doc_id", "text_key")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _counts(list(b["text"].array), sizes, buckets)
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"], "counts": list(x)})

    some = d.join(F.broadcast(ids), ["lang", "doc_id", "text_key"]).select("doc_id", "lang", "text")
    got = some.mapInPandas(count, "doc_id long, lang string, counts array<float>").toPandas()
    got = got.sort_values(["lang", "doc_id"], kind="stable").drop_duplicates(["lang", "doc_id"])  # equal rows
    x = np.stack(got["counts"].to_list()).astype(np.float32) if len(got) else np.zeros((0, buckets), np.float32)
    return train(x, got["lang"].to_list(), sizes=sizes)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The columns of ``docs`` with language: struct(nearest, score, rejected, lang).

    ``nearest`` is the language of the centroid with the largest cosine (the first in order if equal) and score that
    cosine, held to 0 to 1; ``rejected`` says that the text is further from the centroid than its own texts are, and
    ``lang`` is the nearest language unless rejected, else "und". A null text or one without a letter has nearest
    and lang "und" and score 0, as has any text if the model knows no language. Whole texts are used, of any length;
    equal rows get equal results. Extra columns pass through; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            t = list(texts.array)
            known = np.array([_has_letter(x) for x in t], bool)
            if not m.langs:
                yield pd.DataFrame({"nearest": UNKNOWN, "score": 0.0, "rejected": True, "lang": UNKNOWN}, index=range(len(t)))
                continue
            cos = np.concatenate([_vectors(t[i : i + 250], m.idf, m.sizes) @ m.centroids.T for i in range(0, len(t), 250)]) if t else np.empty((0, len(m.owner)))
            best = cos.argmax(1)
            score = np.clip(cos[np.arange(len(t)), best], 0, 1).astype(np.float64)
            names = np.array(m.langs, object)[m.owner[best]]
            far = known & (score < m.reach[best])
            yield pd.DataFrame({"nearest": np.where(known, names, UNKNOWN), "score": np.where(known, score, 0.0), "rejected": far | ~known, "lang": np.where(known & ~far, names, UNKNOWN)})

    predict = F.pandas_udf(run, "nearest string, score double, rejected boolean, lang string", F.PandasUDFType.SCALAR_ITER)
    return docs.withColumn("language", predict(F.col("text").cast("string")))
