"""Mixing sources to target weights by distributed prefix sums (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

#: Documents of one slice of a source's key range, and slices (or groups of slices) summed together one level up.
SLICE_ROWS, FAN = 64, 256
#: Parts over which a source's rows are spread when they meet the source's figures.
SALTS = 64


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same with weight, cap and target.

    Sources in code point order (null last) take the weights in turn, repeating. ``share`` times all words is dealt
    out in proportion to weight; a target stops at ``most`` times its source's size and the excess is dealt again
    among the others, until none is above. That fixed point is a water level: with sources sorted by cap/weight, the
    first level that lies under the next source's cap/weight is the right one. One row per source, so small.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = sizes.withColumn("weight", F.element_at(w, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("all_size", F.sum("source_size").over(whole)).withColumn("all_weight", F.sum("weight").over(whole))
    left_size = F.lit(float(share)) * F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level_here", left_size / left_weight)
    # sources up to the first level under their own ratio are capped; from there on all share that level
    level = F.min(F.when(F.col("level_here") <= F.col("ratio"), F.struct("ratio", "level_here"))).over(whole)["level_here"]
    s = s.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def _prefix(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """Words that a mix takes from each document: doc_id, size, source_size, target, taken, epochs.

    Every document gets a hash-random key. A source's key range is dealt into slices of about ``SLICE_ROWS`` rows,
    slices into groups of ``FAN`` and groups again, so that prefix sums of word counts in key order are formed
    level by level and no window holds more than a few hundred rows until a source has billions. The target is
    whole passes over the source plus a remainder; the remainder is cut at its exact word count in key order, so
    one document of a source can be taken in part. Reruns agree: keys depend on doc_id, size and ``seed`` only.

    Null text or text without words has size 0 and is taken 0 times; a null source is a source of its own, after
    the others; a null doc_id has a key like any other; rows that are equal get equal figures up to the cut, where
    ties in the key are ordered by doc_id and size; an empty table gives an empty one; other columns are ignored.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("size").cast("string")))
    key = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").alias("key")
    d = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    d = cut(d.select("doc_id", "source", "size", key, F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SALTS)).cast("int").alias("salt")))
    sums = d.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("source_rows"))
    figures = source_targets(sums.select("source", "source_size"), weights, share, most).join(sums.select(F.col("source").alias("s2"), "source_rows"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    figures = cut(figures.select(F.col("source").alias("of"), "source_size", "source_rows", "target"))
    spread = figures.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = d.join(spread, d["source"].eqNullSafe(spread["of"]) & (d["salt"] == spread["part"])).drop("of", "salt", "part")
    slices = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / SLICE_ROWS))
    d = d.withColumn("slice", F.least(F.floor(F.col("key") / F.lit(float(1 << 52)) * slices), slices - 1).cast("long"))
    d = d.withColumn("group", F.floor(F.col("slice") / FAN).cast("long")).withColumn("top", F.floor(F.col("group") / FAN).cast("long"))
    # the levels are summed from this table, and by themselves, so that no plan holds all of them and the documents too
    by_slice = cut(d.groupBy("source", "top", "group", "slice").agg(F.sum("size").alias("words")))
    by_group = by_slice.groupBy("source", "top", "group").agg(F.sum("words").alias("words"))
    by_top = by_group.groupBy("source", "top").agg(F.sum("words").alias("words"))
    p_top = _prefix(by_top, ["source"], "top", "words", "p2").select("source", "top", "p2")
    p_group = _prefix(by_group, ["source", "top"], "group", "words", "p1").select("source", "top", "group", "p1")
    p_slice = _prefix(by_slice, ["source", "top", "group"], "slice", "words", "p0").select("source", "top", "group", "slice", "p0")
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) if c == "source" else a[c] == b[c] for c in cols]
    ps = p_slice.join(p_group, same(p_slice, p_group, "source", "top", "group")).select(p_slice["source"], p_slice["top"], p_slice["slice"], (F.col("p0") + F.col("p1")).alias("p"))
    ps = cut(ps.join(p_top, same(ps, p_top, "source", "top")).select(ps["source"].alias("of"), ps["slice"].alias("at"), (F.col("p") + F.col("p2")).alias("slice_before")))
    w = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(w), F.lit(0)))
    d = d.join(ps, d["source"].eqNullSafe(ps["of"]) & (d["slice"] == ps["at"]))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target") - full * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("slice_before") + F.col("inside"))))
    out = d.withColumn("taken", (full * F.col("size") + part).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("long").alias("epochs"))
