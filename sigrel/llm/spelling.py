"""Spelling variants: words one edit apart, found by PartEnum signatures of their letter multisets.

A word is the set of its letters, the k-th occurrence of a letter being an element of its own, that is, a binary vector.
One inserted or deleted code point changes one element, one replaced code point two, so words one edit apart have vectors
at a Hamming distance of at most two. Letters, with all their occurrences, are dealt into parts. Vectors that differ in k
places differ in at most k parts, so they agree in some choice of all parts but k: the signatures of a word are its
elements in each such choice. An equi-join on signatures meets every near pair; each pair that it meets is checked.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables

#: A word is a maximal run of ASCII letters and the letters of the Latin-1 block.
LETTERS = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters in the order in which they are dealt to parts.
ALPHABET = _LOWER + _UPPER + "".join(map(chr, range(0xC0, 0x100)))


def corpus_words(docs: DataFrame, min_chars: int = 6, min_count: int = 5, damaged: int = 0) -> DataFrame:
    """(word, n): lower-cased (A-Z only) words of all texts with ``min_chars`` code points that occur ``min_count`` times.

    With ``damaged`` > 0, a run loses its code point h % length where ``damaged`` divides h, the crc32 of
    ``<doc_id>:<run>``: a reproducible source of misspellings. A null doc_id counts as empty there. Null and empty texts
    have no words, repeated rows count each time, other columns are ignored, an empty table gives an empty one. Words are
    counted before they are shuffled, so a word that holds a third of all rows is a few rows to its task.
    """
    text = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"({LETTERS})"), F.lit(1))).alias("word"))
    runs = runs.where(F.length("word") >= min_chars)
    if damaged:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        runs = runs.withColumn("h", h).withColumn("at", (F.col("h") % F.length("word")).cast("int"))
        less = F.concat(F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 2, F.length("word")))
        runs = runs.select(F.when(F.col("h") % damaged == 0, less).otherwise(F.col("word")).alias("word")).where(F.length("word") >= min_chars)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _parts(word: Column, parts: int) -> list[Column]:
    """The letters of each part in a word, sorted: equal where two words have the same elements in it."""
    own = ["".join(ALPHABET[p::parts]) for p in range(parts)]
    others = [f"[{''.join(own[1:])}]", *(f"[^{x}]" for x in own[1:])]  # letters outside of the alphabet stay in the first part
    return [F.array_join(F.array_sort(F.split(F.regexp_replace(word, x, ""), "")), "") for x in others]


def near_pairs(words: DataFrame, parts: int = 4) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of distinct words (word, n) that one inserted, deleted or replaced code point makes equal.

    Words of one length differ in two elements at most and agree in all but two parts; with lengths L and L + 1 it is one
    element and all but one part. ``a`` is the shorter word, or the smaller of equal lengths. Buckets are also split by
    the first and by the last L // 2 code points, as one edit leaves one of these halves as it is; so a bucket's words
    grow far slower than the vocabulary. A pair may be met in several signatures and is kept once.
    """
    v = Tables(words.sparkSession).put(words.where("word is not null").select("word", "n", F.length("word").alias("len"), F.array(*_parts(F.col("word"), parts)).alias("v")))

    def signed(differ: int, size: Column) -> DataFrame:
        """A row for each choice of parts and each half."""
        choices = combinations(range(parts), parts - differ)
        half = (size / 2).cast("int")
        halves = [F.xxhash64(F.lit(True), F.substring("word", F.lit(1), half)), F.xxhash64(F.lit(False), F.substring("word", F.col("len") - half + 1, half))]
        rows = [F.xxhash64(F.lit(k), F.lit(differ), size, h, *(F.col("v")[p] for p in c)) for k, c in enumerate(choices) for h in halves]
        return v.select("word", "n", "len", F.explode(F.array(*rows)).alias("signature"))

    def met(left: DataFrame, right: DataFrame, more: str) -> DataFrame:
        a, b = (d.select("signature", F.col("word").alias(x), F.col("n").alias(f"n_{x}"), F.col("len").alias(f"len_{x}")) for d, x in ((left, "a"), (right, "b")))
        # Spark takes a table for no larger after an explode, so it might broadcast all rows of all signatures
        return a.join(b.hint("merge"), "signature").where(more).where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")

    same = signed(2, F.col("len"))
    longer = met(signed(1, F.col("len")), signed(1, F.col("len") - 1), "len_b = len_a + 1")
    return met(same, same, "len_a = len_b and a < b").union(longer).distinct()


def spelling_variants(words: DataFrame, ratio: int = 5, parts: int = 4) -> DataFrame:
    """(word, n) with one row a word -> word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n (ties: smallest in code-point order) where that is at least ``ratio`` times the
    word's own n, else null; ``root`` follows forms to the last. Along forms n grows by ``ratio``, so chains are no longer
    than the logarithm of the largest n, and doubling follows them in the logarithm of that. A null word is near nothing.
    All joins are merge joins: these tables grow with the vocabulary, and as files they are far smaller than in memory.
    """
    tables = Tables(words.sparkSession)
    words = tables.put(words)
    pairs = near_pairs(words, parts)
    sides = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).union(pairs.select("b", "n_b", "a", "n_a"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = sides.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    far = F.col("best.less") <= -ratio * F.col("n")
    near = tables.put(near.select("word", "n_near", F.when(far, F.col("best.other")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n")))
    roots = tables.put(near.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("up"))
        on = tables.put(roots.join(up.hint("merge"), "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        tables.drop(roots)
        roots = on
        if on.where("moved").isEmpty():
            break
    out = words.join(near.hint("merge"), "word", "left").join(roots.select("word", "root").hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
