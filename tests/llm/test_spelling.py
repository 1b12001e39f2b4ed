"""Spelling variants against brute force over all pairs, with chains, ties, letters outside ASCII and odd rows."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F
from test_llm import docs, odd

from sigrel.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(n, ratio=5):
    by = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(by[w]), n[form[w]] if w in form else None) for w in n}


def counted(rows, damaged, least_chars, least_n):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOW)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damaged and h % damaged == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += len(run) >= least_chars
    return {w: k for w, k in n.items() if k >= least_n}


def as_dict(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_corpus_words_and_variants(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abenrstéà") for _ in range(rng.randrange(5, 10))) for _ in range(60)] + ["ÉTÉx×yz", "aaaaaa", "aaaaaaa", "bbaaaab"]
    rows = [(i, " ".join((w if rng.random() < 0.9 else w[:3] + rng.choice("xyz") + w[4:]).upper() if w.isascii() and i % 3 else w for w in rng.choices(base, k=80)) + "1's-ābcdefg") for i in range(120)]
    rows += [(5, rows[5][1]), (None, rows[7][1]), (300, None), (301, ""), (302, "aaaaaaaa " * 20000)]
    d = docs(spark, [t for _, t in rows], ids=[i for i, _ in rows]).withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    for damaged in (0, 7):
        words = spelling.corpus_words(d, 6, 3, damaged)
        want = counted(rows, damaged, 6, 3)
        assert {r["word"]: r["n"] for r in words.collect()} == want and len(want) > 50
        for parts in (3, 4):
            assert as_dict(spelling.spelling_variants(words, 5, parts)) == brute(want)


def test_every_kind_of_edit_is_met(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randrange(6, 9))) for _ in range(500)} | {"中文xyzab", "中xyzab", "中文xyzac", "A\U0001f600bcdef", "Abcdef"}
    n = {w: rng.choice((5, 5, 25, 130, 700)) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert as_dict(spelling.spelling_variants(df)) == brute(n)
    assert {(r["a"], r["b"]) for r in spelling.near_pairs(df).collect()} == {(a, b) for a in words for b in words if near(a, b) and (len(a), a) < (len(b), b)}


def test_chains_ties_and_no_words(spark):
    chain = ["abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg", "akjihg", "lkjihg"]
    n = {w: 5 ** (k + 1) for k, w in enumerate(chain)} | {"zzzzzza": 100, "zzzzzzb": 100, "zzzzzz": 20, "zzzzzzc": 21}
    got = as_dict(spelling.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute(n) and got["abcdef"][1] == chain[-1] and got["zzzzzz"][0] == "zzzzzza" and got["zzzzzzc"][0] is None
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert spelling.corpus_words(docs(spark, [])).count() == 0
    assert {r["word"]: r["n"] for r in spelling.corpus_words(odd(spark), 4, 1).collect()} == {"word": 20000, "three": 1, "four": 1, "five": 1}


def test_no_table_of_words_is_broadcast(spark):
    """A file of words is small enough for a broadcast long before its rows for each signature are."""
    words = spark.createDataFrame([("banana", 50), ("bananas", 5), ("canana", 1)], "word string, n long")
    for df in (spelling.near_pairs(words), spelling.spelling_variants(words)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
