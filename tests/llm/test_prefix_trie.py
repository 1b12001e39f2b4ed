"""The prefix trie against a plain one, with all block sizes, ties, nulls, copies and conversations without turns."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from sigrel.llm import prefix_trie as pt

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows, every=20, heads=4):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    order = lambda x: (x[:3], hashlib.sha256(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()[:16])
    convs = {c: [x[2:] for x in sorted(t, key=order)] for c, t in convs.items()}
    if every:
        h = {c: zlib.crc32(str(c).encode()) % heads for c in convs}
        convs = {c: convs.get(c - c % every, [])[: h[c]] + t[h[c] :] for c, t in convs.items()}
    members = {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        childless = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(node))))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].split()) for x in below if x)
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), sum(len(x) == len(node) + 1 for x in below), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(rng, n):
    """Copies, prefixes of others, shared first turns, and a few of their own."""
    rows, base = [], [[(rng.choice(("user", "assistant")), f"w{rng.randrange(3)} x y"[: rng.randrange(1, 7)]) for _ in range(rng.randrange(1, 11))] for _ in range(6)]
    for c in range(n):
        t = list(rng.choice(base)[: rng.randrange(1, 12)])
        if rng.random() < 0.5:
            t[rng.randrange(len(t)) :] = [("user", f"own {rng.randrange(4)}")] * rng.randrange(1, 5)
        rows += [(c, k, *x) for k, x in enumerate(t)]
    return rows


def tree(spark, rows, every=20, block=4, n=1 << 20):
    turns = pt.hashed_turns(spark.createDataFrame(rows, TURNS).withColumn("k", F.lit(1)).withColumn("pos", F.lit("x")), n)
    df = pt.prefix_trie(pt.branched(turns, every) if every else turns, turns, block, n)
    return sorted(map(tuple, df.collect()), key=str)


def test_trie(spark):
    rng = random.Random(6)
    rows = made(rng, 90)
    assert tree(spark, rows) == brute(rows)
    for block, n in ((1, 1 << 20), (3, 40), (16, 1 << 20)):
        assert tree(spark, rows, 0, block, n) == brute(rows, 0)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(pt.ends_digests, "__defaults__", (3,))
    rows = [(20, 0, "user", "a"), (21, 0, "user", "a b"), (21, 1, None, None), (21, 1, None, None), (23, None, "", ""), (23, 0, "user", "c\n:1"), (23, 5, "user", ""), (None, 0, "user", "gone"), (64, 2, "u", "same turn"), (64, 2, "t", "same turn"), (64, 2, "t", "word " * 5000)]
    rows += [(c, k, "r", "copy " * 3) for c in range(100, 140) for k in range(2)]
    rows += [(45, 0, "x", "only a few turns"), (47, 0, "x", "only a few turns")]
    assert tree(spark, rows) == brute(rows)
    lone = tree(spark, [(5, 0, "user", "gone by the branch"), (7, 0, "user", "x")])  # crc32 of 5 and 7 leaves turns to a missing 0
    assert lone == brute([(5, 0, "user", "gone by the branch"), (7, 0, "user", "x")])
    assert tree(spark, []) == []
