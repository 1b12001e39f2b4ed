"""Exact Jaccard join of documents on word shingles, heavy and light sets apart, and the groups that its links form."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, WordHashes, encoded, mix, sieve, sifted
from .components import connected_components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: What one list entry costs against one enumerated subset: lists need a second stage and a verification.
LIST_COST = 4
#: Pairs between groups that may be formed at once, for each list entry left; beyond it another round of hubs runs.
PAIRS_PER_ENTRY = 16
#: Members of a list that are compared with all others in the first round; twice as many in each later one, so that
#: a list whose members don't link is through after few rounds.
HUBS = 6
#: Rarest shingles of a set that tell whether a pair has met in an earlier list already.
EARLY = 48


class Threshold:
    """Jaccard similarity of ``percent`` / 100 or more, in whole numbers; sizes are counts of distinct shingles."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be from 50 to 100")
        self.percent = percent

    def missing(self, size: int) -> int:
        """Elements of a set of this size that a linked partner can lack."""
        return size * (100 - self.percent) // 100

    def apart(self, size: int) -> int:
        """Elements in one set only, over pairs whose smaller set has at most this size."""
        return size * (100 - self.percent) // self.percent

    def levels(self, upto: int) -> list[int]:
        """Starts of size classes: a set's partners lie in its own class or a neighbouring one."""
        starts = [1]
        while starts[-1] <= upto:
            starts.append(starts[-1] * 100 // self.percent + 1)
        return starts

    def parts(self, below: int) -> tuple[int, int]:
        """For pairs whose smaller set has fewer than ``below`` elements: parts to deal the sets into, spare parts.

        A linked pair differs in at most parts - 1 - spare of them, so it agrees in 1 + spare at least.
        """
        d = self.apart(below - 1)
        spare = max(2, d // 8)
        return d + 1 + spare, spare

    def subsets(self, size: int) -> int:
        return sum(comb(size, k) for k in range(self.missing(size) + 1))

    def boundary(self) -> int:
        """Largest size for which enumerating all subsets a partner can share costs no more than list entries do."""
        best = 0
        for size in range(1, 64):
            starts = self.levels(size)
            if self.subsets(size) <= LIST_COST * (self.parts(starts[-1])[0] + self.parts(starts[-2])[0]):
                best = size
            else:
                break
        return best


def shingle_hashes(text: str | None, n: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles of the whole text, A-Z in lower case; fewer words give one shingle."""
    if not text:
        return np.empty(0, np.uint64)
    h = words.of(encoded(text).translate(_LOWER).split())
    if not len(h):
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        k = min(n, len(h))
        acc = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            acc = mix(acc * _A + h[i : len(h) - k + 1 + i])
    return np.unique(acc)


def _part_keys(tokens: np.ndarray, level: int, parts: int) -> tuple[np.ndarray, int]:
    """A key for each part that has elements, equal when two sets agree in that part; the number of empty parts."""
    which = ((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # sorted, as tokens are
    starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(mix(tokens * _B), starts)
        keys = mix(sums + mix(which[starts].astype(np.uint64) + np.uint64(level) * _A))
    return keys, parts - len(starts)


def _signatures(tokens: np.ndarray, t: Threshold, boundary: int) -> tuple[list, list, list, list]:
    """Keys of parts, the least number of them that must meet a partner's, keys of subsets and their sizes."""
    size = len(tokens)
    parts, need, subs, sub_sizes = [], [], [], []
    if 0 < size <= boundary:
        for k in range(t.missing(size) + 1):
            for gone in combinations(range(size), k):
                kept = np.delete(tokens, gone)
                subs.append(xxhash.xxh3_64_intdigest(kept.tobytes()) - (1 << 63))
                sub_sizes.append(size - k)
    if size * 100 > boundary * t.percent:
        starts = t.levels(size)
        for level in (len(starts) - 2, len(starts) - 3):
            if level < 0:
                continue
            n, spare = t.parts(starts[level + 1])
            keys, empty = _part_keys(tokens, level, n)
            if empty > spare:  # the parts in which a pair agrees may all be empty ones: one key for such sets of the class
                keys = np.append(keys, mix(np.array([level], np.uint64) * _B + np.uint64(1)))
            parts.append(keys.view(np.int64))
            need.append(1 + spare - empty if empty < spare else 1)
    return parts, need, subs, sub_sizes


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, set_hash, parts (a list of keys for each size class), need, subs,
    sub_sizes; no row is lost."""
    t = Threshold(percent)
    boundary = t.boundary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for b in batches:
            rows = []
            for doc_id, text, key in zip(b["doc_id"].array, b["text"].array, b["text_key"].array):
                tokens = shingle_hashes(text, n, words)
                rows.append((doc_id, key, len(tokens), xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None, *_signatures(tokens, t, boundary)))
            yield pd.DataFrame(rows, columns=["doc_id", "text_key", "n_shingles", "set_hash", "parts", "need", "subs", "sub_sizes"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInPandas(run, "doc_id long, text_key long, n_shingles long, set_hash binary, parts array<array<long>>, need array<int>, subs array<long>, sub_sizes array<int>")


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id and its sorted shingle hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [shingle_hashes(x, n, words).view(np.int64) for x in b["text"].array]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, tokens array<long>")


def _light_links(sigs: DataFrame, percent: int) -> DataFrame:
    """Links of small sets: two sets that share a subset of c elements, and have s and t, meet in c at least.

    Within a subset's list only the smallest set needs linking to each other one: whoever links with any member
    links with it, as a pair links the more easily the smaller its sets are.
    """
    s = sigs.select("doc_id", "n_shingles", F.explode(F.arrays_zip("subs", "sub_sizes")).alias("x"))
    s = s.select("doc_id", "n_shingles", F.col("x.subs").alias("key"), F.col("x.sub_sizes").cast("long").alias("c"))
    hub = s.groupBy("key", "c").agg(F.min(F.struct("n_shingles", "doc_id")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    j = s.join(hub, ["key", "c"]).where(F.col("hub.doc_id") != F.col("doc_id"))
    j = j.where(100 * F.col("c") >= percent * (F.col("n_shingles") + F.col("hub.n_shingles") - F.col("c")))
    return j.select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b"))


def _candidates(sigs: DataFrame, tables: Tables) -> DataFrame:
    """doc_ids of larger sets that agree with others in as many parts as a linked pair must, counted over all others."""
    p = sigs.select("doc_id", F.posexplode(F.arrays_zip("parts", "need"))).select("doc_id", F.col("pos").cast("byte").alias("class"), F.col("col.need").alias("need"), F.explode("col.parts").alias("key"))
    met = tables.put(p.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    hits = p.join(met.hint("shuffle_hash"), "key").groupBy("doc_id", "class").agg(F.count("*").alias("hits"), F.min("need").alias("need"))
    found = tables.put(hits.where("hits >= need").select("doc_id").distinct())
    tables.drop(met)
    return found


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    x = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb")), "b")
    x = x.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta")), "a")
    both = F.size(F.array_intersect("ta", "tb")).cast("long")
    return x.where(100 * both >= percent * (F.size("ta") + F.size("tb") - both)).select("a", "b")


def _entries(sets: DataFrame, percent: int) -> DataFrame:
    """Inverted lists over the rarest shingles of each set: (token, doc_id, s, i), i being the place in its order."""
    one = sets.select("doc_id", F.size("tokens").alias("s"), F.explode("tokens").alias("token"))
    df = one.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    known = one.join(df.hint("shuffle_hash"), "token")
    w = Window.partitionBy("doc_id").orderBy("df", "token")
    shared = Window.partitionBy("doc_id")
    e = known.withColumn("i", F.col("s") - F.count("*").over(shared) + F.row_number().over(w) - 1).where(F.col("i") <= F.floor(F.col("s") * (100 - percent) / 100))
    return e.select("token", "doc_id", F.col("s").cast("long"), F.col("i").cast("long"))


def _heavy_links(docs: DataFrame, candidates: DataFrame, n: int, percent: int, tables: Tables) -> DataFrame:
    """Links of larger sets that connect all that links connect, from inverted lists over each set's rarest shingles.

    Shingles are ordered by rarity (among the candidates; any order is right). Linked sets of s and t elements share
    c = ceil(percent * (s + t) / (100 + percent)) at least, so where they first meet, at places i and j of their
    orders, i <= s - c and j <= t - c. Members of a list that meet this bound with no size in it are dropped. Then,
    round by round, a few members with the fewest rare shingles (the most central of each lot) are compared with all
    others and leave the list, as their links are known; lists whose members are all connected already are done.
    After the first round these members are taken from outside the list's largest group, since a list is through when
    all those are. When few pairs between groups are left, they are compared outright, each in the first list in which
    it meets.
    """
    maybe = sifted(docs, F.col("doc_id"), sieve(candidates, "doc_id")).where("_may").drop("_may")
    text = maybe.join(candidates.hint("shuffle_hash"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    sets = tables.put(sets_of(text, n).where(F.size("tokens") > 0))
    entries = tables.put(_entries(sets, percent))
    labels, links, turn = None, None, 0
    # a linked pair has this many elements in common at least, so each set has no more than the rest before they first meet
    common = lambda s, t: F.ceil((s + t) * percent / (100 + percent))
    # the smallest partner that the list offers, or that any set of s elements can have, leaves the most room
    room = F.col("s") - common(F.col("s"), F.greatest(F.col("least"), F.ceil(F.col("s") * percent / 100)))
    while True:
        if labels is None:
            pick = e = entries.withColumn("component", F.col("doc_id"))
        else:
            e = entries.join(labels.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
            largest = e.groupBy("token", "component").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "component")).alias("largest"))
            pick = e.join(largest, "token").where(F.col("component") != F.col("largest.component")).drop("largest")
        pick = pick.withColumn("lot", F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(HUBS << turn)).cast("int"))
        lots = pick.groupBy("token", "lot").agg(F.min(F.struct("i", "doc_id", "s", "component")).alias("hub"))
        hubs = lots.groupBy("token").agg(F.sort_array(F.collect_list("hub")).alias("hubs"))
        lists = e.groupBy("token").agg(F.min("s").alias("least"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").join(hubs, "token").select("token", "least", "hubs")
        m = tables.put(e.join(lists, "token").where(F.col("i") <= room).select("token", "doc_id", "s", "i", "component", "hubs"))
        tables.drop(entries)
        sizes = m.groupBy("token", "component").agg(F.count("*").alias("k")).groupBy("token").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("same"))
        left = sizes.agg(F.sum("n").alias("entries"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2).alias("pairs")).first()
        if not left["pairs"]:
            break
        last = left["pairs"] <= PAIRS_PER_ENTRY * left["entries"]
        if last:
            early = m.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("i", "token"))), 1, EARLY).alias("early"))
            x = tables.put(m.drop("hubs").join(early.select("doc_id", F.col("early.token").alias("early")), "doc_id"))
            y = x.select("token", "early", F.struct("i", "doc_id", "s", "component").alias("hub"))
            p = x.alias("x").join(y.alias("y"), "token").where(F.col("component") < F.col("hub.component"))
            # a pair that meets in an earlier list is formed there
            p = p.where(F.coalesce(F.get(F.array_intersect("x.early", "y.early"), F.lit(0)), F.col("token")) == F.col("token"))
        else:
            p = m.withColumn("hub", F.explode("hubs")).where(F.col("component") != F.col("hub.component"))
        meet = common(F.col("s"), F.col("hub.s"))
        p = p.where((F.col("i") <= F.col("s") - meet) & (F.col("hub.i") <= F.col("hub.s") - meet) & (F.least("s", "hub.s") * 100 >= F.greatest("s", "hub.s") * percent))
        p = p.select(F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b")).distinct()
        found = tables.put(_verified(p, sets, percent))
        links = found if links is None else links.union(found)
        if last:
            break
        labels = connected_components(links)
        links = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))  # connects the same
        entries = tables.put(m.where(~F.array_contains(F.transform("hubs", lambda h: h["doc_id"]), F.col("doc_id"))).select("token", "doc_id", "s", "i"))
        tables.drop(m)
        turn += 1
    return links


def jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Every row of ``docs`` with the size of its shingle set and its group: doc_id, text_key, n_shingles, component_id.

    Two documents link when 100 * |A and B| >= percent * |A or B| over their sets of distinct n-word shingles; a
    group is what links connect, named by its smallest doc_id. Equal sets are one class, joined by its smallest
    doc_id. Small sets enumerate every subset that a partner can share (light), larger ones meet in inverted lists
    (heavy); sizes where both can meet take part in both, and the boundary is where the costs cross
    (:meth:`Threshold.boundary`). Lists run over sets that pass an exact filter first: dealt by hash into a few more
    parts than a linked pair can differ in, such sets agree in several. Nothing is dropped, capped or sampled.

    Null or empty texts have no shingles and are groups of their own; a text with fewer than n words is one
    shingle; rows with a null doc_id keep a null component_id unless their class has a doc_id; rows that repeat a
    doc_id have each the size and the class of their own text (of two long texts under one doc_id, the greater one's
    links count); long texts are sets like others; an empty table gives an empty one; other columns are ignored.
    text_key is Spark's hash of the text, to tell rows of one doc_id apart.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tables = Tables(docs.sparkSession)
    sigs = tables.put(signatures(docs, n, percent))
    some = sigs.where("set_hash is not null")
    classes = tables.put(some.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    # one row a class; the row of a class of its own needs no shuffle to be found
    copied = tables.put(classes.where("n > 1 and rep is not null").select("set_hash", F.col("rep").alias("doc_id")))
    apart = sifted(some.where("doc_id is not null"), F.col("set_hash"), sieve(copied, "set_hash"))
    maybe = apart.where("_may").join(copied.select("set_hash", F.col("doc_id").alias("rep")).hint("shuffle_hash"), "set_hash", "left")
    # stored, so that the join has a stage of its own, in which Spark can split the rows of one set
    firsts = tables.put(maybe.where("rep is null or rep = doc_id").drop("rep")).dropDuplicates(["set_hash"])
    reps = apart.where("not _may").unionByName(firsts).drop("_may")
    # stored, as its links are found by joining it with itself
    small = tables.put(reps.where(F.size("subs") > 0).select("doc_id", "n_shingles", "subs", "sub_sizes"))
    light = _light_links(small, percent)
    candidates = _candidates(reps, tables)
    heavy = _heavy_links(docs, candidates, n, percent, tables)
    links = light if heavy is None else light.union(heavy)
    groups = connected_components(links)
    tables.drop(small)
    named = classes.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component_id"))
    out = sigs.select("doc_id", "text_key", "n_shingles", "set_hash").join(named, "set_hash", "left")
    return out.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
