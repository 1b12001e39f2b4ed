"""The trie of conversation prefixes, found by digests of blocks of turns and refined only where siblings diverge.

Turns are hashed once, where they are read; nothing after that holds a text. A conversation is cut into blocks of ``block``
turns. A prefix of whole blocks is named by the XOR of hashes of (place, block), so the names of all its prefixes are one
running total over its blocks. Conversations with the same name and the same next block are one group, and what a group
has in common is one path of nodes. Turn by turn the groups that share a prefix are compared only where there are several
of them; elsewhere all nodes of the block have the group's members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigrel.operators.ordered import ROWS, numbered, running

from .common import Tables, n_words

#: Turns of a block.
BLOCK = 4
#: Conversation ids of one node that are joined to one text before the digest runs over such texts.
PIECE = 1 << 16


def hashed_turns(conversations: DataFrame, rows: int = ROWS) -> DataFrame:
    """(conv_id, pos, digest, words): the turns of each conversation from 0 in the order of turn, nulls first.

    Null roles and texts are empty. Equal turns are ordered by role and by the digest of role and text; repeated rows are
    turns of their own. Rows without a conv_id belong to no conversation and go; other columns are ignored. The digest is
    16 bytes of the SHA-256 of the length of the role, the role and the text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), n_words(text).alias("words"))
    return numbered(turns, ["turn", "role", "digest"], "pos", ["conv_id"], rows).select("conv_id", "pos", "digest", "words")


def branched(turns: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Hashed turns in which conversation c begins with the first h turns of c - c % every (all, if it has fewer; none, if
    there is no such one) and goes on with its own after its first h, where h is crc32 of c's digits modulo ``heads``."""
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % heads).cast("long")
    of = turns.select("conv_id").distinct().select("conv_id", (c - c % every).alias("parent"), h.alias("h"))
    first = turns.where(F.col("pos") < heads - 1).select(F.col("conv_id").alias("parent"), "pos", "digest", "words")
    head = of.where("h > 0").join(first, "parent").where("pos < h").select("conv_id", "pos", "digest", "words")
    had = first.groupBy("parent").agg(F.count("*").alias("had"))
    less = of.join(had, "parent", "left").select("conv_id", "h", F.least("h", F.coalesce("had", F.lit(0))).alias("got"))
    own = turns.join(less, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "digest", "words")
    return head.unionByName(own)


def _name(*what: Column) -> list[Column]:
    """Two independent hashes."""
    return [F.xxhash64(F.lit(salt), *what) for salt in (11, 12)]


def _inside(turns: Column, j: Column, k: Column, p: Column, q: Column) -> Column:
    """The name of the prefix that ends at turn j of block k, after the prefix (p, q); its last turn's words."""
    upto = F.concat_ws(",", F.transform(F.slice(turns, F.lit(1), j + 1), lambda t: F.hex(t["digest"])))
    a, b = _name(k, j, upto)
    return F.struct(p.bitwiseXOR(a).alias("p"), q.bitwiseXOR(b).alias("q"), j.alias("j"), F.get(turns, j)["words"].alias("words"))


def prefix_trie(turns: DataFrame, conversations: DataFrame, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """Hashed turns (conv_id, pos, digest, words) and all conv_ids, also those without turns -> a row for each prefix.

    conv_id: smallest member; depth; parent_conv_id: the parent's smallest member (the root: null); n_convs: members;
    n_children; n_leaves: childless nodes below it, itself included; saved_tokens: over it and all below, (members - 1) *
    words of the node's last turn; ends_sha256: digest of the ids of its members that end there, ascending, comma-joined.
    The root is there where there is a conversation; without any the result is empty.

    Sums over subtrees need no walk: a node counts for its smallest member, and what counts for a member other than the
    node's own smallest lies below the node. So a sum is that over all members less the smallest one's, plus the smallest
    one's from the node down.
    """
    tables = Tables(turns.sparkSession)
    ids = tables.put(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct())
    by_turn = turns.groupBy("conv_id", F.floor(F.col("pos") / block).alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))
    last = _inside(F.col("turns"), F.size("turns") - 1, F.col("k"), F.lit(0).cast("long"), F.lit(0).cast("long"))
    named = by_turn.withColumn("own", last).withColumns({"own_p": F.col("own.p"), "own_q": F.col("own.q")}).drop("own")
    xor = lambda a, b: a.bitwiseXOR(b)
    named = running(named, {"end_p": F.col("own_p"), "end_q": F.col("own_q")}, ["k"], ["conv_id"], rows, F.bit_xor, xor)
    # a member's blocks: the name before (p, q) and after (end_p, end_q)
    blocks = tables.put(named.select("conv_id", "k", "turns", "end_p", "end_q", F.col("end_p").bitwiseXOR(F.col("own_p")).alias("p"), F.col("end_q").bitwiseXOR(F.col("own_q")).alias("q")))

    groups = blocks.groupBy("k", "p", "q", "end_p", "end_q").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.any_value("turns").alias("turns"))
    siblings = blocks.groupBy("k", "p", "q").agg(F.min("end_p").alias("low_p"), F.max("end_p").alias("high_p"), F.min("end_q").alias("low_q"), F.max("end_q").alias("high_q"))
    alone = siblings.where("low_p = high_p and low_q = high_q").select("k", "p", "q", F.lit(True).alias("alone"))
    groups = tables.put(groups.join(alone, ["k", "p", "q"], "left").withColumn("alone", F.coalesce("alone", F.lit(False))))

    def refined(g: DataFrame, sums: dict[str, Column], kept: dict[str, Column]) -> DataFrame:
        """A row a node: groups' columns as they are where a block has no sibling, else added up turn by turn."""
        each = F.transform(F.sequence(F.lit(0), F.size("turns") - 1), lambda j: _inside(F.col("turns"), j, F.col("k"), F.col("p"), F.col("q")))
        up = F.transform(each, lambda x: F.struct(x["p"].alias("p"), x["q"].alias("q"), x["j"].alias("j"), x["words"].alias("words"), F.when(x["j"] > 0, F.get(each, x["j"] - 1)["p"]).otherwise(F.col("p")).alias("up_p"), F.when(x["j"] > 0, F.get(each, x["j"] - 1)["q"]).otherwise(F.col("q")).alias("up_q")))
        d = g.select(F.explode(up).alias("x"), "k", "alone", *kept, *sums).select("x.*", (F.col("k") * block + F.col("x.j") + 1).alias("depth"), "alone", *kept, *sums)
        name = ["p", "q", "up_p", "up_q", "depth", "words"]
        shared = d.where("not alone").groupBy(*name).agg(*[f.alias(c) for c, f in (kept | sums).items()])
        return d.where("alone").select(*name, *kept, *sums).unionByName(shared)

    nodes = tables.put(refined(groups, {"n_convs": F.sum("n_convs").alias("n_convs")}, {"conv_id": F.min("conv_id")}))
    inner = nodes.select(F.col("up_p").alias("p"), F.col("up_q").alias("q")).groupBy("p", "q").agg(F.count("*").alias("n_children"))
    nodes = nodes.join(inner, ["p", "q"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    # what a node counts for its smallest member, and the same from the node down along that member's path
    nodes = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    down = running(nodes, {"leaf_down": F.col("leaf"), "saved_down": F.col("saved")}, ["depth"], ["conv_id"], rows, descending=True)
    nodes = tables.put(down.drop("leaf", "saved", "words"))
    own = nodes.groupBy("conv_id").agg(F.max_by("leaf_down", -F.col("depth")).alias("leaf_all"), F.max_by("saved_down", -F.col("depth")).alias("saved_all"))
    own = tables.put(own)
    weighed = blocks.select("conv_id", "k", "p", "q", "end_p", "end_q").join(own, "conv_id").groupBy("k", "p", "q", "end_p", "end_q").agg(F.sum("leaf_all").alias("leaf_sum"), F.sum("saved_all").alias("saved_sum"))
    weighed = groups.drop("n_convs", "conv_id").join(weighed, ["k", "p", "q", "end_p", "end_q"])
    sums = refined(weighed, {c: F.sum(c) for c in ("leaf_sum", "saved_sum")}, {}).select("p", "q", "leaf_sum", "saved_sum")
    below = nodes.join(sums, ["p", "q"]).join(own, "conv_id").withColumns({"n_leaves": F.col("leaf_sum") - F.col("leaf_all") + F.col("leaf_down"), "saved_tokens": F.col("saved_sum") - F.col("saved_all") + F.col("saved_down")})

    # the root: all conversations, a few numbers
    tops = nodes.where("depth = 1").select("p", "q").join(sums, ["p", "q"]).agg(F.count("*").alias("n_children"), F.coalesce(F.sum("leaf_sum"), F.lit(0)).alias("n_leaves"), F.coalesce(F.sum("saved_sum"), F.lit(0)).alias("saved_tokens"))
    n_convs, smallest = ids.agg(F.count("*"), F.min("conv_id")).first()
    n_children, n_leaves, saved = tops.first()
    zero = F.lit(0).cast("long")
    root = turns.sparkSession.range(1 if n_convs else 0).select(F.lit(smallest).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n_convs).cast("long").alias("n_convs"), F.lit(n_children).cast("long").alias("n_children"), F.lit(n_leaves if n_children else 1).cast("long").alias("n_leaves"), F.lit(saved).cast("long").alias("saved_tokens"), zero.alias("p"), zero.alias("q"))

    parents = nodes.where("n_children > 0").select(F.col("p").alias("up_p"), F.col("q").alias("up_q"), F.col("conv_id").alias("parent_conv_id"))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "p", "q"]
    top = below.where("depth = 1").withColumn("parent_conv_id", F.lit(smallest).cast("long"))
    rest = below.where("depth > 1").join(parents, ["up_p", "up_q"])
    out = root.select(*cols).unionByName(top.select(*cols)).unionByName(rest.select(*cols))

    at_end = blocks.groupBy("conv_id").agg(F.max_by(F.struct("end_p", "end_q"), "k").alias("e"))
    ended = ids.join(at_end, "conv_id", "left").select("conv_id", F.coalesce("e.end_p", zero).alias("p"), F.coalesce("e.end_q", zero).alias("q"))
    out = out.join(ends_digests(ended, ["p", "q"]), ["p", "q"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def ends_digests(ended: DataFrame, keys: list[str], piece: int = PIECE) -> DataFrame:
    """(keys, sha256) of the conv_ids of each key, ascending and comma-joined, as lowercase hex.

    A key's ids are joined in pieces of ids that are near in value, each within one task's bounds. A digest has to see
    its bytes in order, so keys of several pieces are read as a sorted stream of pieces, which holds one at a time.
    """
    lots = ended.groupBy(*keys, F.floor(F.col("conv_id") / piece).alias("lot")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    lots = Tables(ended.sparkSession).put(lots)
    many = lots.groupBy(*keys).agg(F.count("*").alias("lots"), F.any_value("ids").alias("ids"))
    one = many.where("lots = 1").select(*keys, F.sha2("ids", 256).alias("sha256"))
    more = lots.join(many.where("lots > 1").select(*keys), keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for b in batches:
            done = []
            for *key, ids in zip(*(b[c] for c in (*keys, "ids"))):
                if key != now:
                    if state:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=[*keys, "sha256"])
        if state:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=[*keys, "sha256"])

    sorted_lots = more.repartition(*keys).sortWithinPartitions(*keys, "lot").select(*keys, "ids")
    return one.unionByName(sorted_lots.mapInPandas(run, ", ".join(f"{k} {ended.schema[k].dataType.simpleString()}" for k in keys) + ", sha256 string"))
