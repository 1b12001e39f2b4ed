"""Benchmark decontamination: latent semantic retrieval of passages, then common-subsequence and answer checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded

#: Words of a block; passages are runs of whole blocks, and the next one starts a block later.
BLOCK = 16
#: Blocks of a passage, by the longest item piece it is compared with: it holds the piece wherever that starts.
PASSAGES = {2: 16, 3: 32, 4: 48, 5: 64, 6: 80}
#: A candidate passage has this share of its item in the latent space, whatever else it says.
HELD = 0.45
PIECE = 80
#: So many of a piece's rarest words stay in the space, however common they are.
RAREST = 8
#: White space and marks part words; A-Z are folded to lower case.
_MARKS = b"\"'`.,;:!?()[]{}<>#*$%&|"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c in _MARKS else c for c in range(256))


def item_words(text: str | None) -> list[bytes]:
    return encoded(text or "").translate(_FOLD).split()


def answer_words(text: str | None) -> list[bytes]:
    """What answers an item: its last line if it has several, else its last sentence; at most its last 8 words."""
    parts = [p for p in re.split(r"\n+|(?<=[.!?])\s+", (text or "").strip()) if p]
    return item_words(parts[-1])[-8:] if parts else []


@dataclass
class Space:
    """The latent space of the whole benchmark. ``basis`` (words, k) holds right singular vectors of the passages' TF-IDF."""

    words: dict[bytes, int]
    idf: np.ndarray
    basis: np.ndarray
    singular: np.ndarray


@dataclass
class Items:
    """Benchmark items, or some of them, in the latent space."""

    pieces: list[tuple[int, list[bytes], list[bytes]]]  # item, words, answer
    vectors: dict[int, np.ndarray] = field(default_factory=dict)  # blocks of a passage -> (pieces, k)
    which: dict[int, np.ndarray] = field(default_factory=dict)
    lengths: dict[int, np.ndarray] = field(default_factory=dict)

    def masks(self, words: dict[bytes, int]) -> list[tuple[dict, dict, set[int]]]:
        """Of each piece: places of its words and of its answer's as bit masks, and the numbers of its rarer words."""
        return [(_masks(w), _masks(a), {words[v] for v in w if v in words}) for _, w, a in self.pieces]


def _token_blocks(texts, words: dict[bytes, int], gap: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary words of all texts: their numbers and blocks, and the first block of each text (and the end).

    Between the blocks of two texts there are ``gap`` empty ones.
    """
    ids, block, first = [], [], [0]
    for text in texts:
        w = item_words(text)
        x = np.fromiter(map(words.get, w, repeat(-1)), np.int64, len(w))
        known = np.flatnonzero(x >= 0)
        ids.append(x[known])
        block.append(known // BLOCK + first[-1])
        first.append(first[-1] - (-len(w) // BLOCK) + gap)
    return np.concatenate(ids), np.concatenate(block), np.array(first)


def item_pairs(pieces: list[tuple[int, list[bytes], list[bytes]]], words: dict[bytes, int]) -> np.ndarray:
    """Codes of all pairs of words that stand one or two places apart in a piece, sorted."""
    n = len(words) + 1
    codes = {((words[a] + 1) * n + words[b] + 1) * 2 + d - 1 for _, w, _ in pieces for d in (1, 2) for a, b in zip(w, w[d:])}
    return np.array(sorted(codes), np.int64)


def _own_blocks(texts, words: dict[bytes, int], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Vocabulary words of all texts but those that stand in a pair of an item, their blocks, and the number of blocks.

    Words of a leak tell how often it was copied, not how common they are: neither copies of a document that holds an
    item nor an item put into many documents make its words common.
    """
    parts, blocks, total = [], [], 0
    for text in texts:
        w = item_words(text)
        parts += [np.fromiter(map(words.get, w, repeat(-1)), np.int64, len(w)), np.full(2, -1)]
        blocks += [np.arange(len(w)) // BLOCK + total, np.full(2, -1)]
        total -= -len(w) // BLOCK
    x, block = np.concatenate(parts), np.concatenate(blocks)
    own = x >= 0
    for d in (1, 2):
        at = np.flatnonzero((x[:-d] >= 0) & (x[d:] >= 0))
        code = ((x[at] + 1) * (len(words) + 1) + x[at + d] + 1) * 2 + d - 1
        place = np.searchsorted(pairs, code)
        at = at[pairs[np.minimum(place, len(pairs) - 1)] == code] if len(pairs) else at[:0]
        own[at] = own[at + d] = False
    return x[own], block[own], total


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text")).where("text is not null")


def document_frequencies(docs: DataFrame, words: dict[bytes, int], pairs: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many blocks of all texts each vocabulary word occurs outside items' pairs, and the number of blocks."""
    shared = docs.sparkSession.sparkContext.broadcast((words, pairs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, pairs = shared.value
        n, total = np.zeros(len(words) + 1, np.int64), 0
        for b in batches:
            ids, block, blocks = _own_blocks(b["text"].array, words, pairs)
            pair = np.unique(block * (len(n) - 1) + ids)
            n[:-1] += np.bincount(pair % (len(n) - 1), minlength=len(n) - 1)
            total += blocks
        n[-1] = total
        at = np.flatnonzero(n)
        yield pd.DataFrame({"word": at, "n": n[at]})

    got = _texts(docs).mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(words) + 1, np.int64)
    for r in got:
        out[r["word"]] = r["n"]
    return out[:-1], int(out[-1])


def _omega(n: int, k: int) -> np.ndarray:
    return np.random.default_rng(11).normal(size=(n, k)).astype(np.float32)


def sketch(docs: DataFrame, words: dict[bytes, int], pairs: np.ndarray, kept: np.ndarray, idf: np.ndarray, k: int) -> np.ndarray:
    """(A'A) Omega for the TF-IDF matrix A of all blocks and a random Omega: each task adds up its own, Spark sums them.

    The columns of A are the words numbered ``kept``; words in items' pairs are not in A.
    """
    shared = docs.sparkSession.sparkContext.broadcast((words, pairs, kept, idf.astype(np.float32)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, pairs, kept, idf = shared.value
        omega = _omega(len(kept), k)
        g = np.zeros((len(kept), k))
        column = np.full(len(words), -1)
        column[kept] = np.arange(len(kept))
        for b in batches:
            ids, block, _ = _own_blocks(b["text"].array, words, pairs)
            ids = column[ids]
            ids, block = ids[ids >= 0], block[ids >= 0]
            if not len(ids):
                continue
            weight = idf[ids]
            where = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            y = np.add.reduceat(omega[ids] * weight[:, None], where)  # rows of A Omega
            row = np.cumsum(np.r_[False, block[1:] != block[:-1]])
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            at = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            g[ids[at]] += np.add.reduceat(y[row[order]] * weight[order][:, None], at)
        used = np.flatnonzero(g.any(1))
        if len(used):
            yield pd.DataFrame({"word": used, "g": list(g[used])})

    made = _texts(docs).mapInPandas(run, "word long, g array<double>")
    total = made.groupBy("word").agg(*[F.sum(F.col("g")[i]).alias(f"g{i}") for i in range(k)]).collect()
    out = np.zeros((len(kept), k))
    for r in total:
        out[r["word"]] = r[1:]
    return out


def add_pieces(g: np.ndarray, pieces: list[list[int]], idf: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """G with each piece (its columns) as a row of A too, weighted so that pieces and texts have equal parts in A'A.

    Words that no text has outside items' pairs would have no place in the space without them.
    """
    more, size = np.zeros_like(g), 0.0
    for x in map(np.array, pieces):
        if len(x):
            np.add.at(more, x, idf[x, None] * (omega[x] * idf[x, None]).sum(0))
            size += float((np.bincount(x)[np.unique(x)] ** 2 * idf[np.unique(x)] ** 2).sum())
    texts = float((omega * g).sum()) / omega.shape[1]  # the trace of A'A, estimated
    return g + max(1.0, texts / max(size, 1e-9)) * more


def right_singular(g: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and values of A from G = (A'A) Omega by the Nystroem formula: no second pass is needed."""
    shift = max(1e-9, 1e-9 * np.linalg.norm(g))
    y = g + shift * omega
    b = omega.T @ y
    w, q = np.linalg.eigh((b + b.T) / 2)
    good = w > 1e-12 * max(1e-300, w.max(initial=0))
    u, s, _ = np.linalg.svd((y @ q[:, good]) / np.sqrt(w[good]), full_matrices=False)
    return u, np.sqrt(np.maximum(s**2 - shift, 0))


def build_space(docs: DataFrame, benchmark: DataFrame, k: int = 64, common: float = 0.001) -> tuple[Space, list[tuple[int, list[bytes], list[bytes]]]] | None:
    """Collect the benchmark (its size is the operator's bound), count its words over all texts and find the space.

    Words found in more than ``common`` of all blocks tell nothing and are left out of the space, but each piece's
    ``RAREST`` rarest words stay. Occurrences in an item's pairs are not counted. The space is fitted on texts and
    pieces alike, and is one for all items, however many shards search them. Each remaining latent dimension is divided by its singular value, so that no topic that all texts
    share outweighs the others.
    """
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null").distinct().orderBy("item_id", "text").collect()
    pieces = []
    for item, text in rows:
        w = item_words(text)
        for i in range(0, len(w), PIECE):
            part = w[i : i + PIECE] if len(w) - i >= 8 or i == 0 else w[-8:]
            pieces.append((item, part, answer_words(text) if len(w) <= PIECE else []))
    words = {x: i for i, x in enumerate(sorted({x for _, w, _ in pieces for x in w}))}
    if not words:
        return None
    pairs = item_pairs(pieces, words)
    df, blocks = document_frequencies(docs, words, pairs)
    rarest = {i for _, w, _ in pieces for i in sorted({words[x] for x in w}, key=lambda i: (df[i], i))[:RAREST]}
    rare = df <= max(common * blocks, 1)
    columns = np.array([i for i in range(len(words)) if rare[i] or i in rarest or not rare.any()])
    df = df[columns]
    idf = np.log((1 + blocks) / (1 + df)).astype(np.float64) + 1e-3
    k = min(k, len(columns))
    g, omega = sketch(docs, words, pairs, columns, idf, k), _omega(len(columns), k).astype(np.float64)
    names = list(words)
    words = {names[i]: c for c, i in enumerate(columns)}
    u, s = right_singular(add_pieces(g, [[words[x] for x in w if x in words] for _, w, _ in pieces], idf, omega), omega)
    kept = s > 1e-6 * s.max(initial=0) if s.any() else np.ones(len(s), bool)
    basis = (u[:, kept] / np.maximum(s[kept], 1e-12)) * (np.median(s[kept]) if s.any() else 1)
    return Space(words, idf.astype(np.float32), (basis * idf[:, None]).astype(np.float32), s[kept]), pieces


def place_items(space: Space, pieces: list[tuple[int, list[bytes], list[bytes]]]) -> Items:
    """Unit vectors of pieces in the space, by the length of the passages they are compared with."""
    items, basis = Items(pieces), space.basis
    vectors = np.array([sum((basis[space.words[x]] for x in w if x in space.words), np.zeros(basis.shape[1])) for _, w, _ in pieces])
    lengths = np.linalg.norm(vectors, axis=1)
    vectors = (vectors / np.maximum(lengths[:, None], 1e-9)).astype(np.float32)
    longest = 0
    for n, most in PASSAGES.items():
        at = np.array([i for i, (_, w, _) in enumerate(pieces) if longest < len(w) <= most], np.int64)
        items.vectors[n], items.which[n], items.lengths[n] = vectors[at], at, lengths[at].astype(np.float32)
        longest = most
    return items


def shards_of(pieces: list[tuple[int, list[bytes], list[bytes]]], most: int) -> Iterator[list[tuple[int, list[bytes], list[bytes]]]]:
    """Runs of pieces with at most ``most`` words in all, or one piece."""
    part, n = [], 0
    for piece in pieces:
        if part and n + len(piece[1]) > most:
            yield part
            part, n = [], 0
        part.append(piece)
        n += len(piece[1])
    if part:
        yield part


def common_subsequence(masks: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence of ``words`` and a piece of n words given as bit masks of places."""
    v = full = (1 << n) - 1
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


#: Words of the items that go to a task at once, and code points of the texts that are searched together.
SHARD_WORDS, TEXT_POINTS = 1_000_000, 1_000_000


def _masks(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def search(texts: list[str | None], space: Space, x: Items, masks: list, cosine: float, share: float, answer: float, sure: float) -> list[list[int]]:
    """Items that each text holds."""
    gap = max(PASSAGES)
    ids, block, first = _token_blocks(texts, space.words, gap)
    n, k = int(first[-1]), space.basis.shape[1]
    vec = np.zeros((n + gap, k), np.float32)
    if len(ids):
        at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        vec[block[at]] = np.add.reduceat(space.basis[ids], at)
    found: list[set[int]] = [set() for _ in texts]
    split: dict[int, list[bytes]] = {}
    numbers = ids.tolist()
    # texts lie apart by empty blocks, so a passage's sum is that of shifted tables and never reaches another text
    sums, have = {1: vec}, 1
    for size in sorted(x.vectors):
        while have < size:
            step = min(have, size - have)
            part = sums[step] if step in sums else sums[1]
            step = step if step in sums else 1
            more = sums[have].copy()
            more[: len(more) - have] += part[have:]
            have += step
            sums[have] = more
        s, items = sums[size], x.vectors[size]
        if not len(items) or not n:
            continue
        least = cosine * np.sqrt(np.einsum("ij,ij->i", s, s))
        some = np.flatnonzero(least > 0)
        for lo in range(0, len(some), 20000):
            rows = some[lo : lo + 20000]
            dots = s[rows] @ items.T
            close = (dots >= least[rows, None]) & (dots >= HELD * x.lengths[size])
            at, which = np.nonzero(close)
            starts = rows[at]
            ends = np.searchsorted(block, starts + size)
            begins, docs_of = np.searchsorted(block, starts), np.searchsorted(first, starts, "right") - 1
            for start, q, d, lo_id, hi_id in zip(starts.tolist(), which.tolist(), docs_of.tolist(), begins.tolist(), ends.tolist()):
                piece = int(x.which[size][q])
                item, words, ans = x.pieces[piece]
                mask, ans_mask, rare = masks[piece]
                # of the item's rarer words at least as many as one of its parts would have
                if item in found[d] or len(rare.intersection(numbers[lo_id:hi_id])) < share * share * len(rare):
                    continue
                if d not in split:
                    split[d] = item_words(texts[d])
                begin = (start - int(first[d])) * BLOCK
                here = split[d][max(0, begin - BLOCK) : begin + (size + 1) * BLOCK]
                got = common_subsequence(mask, len(words), here)
                if got >= sure * len(words) or got >= share * len(words) and (not ans or common_subsequence(ans_mask, len(ans), here) >= answer * len(ans)):
                    found[d].add(item)
    return [sorted(f) for f in found]


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.4, share: float = 0.5, answer: float = 0.5, sure: float = 0.8, k: int = 64, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The columns of ``docs`` with leaked_items: array of item ids whose text the row's whole text holds, maybe reworded.

    Passages are runs of 16-word blocks, of 2 to 6 blocks by the item's length, starting at every block. Those with a
    latent ``cosine`` or more to an item and ``HELD`` of its length along it are candidates; a candidate counts when the longest common subsequence has
    ``share`` of the item's words and ``answer`` of its answer's words, or ``sure`` of all its words. Items of more
    than 80 words are searched piece by piece. Marks around words and case are ignored.

    Null and empty texts leak nothing; null or empty items are never found; each row is handled by itself, repeated
    rows alike, of any length; extra columns pass through under any name (leaked_items is replaced); empty tables give
    empty or unflagged results. The space is one for the whole benchmark; of its pieces, those of
    ``shard_words`` words go to a task at once, each lot searched by itself, which changes no result.
    """
    given = [c for c in docs.columns if c != "leaked_items"]
    out, found = docs.select(F.struct(*given).alias("it"), F.col("text").cast("string").alias("text")), []
    made = build_space(docs, benchmark, k)
    if made is not None:
        context = docs.sparkSession.sparkContext
        space = context.broadcast(made[0])
        for n, pieces in enumerate(shards_of(made[1], shard_words)):
            items = context.broadcast(place_items(made[0], pieces))
            out = out.withColumn(f"found{n}", _searcher(space, items, cosine, share, answer, sure)(F.col("text")))
            found.append(f"found{n}")
    leaked = F.array_sort(F.array_distinct(F.flatten(F.array(*found)))) if found else F.array()
    return out.select(*[F.col("it").getField(c).alias(c) for c in given], leaked.cast("array<long>").alias("leaked_items"))


def _lots(texts: list[str | None], most: int) -> Iterator[list[str | None]]:
    """The texts in runs of ``most`` code points about, so that what a search holds doesn't grow with a batch's texts."""
    lot, n = [], 0
    for t in texts:
        if lot and n + len(t or "") > most:
            yield lot
            lot, n = [], 0
        lot.append(t)
        n += len(t or "")
    if lot:
        yield lot


def _searcher(space, items, cosine: float, share: float, answer: float, sure: float):
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        masks = items.value.masks(space.value.words)
        for texts in batches:
            yield pd.Series([f for lot in _lots(list(texts.array), TEXT_POINTS) for f in search(lot, space.value, items.value, masks, cosine, share, answer, sure)])

    return F.pandas_udf(leaks, "array<long>", F.PandasUDFType.SCALAR_ITER)
