"""Numbers for the words of a batch, so that what depends on a word only is worked out once for each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import encoded

#: Words kept between batches; beyond it the table starts anew (values depend on the word only, so nothing changes).
KEPT = 300_000


class Vocabulary(dict):
    """word bytes -> place in ``values``, an array that ``work`` makes for the words not seen before."""

    def __init__(self, work: Callable[[list[bytes]], np.ndarray], lower: bool = False):
        super().__init__()
        self.work, self.lower, self.new, self.values = work, lower, [], None

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n

    def batch(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Values of all words of all texts one after the other, and where each text's words start (and the end)."""
        if len(self) > KEPT:
            self.clear()
            self.values = None
        ids, starts = [], [0]
        for text in texts:
            words = encoded(text.lower() if self.lower else text).split() if text else []
            ids.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
            starts.append(starts[-1] + len(words))
        if self.new:
            made = self.work(self.new)
            self.values = made if self.values is None else np.concatenate([self.values, made])
            self.new = []
        all_ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
        if self.values is None:
            self.values = self.work([b"x"])[:0]
        return self.values[all_ids], np.array(starts)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values`` between two starts, 0 for empty runs."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def ngram_buckets(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of <word>, and the whole word: buckets in word order, and where each word's start."""
    text = "".join("\x02" + w.decode("utf-8", "surrogatepass") + "\x03" for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.cumsum(c == 2) - 1
    parts, owners = [], []
    with np.errstate(over="ignore"):
        for n in sizes:
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ c[k : len(c) - n + 1 + k]) * np.uint64(0x100000001B3)
                h ^= h >> np.uint64(23)
            inside = word[: len(h)] == word[n - 1 :]
            parts.append(h[inside] % np.uint64(buckets))
            owners.append(word[: len(h)][inside])
        starts = np.flatnonzero(c == 2)
        place = np.arange(len(c)) - starts[word]
        whole = np.add.reduceat((c + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), starts)
        parts.append((whole ^ (whole >> np.uint64(31))) % np.uint64(buckets))
        owners.append(np.arange(len(starts)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(words))
    return np.concatenate(parts)[order].astype(np.int64), np.concatenate([[0], np.cumsum(counts)])
