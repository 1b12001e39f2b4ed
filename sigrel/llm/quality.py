"""Quality rules: figures of each text, and lines that too many documents of one host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, encoded, mix

_SPACE = bytes([32, *range(9, 14)])
_SYMBOLS = b"#*$%&|<>"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_A = np.uint64(0x9E3779B97F4A7C15)


def _repeated_words(h: np.ndarray) -> int:
    """Words inside a 3-word window that occurs at least twice in the text."""
    if len(h) < 4:
        return 0
    with np.errstate(over="ignore"):
        w = mix(mix(mix(h[:-2]) * _A + h[1:-1]) * _A + h[2:])
    _, back, n = np.unique(w, return_inverse=True, return_counts=True)
    twice = n[back] > 1
    inside = np.zeros(len(h), bool)
    for i in range(3):
        inside[i : len(h) - 2 + i] |= twice
    return int(inside.sum())


def text_figures(docs: DataFrame, host: str = "source") -> DataFrame:
    """Figures of each whole text, and its distinct normalised lines with their hash and all the words they hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            rows = []
            for text in batch["text"].array:
                b = encoded(text) if text else b""
                h = words.of(b.split())
                seen, dup, lines = set(), 0, {}
                for line in b.split(b"\n"):
                    w = line.split()
                    if not w:
                        continue
                    dup += line in seen
                    seen.add(line)
                    k = xxhash.xxh3_64_intdigest(b" ".join(w).translate(_LOWER)) - (1 << 63)
                    lines[k] = lines.get(k, 0) + len(w)
                blank = len(b) - len(b.translate(None, _SPACE))
                rows.append((len(h), len(text or "") - blank, len(b) - len(b.translate(None, _SYMBOLS)), dup, _repeated_words(h), list(lines), list(lines.values())))
            out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "hashes", "line_words"])
            out.insert(0, "host", batch["host"].array)
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    d = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    return d.mapInPandas(run, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, hashes array<long>, line_words array<int>")


def quality_rules(docs: DataFrame, host: str = "source", min_words: int = 50, max_repeat: float = 0.5, line_docs: int = 5, line_share: float = 0.02, left: float = 0.5) -> DataFrame:
    """A verdict for each row of ``docs``: doc_id, figures, words_left, base_failed, kept.

    A line (its words joined by one space, A-Z in lower case) goes when more than ``line_docs`` distinct documents
    of one host have it and more than ``line_share`` of the host's documents do. A document that keeps less than
    ``left`` of its words is depleted and rejected, as is one with fewer than ``min_words`` words or with more than
    ``max_repeat`` of its words in 3-word windows found twice or more.

    Null and empty texts have figures of 0 and fail; a null host is a host of its own; rows that repeat a doc_id
    count once among a line's documents and get a verdict each (by their number of removed words if equal); rows
    without a doc_id count for no line's documents, but lose its lines too; texts of any length count as a whole; an
    empty table gives an empty one; other columns are ignored.
    """
    f = text_figures(docs, host).withColumn("row", F.monotonically_increasing_id())
    f = cut(f)
    one = f.select("row", "host", "doc_id", F.explode(F.arrays_zip("hashes", "line_words")).alias("l")).select("row", "host", "doc_id", F.col("l.hashes").alias("line"), F.col("l.line_words").alias("words"))
    hosts = f.groupBy("host").agg(F.count_distinct("doc_id").alias("host_docs"))
    shared = one.groupBy("host", "line").agg(F.count_distinct("doc_id").alias("docs")).where(F.col("docs") > line_docs)
    over = shared.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).where(F.col("docs") > line_share * F.col("host_docs"))
    over = over.select("of", F.col("line").alias("gone"))
    removed = one.join(over, F.col("host").eqNullSafe(F.col("of")) & (F.col("line") == F.col("gone"))).groupBy("row").agg(F.sum("words").alias("removed"))
    out = f.join(removed, "row", "left").withColumn("words_left", F.col("n_words") - F.coalesce("removed", F.lit(0)))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words_left", failed.alias("base_failed"), (~failed & (F.col("words_left") >= left * F.col("n_words"))).alias("kept"))
