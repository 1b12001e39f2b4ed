"""Line jobs: normalising, filtering, durations in annotated text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.scalar import dedup_spaces, is_comment
from .ordered import ROWS, running

#: Patterns without a literal, and their bytes, that go to every task at once, about.
PATTERNS, PATTERN_BYTES = 10_000, 4 << 20
#: Bytes that a pattern takes besides its own, where patterns are looked up in a task.
PATTERN_ROW = 32
#: Code points of a literal by which patterns and lines meet.
GRAM = 3
#: Bytes of a literal that are looked up, of lines that are looked at together, and of a table of lines and literals.
RUN, LOOK, HELD = 8, 1 << 18, 1 << 24


def expand_tabs(v: Column, width: int = 8) -> Column:
    """Tabs as blanks up to the next stop."""
    parts = F.split(v, "\t")
    step = lambda a, p: F.concat(F.rpad(a, (F.length(a) + width - F.pmod(F.length(a), F.lit(width))).cast("int"), " "), p)
    return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), parts[0], step)


def normalise_lines(lines: DataFrame, comments: bool = False, mark: str = "#", tabs: bool = True, spaces: bool = True, left: bool = True, right: bool = True, fold: bool = False, value: str = "value") -> DataFrame:
    """Drop comment lines (unless ``comments``), then tabs, spaces, right and left blanks, case: in that order."""
    out = lines if comments else lines.where(~is_comment(F.col(value), mark))
    c = F.col(value)
    if tabs:
        c = expand_tabs(c)
    if spaces:
        c = dedup_spaces(c)
    if right:
        c = F.regexp_replace(c, r"\s+$", "")
    if left:
        c = F.regexp_replace(c, r"^\s+", "")
    if fold:
        c = F.lower(c)
    return out.withColumn(value, c)


def read_lines(spark: SparkSession, path: str, **how) -> DataFrame:
    """Lines of text files with file and order: (file, block, line, value), normalised."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    return normalise_lines(text, **how)


def write_lines(lines: DataFrame, path: str, order: tuple[str, ...] = ("file", "block", "line"), **how) -> None:
    """The same normalising before lines are written as text, in order."""
    n = lines.rdd.getNumPartitions()
    normalise_lines(lines, **how).repartitionByRange(max(1, n), *order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def split_lines(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, line, value) of a text column."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "value"))


def required_literals(pattern: str) -> list[str]:
    """Strings that every match of a (Java) regular expression holds; none where that isn't sure.

    Only what stands outside groups and classes counts. Alternatives outside groups, flags, quoted parts and classes
    inside classes are not looked into: such a pattern has no literals.
    """
    if re.search(r"\(\?[^:=!<>]|\\[QEuxcpPNk0-9]", pattern):
        return []
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        literal = None
        if c == "\\" and i < len(pattern):
            c, i = pattern[i], i + 1
            literal = None if c.isalnum() else c
        elif c == "[":
            end = re.compile(r"\[(?!\^?\])(?:\\.|[^\[\]\\])*\]", re.DOTALL).match(pattern, i - 1)
            if not end:
                return []
            i = end.end()
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            return []
        elif c in "?*{":
            run = run[:-1]
            i = pattern.find("}", i) + 1 or len(pattern) if c == "{" else i
        elif c not in "+.^$|":
            literal = c
        if literal is None or depth:
            runs.append(run)
            run = ""
        else:
            run += literal
    return [r for r in [*runs, run] if r]


@F.pandas_udf(ArrayType(StringType()))
def _pattern_grams(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: sorted({r[i : i + GRAM] for r in required_literals(p) for i in range(len(r) - GRAM + 1)}))


def _grams(value: str) -> Column:
    """All runs of GRAM code points, one starting at each place."""
    return F.array_distinct(F.regexp_extract_all(value, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def _runs_in(data: np.ndarray, keys: dict[int, np.ndarray], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places, key numbers) of what ``data`` holds of ``keys``: by size, the sorted integers of so many bytes."""
    marked = {}
    spread = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    for size, own in keys.items():
        marked[size] = np.zeros(1 << bits, bool)
        marked[size][spread(own)] = True
    for start in range(0, len(data), LOOK):
        c = data[start : start + LOOK + RUN - 1].astype(np.uint64)
        run = np.zeros(len(c), np.uint64)
        for size in range(1, max(keys) + 1):
            if len(c) < size:
                break
            run = run[: len(c) - size + 1] | (c[size - 1 :] << np.uint64(8 * (size - 1)))
            if size in keys:
                at = np.flatnonzero(marked[size][spread(run[:LOOK])])
                number = np.minimum(np.searchsorted(keys[size], run[at]), len(keys[size]) - 1)
                same = keys[size][number] == run[at]
                yield size, at[same] + start, number[same]


def _lookup(patterns: list[str]) -> Callable[[pa.Array], pa.Array]:
    """Of each line the patterns all of whose literals of GRAM code points or more it may hold; each pattern has one.

    A literal goes by its first RUN bytes. Patterns stand at the literal that fewest patterns have, and the rest of their
    literals are tried where they are met.
    """
    cut = [sorted({r.encode()[:RUN] for r in required_literals(p) if len(r) >= GRAM}) for p in patterns]
    many = Counter(r for own in cut for r in own)
    keys: dict[int, np.ndarray] = {}
    numbers: dict[bytes, int] = {}
    first = {}
    for size in sorted({len(r) for r in many}):
        own = sorted((int.from_bytes(r, "little"), r) for r in many if len(r) == size)
        keys[size], first[size] = np.array([x for x, _ in own], np.uint64), len(numbers)
        numbers |= {r: len(numbers) + k for k, (_, r) in enumerate(own)}
    bits = max(12, min(20, 4 + len(numbers).bit_length()))
    by = sorted(range(len(patterns)), key=lambda k: numbers[min(cut[k], key=lambda r: (many[r], r))])
    standing = np.array([numbers[min(cut[k], key=lambda r: (many[r], r))] for k in by])
    begin, end = (np.searchsorted(standing, np.arange(len(numbers)), side) for side in ("left", "right"))
    needs = np.full((len(patterns), max(map(len, cut))), len(numbers))  # beyond the last literal: held by each line
    for k, p in enumerate(by):
        needs[k, : len(cut[p])] = [numbers[r] for r in cut[p]]
    names = pa.array([patterns[k] for k in by], pa.string())

    def of(values: pa.Array) -> pa.Array:
        values = values.cast(pa.large_string())
        _, offsets, data = values.buffers()
        offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
        data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        lines, literals = [], []
        for size, at, number in _runs_in(data, keys, bits):
            line = np.searchsorted(offsets, at, "right") - 1
            inside = at + size <= offsets[line + 1]
            lines.append(line[inside])
            literals.append(number[inside] + first[size])
        lines, literals = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lines, literals))
        order = np.argsort(lines, kind="stable")
        lines, literals = lines[order], literals[order]
        found_lines, found = [], []
        step = max(1, HELD // (len(numbers) + 1))
        for start in range(0, len(values), step):
            part = slice(*np.searchsorted(lines, (start, start + step)))
            held = np.zeros((min(step, len(values) - start), len(numbers) + 1), bool)
            held[:, -1] = True
            held[lines[part] - start, literals[part]] = True
            line, literal = np.nonzero(held[:, :-1])
            n = (end - begin)[literal]
            line = np.repeat(line, n)
            pattern = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[literal], n)
            for k in range(needs.shape[1]):
                may = held[line, needs[pattern, k]]
                line, pattern = line[may], pattern[may]
            found_lines.append(line + start)
            found.append(pattern)
        line, pattern = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_lines, found))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(line, np.arange(len(values) + 1)), pa.int32()), names.take(pa.array(pattern)))

    return of


def _matches_any(patterns: list[str], value: str) -> Column:
    """Whether a line matches any of some patterns, which all have grams: never null."""
    if not patterns:
        return F.lit(False)
    of = _lookup(patterns)

    @F.arrow_udf(ArrayType(StringType()))
    def tried(values: pa.Array) -> pa.Array:
        return of(values)

    return F.exists(tried(F.col(value)), lambda p: F.call_function("rlike", F.col(value), p))


def lines_with(lines: DataFrame, patterns: DataFrame, value: str = "value") -> DataFrame:
    """Distinct values of ``lines`` that match any of ``patterns`` (pattern, grams), which all have grams.

    Of a pattern's grams the one that fewest lines hold is its key; lines and patterns meet in an equi-join on it, in
    which a line goes by its hash, and the pattern is tried on what met. A hash of two lines adds tries, not results.
    """
    values = lines.select(F.col(value).alias("value")).where("value is not null").distinct().withColumn("h", F.xxhash64("value"))
    held = values.select("h", F.explode(_grams("value")).alias("gram"))
    asked = patterns.select("pattern", F.explode("grams").alias("gram"))
    counts = held.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    key = asked.join(counts, "gram", "left").na.fill(0, ["n"]).groupBy("pattern").agg(F.min(F.struct("n", "gram")).alias("k"))
    met = held.join(key.where("k.n > 0").select("pattern", F.col("k.gram").alias("gram")), "gram").select("h", "pattern")
    return met.join(values, "h").where(F.expr("value rlike pattern")).select(F.col("value").alias(value)).distinct()


def filter_lines(lines: DataFrame, patterns: list[str] | DataFrame, invert: bool = False, value: str = "value") -> DataFrame:
    """Lines that match none of the patterns, or with ``invert`` any; a table of patterns has a column ``pattern``.

    Patterns of a table with a literal of ``GRAM`` code points or more are looked up by it: up to ``PATTERN_BYTES`` of them
    go to every task, which tries on a line those whose literals it holds, so that no line is shuffled; larger tables
    meet the lines in an equi-join. The others are tried on every line, in lots of about ``PATTERNS`` patterns and
    ``PATTERN_BYTES`` bytes, one after the other. A null line matches nothing, and a null pattern has no matches.
    """
    if isinstance(patterns, list):
        hit = F.col(value).rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)
        return lines.where(hit if invert else ~hit)
    table = patterns.select("pattern").where("pattern is not null").distinct().withColumn("grams", _pattern_grams("pattern"))
    looked_up = table.where(F.size("grams") > 0)
    # collected up to a bound in bytes, so that it is made once
    bytes_of = F.coalesce(F.sum(F.octet_length("pattern") + PATTERN_ROW), F.lit(0))
    if looked_up.agg(bytes_of).first()[0] <= PATTERN_BYTES:
        hit = _matches_any([r["pattern"] for r in looked_up.select("pattern").collect()], value)
        rest, hits = lines.where(~hit), [lines.where(hit)]
    else:
        found = lines_with(lines, looked_up, value)
        rest, hits = lines.join(found, value, "left_anti"), [lines.join(found, value, "left_semi")]
    plain = table.where(F.size("grams") == 0).select("pattern")
    n, size = plain.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).first()
    lots = max(-(-n // PATTERNS), -(-size // PATTERN_BYTES))
    for k in range(lots):
        lot = F.broadcast(plain.where(F.pmod(F.xxhash64("pattern"), F.lit(lots)) == k))
        if invert:
            hits.append(rest.join(lot, F.expr(f"{value} rlike pattern"), "left_semi"))
        rest = rest.join(lot, F.expr(f"{value} rlike pattern"), "left_anti")
    return reduce(DataFrame.unionByName, hits) if invert else rest


def annotated_durations(lines: DataFrame, pattern: str, order: str, by: tuple[str, ...] = (), value: str = "value", rows: int | None = ROWS) -> DataFrame:
    """Titles with durations like 1m30s from lines that match ``pattern`` (title, duration), with the running finish.

    A duration that is no number counts as 0 seconds.
    """
    x = lines.where(F.col(value).rlike(pattern)).withColumns({"title": F.regexp_extract(value, pattern, 1), "_d": F.regexp_extract(value, pattern, 2)})
    part = lambda unit: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("_d", rf"(\d+)\s*{unit}", 1), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0).cast("long"))
    x = x.withColumn("seconds", part("m") * 60 + part("s")).drop("_d")
    return running(x, {"finish": F.col("seconds")}, [order], by, rows)
