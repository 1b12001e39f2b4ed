"""Windowed moments of signals and of pairs, relation tables and edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import METRICS, metric, with_metrics
from .resample import drawn_offset
from .samples import cumulative_weight, interval_overlap, pairs, weight_sum, window_assign, window_starts, window_weight


def _weighted(df: DataFrame, size: int, alpha: float) -> DataFrame:
    return df.withColumn("w", window_weight(F.col("t") - F.col("u"), size, alpha))


def expectation(samples: DataFrame, size: int, overlap: int = 0, alpha: float = 0.0, keys: tuple[str, ...] = ("signal",)) -> DataFrame:
    """E[X] and E[X^2] of each signal in each window that has a sample of it: (keys, u, ex, exx)."""
    total = weight_sum(size, alpha)
    w = _weighted(window_assign(samples, size, overlap), size, alpha)
    mean = lambda c: (F.sum(c) / F.lit(total) if total else F.lit(0.0))
    return w.groupBy(*keys, "u").agg(mean(F.col("w") * F.col("v")).alias("ex"), mean(F.col("w") * F.col("v") * F.col("v")).alias("exx"))


def pair_moments(samples: DataFrame, deltas: Sequence[int], size: int, overlap: int = 0, alpha: float = 0.0, base: str = "signal", only: Sequence[int] | None = None, frame: bool = True) -> DataFrame:
    """Moments of every ordered pair of signals of different base, window and shift: x, y, delta, u and six means.

    ``samples`` (signal, t, v, and the base column) holds non-zero rows. X is read at t and Y at t + delta, with
    weights by t. Joint moments come from an equi-join of samples on time. With ``frame`` they are joined onto all
    pairs of signals (an equi-join on the window of one row a signal), so pairs that
    never meet are there with joint moments of 0. Windows that a negative t + delta would need are left out.
    """
    total = weight_sum(size, alpha)
    s = samples.select("signal", F.col(base).alias("base"), "t", "v")
    mean = lambda c: F.sum(F.col("w") * c) / F.lit(total)
    deltas = list(deltas)
    xs = _weighted(window_assign(s, size, overlap), size, alpha).groupBy(F.col("signal").alias("x"), F.col("base").alias("base_x"), "u").agg(mean(F.col("v")).alias("ex"), mean(F.col("v") * F.col("v")).alias("exx"))
    shifted = s.withColumn("delta", F.explode(F.array(*[F.lit(d).cast("long") for d in deltas]))).withColumn("t", F.col("t") - F.col("delta")).where("t >= 0")
    ys = _weighted(window_assign(shifted, size, overlap), size, alpha).groupBy(F.col("signal").alias("y"), F.col("base").alias("base_y"), "delta", "u").agg(mean(F.col("v")).alias("ey"), mean(F.col("v") * F.col("v")).alias("eyy"))
    met = _weighted(window_assign(pairs(s, deltas, base="base"), size, overlap), size, alpha)
    joint = met.groupBy("x", "y", "delta", "u").agg(mean(F.col("vx") * F.col("vy")).alias("exy"), mean(F.least("vx", "vy")).alias("emin"))
    return _assembled(s, xs, ys, joint, deltas, size - overlap, only, frame)


def _assembled(s: DataFrame, xs: DataFrame, ys: DataFrame, joint: DataFrame, deltas: Sequence[int], stride: int, only: Sequence[int] | None, frame: bool) -> DataFrame:
    """The moments of x, of y and of both put together, for the signals (signal, base) of ``s``."""
    if only is not None:
        xs, ys, joint = (d.where(F.col("u").isin([int(u) for u in only])) for d in (xs, ys, joint))
    if frame:
        windows = xs.select("u").union(ys.select("u")).distinct()
        # two numbers, where the windows begin and end
        first, last = windows.agg(F.min("u"), F.max("u")).first()
        frame_of = lambda name: _every(s, windows, name, first or 0, last or 0, stride)
        x_all = frame_of("x").join(xs.drop("base_x"), ["x", "u"], "left")
        shifts = F.explode(F.array(*[F.lit(d).cast("long") for d in deltas]))
        y_all = frame_of("y").withColumn("delta", shifts).join(ys.drop("base_y"), ["y", "delta", "u"], "left")
        grid = x_all.join(y_all, "u").where("base_x <> base_y and u + delta >= 0")
    else:
        grid = joint.select("x", "y", "delta", "u").join(xs.drop("base_x"), ["x", "u"]).join(ys.drop("base_y"), ["y", "delta", "u"]).where("u + delta >= 0")
    out = grid.join(joint, ["x", "y", "delta", "u"], "left")
    return out.select("x", "y", "delta", "u", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ex", "ey", "exy", "exx", "eyy", "emin")])


def _in_windows(d: DataFrame, size: int, stride: int, alpha: int) -> DataFrame:
    """A row for each window that an interval reaches into, with its share of the window's weight."""
    first, last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("t0") - size) / stride) + 1), F.floor((F.col("t1") - 1) / stride)
    d = d.withColumn("u", F.explode(F.transform(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")), lambda k: k * stride)))
    at = lambda t: cumulative_weight(t - F.col("u"), size, alpha)
    return d.withColumn("w", at(F.least(F.col("t1"), F.col("u") + size)) - at(F.greatest("t0", "u")))


def interval_moments(intervals: DataFrame, deltas: Sequence[int], size: int, overlap: int = 0, alpha: int = 0, base: str = "signal", end: int | None = None, only: Sequence[int] | None = None, frame: bool = True, bucket: int | None = None) -> DataFrame:
    """What :func:`pair_moments` gives for held values, straight from their intervals (signal, t0, t1, v): no tick is expanded.

    An interval or an overlap weighs cw(b) - cw(a) in a window, cw being the sum of the window's weights before a tick.
    A row is made for each interval and window that it reaches into, and for each overlap of two of them, whatever their
    length; so dense signals cost no more than sparse ones. Overlaps are found in buckets of ``bucket`` ticks (a window's
    size, if not given). Intervals without t1 last until ``end``. Intervals of 0 may be there or not.
    """
    total, stride = weight_sum(size, alpha), size - overlap
    close = F.coalesce("t1", F.lit(end).cast("long"))
    s = intervals.select("signal", F.col(base).alias("base"), "t0", close.alias("t1"), "v")
    signals, s = s.select("signal", "base").distinct(), s.where("v <> 0 and t0 < t1")
    deltas = list(deltas)

    in_windows = lambda d: _in_windows(d, size, stride, alpha)
    mean = lambda c: F.sum(F.col("w") * c) / F.lit(total)
    xs = in_windows(s).groupBy(F.col("signal").alias("x"), F.col("base").alias("base_x"), "u").agg(mean(F.col("v")).alias("ex"), mean(F.col("v") * F.col("v")).alias("exx"))
    every = s.withColumn("delta", F.explode(F.array(*[F.lit(d).cast("long") for d in deltas])))
    shifted = every.withColumns({"t0": F.greatest(F.lit(0).cast("long"), F.col("t0") - F.col("delta")), "t1": F.col("t1") - F.col("delta")}).where("t0 < t1")
    ys = in_windows(shifted).groupBy(F.col("signal").alias("y"), F.col("base").alias("base_y"), "delta", "u").agg(mean(F.col("v")).alias("ey"), mean(F.col("v") * F.col("v")).alias("eyy"))
    named = lambda d: d.withColumn("signal", F.struct("signal", "base"))
    met = interval_overlap(named(every), named(shifted), bucket or size, ("delta",)).where("x.base <> y.base")
    joint = in_windows(met).groupBy(F.col("x.signal").alias("x"), F.col("y.signal").alias("y"), "delta", "u").agg(mean(F.col("vx") * F.col("vy")).alias("exy"), mean(F.least("vx", "vy")).alias("emin"))
    return _assembled(signals, xs, ys, joint, deltas, stride, only, frame)


def _every(s: DataFrame, windows: DataFrame, name: str, first: int, last: int, stride: int) -> DataFrame:
    """Each signal in each window that has a sample: a signal's windows are listed from the first to the last."""
    signals = s.select(F.col("signal").alias(name), F.col("base").alias(f"base_{name}")).distinct()
    return signals.withColumn("u", F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(stride)))).join(windows, "u", "left_semi")


def relation_table(samples: DataFrame, deltas: Sequence[int], size: int, a: str = "dep", b: str | None = None, overlap: int = 0, alpha: float = 0.0, u: int | None = None, x: str | None = None, y: str | None = None, base: str = "signal", wide: bool = False) -> DataFrame:
    """One or two metrics for each x, y, window and shift; ``wide`` puts the shifts into columns."""
    m = pair_moments(samples, deltas, size, overlap, alpha, base, None if u is None else [u])
    for name, value in (("x", x), ("y", y)):
        if value is not None:
            m = m.where(F.col(name) == value)
    names = [n for n in (a, b) if n]
    out = m.select("x", "y", "u", "delta", "ex", "ey", *[metric(n).alias(n) for n in names])
    if wide:
        return out.groupBy("x", "y", "u").pivot("delta", list(deltas)).agg(*[F.first(n).alias(n) for n in names])
    return out


#: Siblings that a level's expectations are given for.
SIBLINGS = ("orig", "refl", "rise", "fall")


def sibling_expectations(levels: DataFrame, size: int, end: int, overlap: int = 0, alpha: int = 0, key: str = "base") -> DataFrame:
    """E[orig], E[refl], E[rise] and E[fall] of each level and window that has any of orig, rise or fall: (key, u, four means).

    ``levels`` (key, sibling, t0, t1) are intervals of ones as ``measures.siblings`` gives them, in [0, end). All four
    come from one aggregate over the intervals' shares of windows; refl, which lasts longest of all, is what a window
    has before ``end`` without orig, so its rows are left out.
    """
    total, stride = weight_sum(size, alpha), size - overlap
    w = levels.where(F.col("sibling").isin("orig", "rise", "fall")).select(key, "sibling", "t0", F.least(F.coalesce("t1", F.lit(end)), F.lit(end)).cast("long").alias("t1")).where("t0 < t1")
    mean = lambda k: F.sum(F.when(F.col("sibling") == k, F.col("w")).otherwise(0.0)) / F.lit(total)
    m = _in_windows(w, size, stride, alpha).groupBy(key, "u").agg(*[mean(k).alias(f"e_{k}") for k in ("orig", "rise", "fall")])
    return m.select(key, "u", "e_orig", (_whole(size, end, alpha) - F.col("e_orig")).alias("e_refl"), "e_rise", "e_fall")


def _whole(size: int, end: int, alpha: int) -> Column:
    """The part of window u's weight that lies before ``end``."""
    before = F.greatest(F.lit(0).cast("long"), F.least(F.lit(size).cast("long"), F.lit(end) - F.col("u")))
    return cumulative_weight(before, size, alpha) / F.lit(weight_sum(size, alpha))


def with_siblings(table: DataFrame, levels: DataFrame, size: int, end: int, overlap: int = 0, alpha: int = 0, sides: Sequence[str] = ("x", "y"), base_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """A relation table (any rows with u and the ``sides``) with the four sibling expectations of each side beside it.

    Adds ex_orig, ex_refl, ex_rise, ex_fall for x and ey_... for y, taken at the row's own window whatever its shift. The
    measures of a table may be siblings themselves: ``base_of`` turns their names into the levels' ``base``. The joins
    are equi-joins on (base, u) with a row for each level and window; a level that is silent in a window is all refl there.
    """
    e = sibling_expectations(levels, size, end, overlap, alpha)
    silent = {"orig": F.lit(0.0), "refl": _whole(size, end, alpha), "rise": F.lit(0.0), "fall": F.lit(0.0)}
    out, given = table, table.columns
    for side in sides:
        named = e.select(F.col("base").alias("_base"), "u", *[F.col(f"e_{k}").alias(f"e{side}_{k}") for k in SIBLINGS])
        out = out.withColumn("_base", base_of(F.col(side)) if base_of else F.col(side)).join(named, ["_base", "u"], "left").drop("_base")
        out = out.withColumns({f"e{side}_{k}": F.coalesce(f"e{side}_{k}", silent[k]) for k in SIBLINGS})
    return out.select(*given, *[f"e{side}_{k}" for side in sides for k in SIBLINGS])


def relation_edges(samples: DataFrame, deltas: Sequence[int], size: int, a: str | Callable[[], Column], eps_a: float, b: str | Callable[[], Column] | None = None, eps_b: float = 0.0, overlap: int = 0, alpha: float = 0.0, u: int | None = None, base: str = "signal", factor: int = 1) -> DataFrame:
    """Pairs whose metric ``a`` is over eps_a and then ``b`` over eps_b, with all metrics, expectations and the shift.

    Pairs that never meet can only pass through ham, cls or cov, so other filters need no frame of all pairs. With a
    sample factor over 1 the samples' times are those of the coarser grid, and start, shift and size are divided by it.
    """
    needs_frame = any(m in ("ham", "cls", "cov") or not isinstance(m, str) for m in (a, b) if m is not None)
    m = pair_moments(samples, [d // factor for d in deltas], size // factor, overlap // factor, alpha, base, None if u is None else [u // factor], frame=needs_frame)
    m = m.where(metric(a) > eps_a)
    if b is not None:
        m = m.where(metric(b) > eps_b)
    return with_metrics(m).withColumn("factor", F.lit(factor))


#: Vectors of a block, about, and ticks of a part of a vector.
VECTORS, TICKS = 2048, 2048
#: Tasks that the tiles of blocks are dealt to, and pairs that leave a tile at once, at most.
TASKS, PAIRS = 1 << 12, 1 << 16


class _Tile:
    """Sums over the pairs of two blocks of vectors, or within one, from one part of the vectors after the other."""

    def __init__(self, key: tuple, whole: bool):
        self.key, self.whole = key, whole
        self.slots: tuple[dict, dict] = ({}, {})
        self.sums = np.zeros((2, 0, 0))
        self.ones = (np.zeros((0, 3)), np.zeros((0, 3)))

    def add(self, rows: list[tuple], ticks: int) -> None:
        """``rows`` (idx, side, ts, vs, sum, sum of squares) of one part, in the order of idx; a sum may be null."""
        at: tuple[list, list] = ([], [])
        for place, (idx, side, *_) in enumerate(rows):
            at[side].append(place)
            self.slots[side].setdefault(idx, len(self.slots[side]))
        sizes = len(self.slots[0]), len(self.slots[0 if self.whole else 1])
        if self.sums.shape[1:] != sizes:
            grown = np.zeros((2, *sizes))
            grown[:, : self.sums.shape[1], : self.sums.shape[2]] = self.sums
            self.sums = grown
            self.ones = tuple(np.concatenate([o, np.zeros((len(s) - len(o), 3))]) for o, s in zip(self.ones, self.slots))
        matrices, slots = [], []
        for side, places in enumerate(at):
            m = np.zeros((len(places), ticks))
            for k, p in enumerate(places):
                m[k, rows[p][2]] = rows[p][3]
            own = np.array([self.slots[side][rows[p][0]] for p in places], int)
            for k, p in zip(own, places):
                if rows[p][4] is not None:
                    self.ones[side][k] += (rows[p][4], rows[p][5], 1)
            matrices.append(m)
            slots.append(own)
        for side, other in ((0, 0),) if self.whole else ((0, 1), (1, 0)):
            to, after = matrices[other], np.searchsorted(at[other], at[side], "right")
            for k, first in enumerate(after):  # a row against all of larger idx
                used = np.flatnonzero(matrices[side][k])
                if first == len(to) or not len(used):
                    continue
                v, y = matrices[side][k, used], to[first:] if len(used) == ticks else to[first:, used]
                cells = (slots[other][first:], slots[side][k]) if side else (slots[side][k], slots[other][first:])
                self.sums[0][cells] += y @ v
                self.sums[1][cells] += np.minimum(y, v).sum(axis=1)

    def batches(self, kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
        """(keys, x, y, sx, sxx, sy, syy, sxy, smin) of each pair x < y, PAIRS of them at a time, about."""
        rows, columns = self.sums.shape[1:]
        idx = pa.array([*self.slots[0], *self.slots[1]], kinds[-1])
        ones = np.concatenate(self.ones)
        empty = ones[:, 2] == 0
        sums = [pa.array(ones[:, k], mask=empty) for k in (0, 1)]
        rank = np.empty(len(idx), int)
        rank[pc.sort_indices(idx).to_numpy()] = np.arange(len(idx))
        right = np.arange(columns) + (0 if self.whole else rows)
        step = max(1, PAIRS // max(1, columns))
        for k in range(0, rows, step):
            left = np.arange(k, min(rows, k + step))
            a, b = np.nonzero(rank[left][:, None] < rank[right][None]) if self.whole else (np.repeat(np.arange(len(left)), columns), np.tile(np.arange(columns), len(left)))
            if not len(a):
                continue
            sxy, smin = self.sums[:, left[a], b]
            a, b = left[a], right[b]
            x, y = (np.where((rank[a] < rank[b]) == low, a, b) for low in (True, False))
            pairs = [idx.take(pa.array(x)), idx.take(pa.array(y)), *(s.take(pa.array(side)) for side in (x, y) for s in sums), pa.array(sxy), pa.array(smin)]
            yield pa.RecordBatch.from_arrays([*(pa.repeat(c, len(a)) for c in self.key), *pairs], names)


def _sums_in_tiles(samples: DataFrame, keys: Sequence[str], vectors: int, ticks: int) -> DataFrame:
    """(keys, x, y, sx, sxx, sy, syy, sxy, smin) of all pairs x < y: sums of each, of products and of minima.

    Vectors are dealt into blocks by hash, and each goes to the tiles (block, block) that its block is part of; a tile
    works on its vectors, part after part, as two matrices, and its pairs leave it whole. So what is shuffled are
    vectors, as often as there are blocks, and no row for a pair. A task holds a part of the vectors of two blocks and
    the sums over their pairs.
    """
    samples = samples.where(" and ".join(f"`{c}` is not null" for c in (*keys, "idx")))
    many = samples.select(*keys, "idx").distinct().groupBy(*keys).agg(F.ceil(F.count("*") / vectors).cast("int").alias("n"))
    tiles = many.agg(F.sum(F.col("n").cast("long") * (F.col("n") + 1) / 2)).first()[0] or 1  # one number
    used, v = F.col("v") != 0, F.col("v").cast("double")
    part = samples.groupBy(*keys, "idx", F.floor(F.col("t") / ticks).alias("part")).agg(F.collect_list(F.when(used, (F.col("t") % ticks).cast("int"))).alias("ts"), F.collect_list(F.when(used, v)).alias("vs"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"))
    own, other = F.pmod(F.xxhash64("idx"), F.col("n")).cast("int"), F.col("other")
    dealt = part.join(many, list(keys)).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", other), "j": F.greatest("own", other)}).withColumn("side", F.when(F.col("own") == F.col("i"), 0).otherwise(1))
    tile = [*keys, "i", "j", "part", "idx"]
    dealt = dealt.select(*tile, "side", "ts", "vs", "s", "ss").repartition(int(min(tiles, TASKS)), *keys, "i", "j").sortWithinPartitions(*tile)
    many_keys, names = len(keys), [*keys, "x", "y", "sx", "sxx", "sy", "syy", "sxy", "smin"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, at, where, rows, kinds = None, None, None, [], []
        for batch in batches:
            kinds = [batch.column(k).type for k in (*range(many_keys), many_keys + 3)]
            *places, idx, side, ts, vs, s, ss = (batch.column(k) for k in range(batch.num_columns))
            lists = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in (ts, vs)]
            listed = zip(*(c.to_pylist() for c in (idx, side, s, ss)))
            for r, (place, (x, own, one, square)) in enumerate(zip(zip(*(c.to_pylist() for c in places)), listed)):
                place = tuple(map(repr, place))
                if place != where:
                    if tile:
                        tile.add(rows, ticks)
                    rows, where = [], place
                    if place[:-1] != at:
                        if tile:
                            yield from tile.batches(kinds, names)
                        at, tile = place[:-1], _Tile(tuple(c[r] for c in places[:many_keys]), place[many_keys] == place[many_keys + 1])
                rows.append((x, own, *(v[o[r] : o[r + 1]] for o, v in lists), one, square))
        if tile:
            tile.add(rows, ticks)
            yield from tile.batches(kinds, names)

    kind = {f.name: f.dataType.simpleString() for f in samples.schema}
    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in keys), f"x {kind['idx']}", f"y {kind['idx']}", *(f"{c} double" for c in names[-6:])])
    return dealt.mapInArrow(summed, schema)


def all_pairs(samples: DataFrame, n: int, keys: tuple[str, ...] = ("system",), vectors: int = VECTORS, ticks: int = TICKS) -> DataFrame:
    """Every upper-triangle pair (x < y by idx) of every system over all n ticks: six symmetric metrics.

    ``samples`` (keys, idx, t, v) holds non-zero rows, v being 0 or more; ``n`` is the number of ticks of each system. One
    key at least. Sums over pairs are formed in tiles of blocks of vectors, and a pair's metrics where its sums are.
    """
    if not keys:
        raise ValueError("pairs are formed within a system")
    total = F.lit(float(n))
    sums = _sums_in_tiles(samples, keys, vectors, min(n, ticks))
    m = sums.select(*keys, "x", "y", *[(F.col(f"s{c}") / total).alias(f"e{c}") for c in ("x", "xx", "y", "yy", "xy", "min")])
    return with_metrics(m, [k for k in METRICS if k != "cex"])


def node_stats(samples: DataFrame, size: int, alpha: float = 0.0) -> DataFrame:
    """Of each base signal and window: E[orig], E[refl], E[rise], E[rise|orig], E[fall|refl], Cov(orig, orig).

    ``samples`` (base, kind, t, v) holds the non-zero rows of kinds orig, rise and fall; refl is 1 - orig, so it is
    derived and never joined: E[refl] = 1 - E[orig] and E[fall refl] = E[fall] - E[fall orig].
    """
    total = F.lit(weight_sum(size, alpha))
    at = samples.groupBy("base", "t").pivot("kind", ["orig", "rise", "fall"]).agg(F.max("v")).na.fill(0.0)
    w = _weighted(window_assign(at, size), size, alpha)
    mean = lambda c: F.sum(F.col("w") * c) / total
    m = w.groupBy("base", "u").agg(mean(F.col("orig")).alias("e_orig"), mean(F.col("rise")).alias("e_rise"), mean(F.col("rise") * F.col("orig")).alias("rise_orig"), mean(F.col("fall")).alias("e_fall"), mean(F.col("fall") * F.col("orig")).alias("fall_orig"), mean(F.col("orig") * F.col("orig")).alias("orig2"))
    refl = 1 - F.col("e_orig")
    return m.select(
        "base", "u", "e_orig", refl.alias("e_refl"), "e_rise",
        F.when(F.col("e_orig") != 0, F.col("rise_orig") / F.col("e_orig")).alias("cex_rise_orig"),
        F.when(refl != 0, (F.col("e_fall") - F.col("fall_orig")) / refl).alias("cex_fall_refl"),
        (4 * F.abs(F.col("orig2") - F.col("e_orig") * F.col("e_orig"))).alias("cov_orig"),
    )


def _by_factor(factors: Sequence[int], of: Callable[[int], Column | float]) -> Column:
    """A value for each sample factor."""
    out = F.lit(None).cast("double")
    for f in factors:
        x = of(f)
        out = F.when(F.col("factor") == f, x if isinstance(x, Column) else F.lit(x)).otherwise(out)
    return out


def ladder_moments(samples: DataFrame, ladder: DataFrame, size: int, back: int, forward: int, stride: int | None = None, alpha: float = 0.0, base: str = "signal", algorithm: str = "xor", seed: int = 0, frame: bool = True) -> DataFrame:
    """Moments of pairs over a whole ladder of shifts (factor, delta), each at its own resolution: factor, delta, u, x, y
    and the six means of :func:`pair_moments`.

    Window u holds the ticks [u, u + size); around it, ``back`` and ``forward`` ticks are read. Blocks of ``factor`` ticks
    are counted from u - back, and of each block one tick stands for all, drawn as in ``resample.subsample``. The window
    begins at block back // factor, has size // factor blocks, and Y is read delta // factor blocks on (all cut down).
    Shifts with u + delta < 0 are left out. An octave's samples are about 1 / factor of all, so the ladder as a whole
    reads little more than its first octave: all octaves are one table and one equi-join on (u, factor, block). Windows
    follow each other by ``stride`` (``size``, if not given). The ladder is a few numbers for each octave.
    """
    stride = stride or size
    steps = sorted({(r["factor"], r["delta"]) for r in ladder.select("factor", "delta").collect()})
    factors = sorted({f for f, _ in steps})
    if not steps or factors[-1] > size:
        raise ValueError("a ladder has steps, none coarser than a window")
    span = back + size + forward + 1
    s = samples.select("signal", F.col(base).alias("base"), "t", "v").withColumn("u", F.explode(window_starts(F.col("t") + back, span, span - stride)))
    s = s.withColumn("factor", F.explode(F.array(*[F.lit(f).cast("long") for f in factors]))).withColumn("r", F.col("t") - F.col("u") + back)
    s = s.withColumn("block", F.floor(F.col("r") / F.col("factor")))
    # once, for the three uses below
    s = s.where(F.col("r") % F.col("factor") == drawn_offset(F.col("factor"), F.col("block"), algorithm, seed, ("signal",))).select("signal", "base", "v", "u", "factor", "block").repartition("u", "factor", "block")

    def within(d: DataFrame) -> DataFrame:
        """Rows of the window, with the weight of their place."""
        at = F.col("block") - F.floor(F.lit(back) / F.col("factor"))
        d = d.withColumn("i", at).where((F.col("i") >= 0) & (F.col("i") < F.floor(F.lit(size) / F.col("factor"))))
        return d.withColumn("w", _by_factor(factors, lambda f: window_weight(F.col("i"), size // f, alpha)) / _by_factor(factors, lambda f: weight_sum(size // f, alpha)))

    mean = lambda c: F.sum(F.col("w") * c)
    shifts = F.array(*[F.struct(F.lit(f).cast("long").alias("f"), F.lit(d).cast("long").alias("delta")) for f, d in steps])
    shifted = s.withColumn("step", F.explode(F.filter(shifts, lambda x: x["f"] == F.col("factor")))).select("signal", "base", "v", "u", "factor", F.col("step.delta").alias("delta"), (F.col("block") - F.floor(F.col("step.delta") / F.col("factor"))).alias("block")).where("u + delta >= 0")
    xs = within(s).groupBy("factor", "u", F.col("signal").alias("x")).agg(mean(F.col("v")).alias("ex"), mean(F.col("v") * F.col("v")).alias("exx"))
    ys = within(shifted).groupBy("factor", "u", "delta", F.col("signal").alias("y")).agg(mean(F.col("v")).alias("ey"), mean(F.col("v") * F.col("v")).alias("eyy"))
    left = within(s).select("u", "factor", "block", "w", F.col("signal").alias("x"), F.col("base").alias("base_x"), F.col("v").alias("vx"))
    right = shifted.select("u", "factor", "block", "delta", F.col("signal").alias("y"), F.col("base").alias("base_y"), F.col("v").alias("vy"))
    met = left.join(right, ["u", "factor", "block"]).where("base_x <> base_y")
    joint = met.groupBy("factor", "u", "delta", "x", "y").agg(mean(F.col("vx") * F.col("vy")).alias("exy"), mean(F.least("vx", "vy")).alias("emin"))
    if frame:
        signals = samples.select("signal", F.col(base).alias("base")).distinct()
        windows = xs.select("u").union(ys.select("u")).distinct()
        first, last = windows.agg(F.min("u"), F.max("u")).first()  # two numbers
        listed = signals.withColumn("u", F.explode(F.sequence(F.lit(first or 0), F.lit(last or 0), F.lit(stride)))).join(windows, "u", "left_semi")
        x_all = listed.select("u", F.col("signal").alias("x"), F.col("base").alias("base_x"))
        y_all = listed.select("u", F.col("signal").alias("y"), F.col("base").alias("base_y"), F.explode(shifts).alias("step")).select("u", "y", "base_y", F.col("step.f").alias("factor"), "step.delta").where("u + delta >= 0")
        grid = x_all.join(y_all, "u").where("base_x <> base_y").join(joint, ["factor", "u", "delta", "x", "y"], "left")
    else:
        grid = joint
    how = "left" if frame else "inner"
    out = grid.join(xs, ["factor", "u", "x"], how).join(ys, ["factor", "u", "delta", "y"], how)
    return out.select("factor", "delta", "u", "x", "y", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ex", "ey", "exy", "exx", "eyy", "emin")])


#: Metrics that can pass a threshold though a pair never meets.
WITHOUT_MEETING = ("ham", "cls", "cov")


def ladder_edges(samples: DataFrame, ladder: DataFrame, size: int, back: int, forward: int, a: str | Callable[[], Column], eps_a: float, b: str | Callable[[], Column] | None = None, eps_b: float = 0.0, **how) -> DataFrame:
    """Edges over a whole ladder of shifts: pairs whose metric ``a`` is over eps_a and then ``b`` over eps_b, with all
    metrics, both expectations, the shift and its factor (see :func:`ladder_moments` for the rest)."""
    frame = all(m in WITHOUT_MEETING or not isinstance(m, str) for m in (a, b) if m is not None)
    m = ladder_moments(samples, ladder, size, back, forward, frame=frame, **how).where(metric(a) > eps_a)
    return with_metrics(m if b is None else m.where(metric(b) > eps_b))
