"""Registered queries over the given tables, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quantised as q
from ..functions import scalar as sc
from ..operators import changes as ch
from ..operators import evaluate as ev
from ..operators import learn as le
from ..operators import measures as me
from ..operators import metrics as mt
from ..operators import params as pa
from ..operators import relate as re_
from ..operators import resample as rs
from ..operators import samples as sa
from ..operators import series as se
from ..operators import text_jobs as tj
from ..sources import change_files as cf
from ..sources import traces as tr
from ..sources import binary_files as bf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _seconds(c: str) -> F.Column:
    """Seconds since 1970 of a time without zone: the session's zone plays no part."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def _days(c: str) -> F.Column:
    return F.expr(f"datediff(DAY, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({c} as timestamp_ntz))").cast("long")


def r9(c: str | F.Column, name: str | None = None) -> F.Column:
    x = F.round(F.col(c) if isinstance(c, str) else c, 9)
    return x.alias(name or c) if name or isinstance(c, str) else x


def r6(c: str) -> F.Column:
    """What F.round(c, 6) gives, which goes through decimal text: only values near a tie take that way here."""
    near = F.rint(F.col(c) * 1e6)
    off = F.abs(F.col(c) * 1e6 - near)
    return F.when((off < 0.499) & (F.abs(near) < 1e12), near / 1e6 + 0.0).otherwise(F.round(c, 6)).alias(c)


TICK, SIZE, DELTAS = 600, 64, [-2, -1, 0, 1]


def occurrences_of(spark: SparkSession, d: str) -> DataFrame:
    """Event types as signals: one sample of 1 for each 10-minute tick that has such an event."""
    e = table(spark, d, "events").select(F.col("event_type").alias("signal"), F.floor(_seconds("ts") / TICK).cast("long").alias("t"))
    return e.distinct().withColumn("v", F.lit(1.0))


_S = "s AS (SELECT DISTINCT event_type AS signal, (epoch_us(ts) // 600000000)::BIGINT AS t, 1.0::DOUBLE AS v FROM events)"


def user_values(spark: SparkSession, d: str) -> DataFrame:
    """Each user's value as a signal over seconds; of values at one second the largest counts."""
    return table(spark, d, "events").groupBy(F.col("user_id").alias("signal"), _seconds("ts").cast("long").alias("t")).agg(F.max("value").alias("v"))


_V = "v AS (SELECT user_id AS signal, (epoch_us(ts) // 1000000)::BIGINT AS t, max(value) AS v FROM events GROUP BY ALL)"

# samples, windows, moments


@query(f"WITH {_S} SELECT signal, t AS t0, t + 1 AS t1, v FROM s")
def occurrences(spark, d):
    return me.measure_event(occurrences_of(spark, d))


@query(f"WITH {_V}, h AS (SELECT signal, t AS t0, lead(t) OVER (PARTITION BY signal ORDER BY t) AS t1, v FROM v) SELECT signal, t0, coalesce(t1, -1) AS t1, v FROM h")
def hold_intervals(spark, d):
    return sa.hold(user_values(spark, d)).na.fill(-1, ["t1"])


@query(f"WITH {_S}, w AS (SELECT signal, t, unnest(range(greatest(0, CAST(ceil((t - 63) / 48.0) AS BIGINT)), t // 48 + 1)) * 48 AS u FROM s) SELECT u, signal, count(*) AS n FROM w GROUP BY ALL")
def window_assign(spark, d):
    return sa.window_assign(occurrences_of(spark, d), SIZE, 16).groupBy("u", "signal").agg(F.count("*").alias("n"))


@query(f"WITH {_S} SELECT signal, (t // 64) * 64 AS u, round(sum(v) / 64, 9) AS ex FROM s GROUP BY ALL")
def expectation_by_window(spark, d):
    return re_.expectation(occurrences_of(spark, d), SIZE).select("signal", "u", r9("ex"))


_W2 = "pow(greatest(0.0, sin((t - u) * pi() / 63)), 2)"
_T2 = "(SELECT sum(pow(greatest(0.0, sin(i * pi() / 63)), 2)) FROM range(64) r(i))"


@query(f"WITH {_S}, w AS (SELECT signal, t, v, unnest(range(greatest(0, CAST(ceil((t - 63) / 32.0) AS BIGINT)), t // 32 + 1)) * 32 AS u FROM s) SELECT signal, u, round(sum(v * {_W2}) / {_T2}, 9) AS ex FROM w GROUP BY ALL")
def weighted_expectation(spark, d):
    return re_.expectation(occurrences_of(spark, d), SIZE, 32, 2.0).select("signal", "u", r9("ex"))


_MOMENTS = f"""{_S}, dl AS (SELECT unnest([-2, -1, 0, 1]) AS delta), sg AS (SELECT DISTINCT signal FROM s),
xs AS (SELECT signal AS x, (t // 64) * 64 AS u, sum(v) / 64 AS ex, sum(v * v) / 64 AS exx FROM s GROUP BY ALL),
sh AS (SELECT signal AS y, delta, t - delta AS t, v FROM s, dl WHERE t - delta >= 0),
ys AS (SELECT y, delta, (t // 64) * 64 AS u, sum(v) / 64 AS ey, sum(v * v) / 64 AS eyy FROM sh GROUP BY ALL),
jt AS (SELECT s.signal AS x, sh.y, sh.delta, (s.t // 64) * 64 AS u, sum(s.v * sh.v) / 64 AS exy, sum(least(s.v, sh.v)) / 64 AS emin FROM s JOIN sh ON s.t = sh.t AND s.signal <> sh.y GROUP BY ALL),
us AS (SELECT u FROM xs UNION SELECT u FROM ys),
m AS (SELECT a.signal AS x, b.signal AS y, dl.delta, us.u, coalesce(ex, 0) AS ex, coalesce(ey, 0) AS ey, coalesce(exy, 0) AS exy, coalesce(exx, 0) AS exx, coalesce(eyy, 0) AS eyy, coalesce(emin, 0) AS emin
  FROM us CROSS JOIN dl CROSS JOIN sg a JOIN sg b ON a.signal <> b.signal
  LEFT JOIN xs ON xs.x = a.signal AND xs.u = us.u LEFT JOIN ys ON ys.y = b.signal AND ys.u = us.u AND ys.delta = dl.delta
  LEFT JOIN jt ON jt.x = a.signal AND jt.y = b.signal AND jt.u = us.u AND jt.delta = dl.delta WHERE us.u + dl.delta >= 0),
k AS (SELECT *, CASE WHEN ey <> 0 THEN exy / ey END AS cex, 1 - (ex + ey - 2 * emin) AS ham, CASE WHEN ex + ey - exy <> 0 THEN exy / (ex + ey - exy) ELSE 0 END AS tmt,
  1 - sqrt(greatest(0, exx + eyy - 2 * exy)) AS cls, CASE WHEN exx <> 0 AND eyy <> 0 THEN least(1, exy / (sqrt(exx) * sqrt(eyy))) ELSE 0 END AS cos, 4 * abs(exy - ex * ey) AS cov,
  CASE WHEN ey <> 0 AND exy / ey > ex THEN (exy / ey - ex) / (exy / ey) ELSE 0 END AS dep FROM m)"""
_SHOW = ", ".join(f"round({c}, 9) AS {c}" for c in mt.METRICS)


@query(f"WITH {_MOMENTS} SELECT x, y, delta::BIGINT AS delta, u, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("ex", "ey", "exy", "exx", "eyy", "emin")) + " FROM m")
def pair_moments(spark, d):
    return re_.pair_moments(occurrences_of(spark, d), DELTAS, SIZE).select("x", "y", "delta", "u", *map(r9, ("ex", "ey", "exy", "exx", "eyy", "emin")))


@query(f"WITH {_MOMENTS} SELECT x, y, delta::BIGINT AS delta, u, {_SHOW} FROM k")
def relation_table(spark, d):
    m = mt.with_metrics(re_.pair_moments(occurrences_of(spark, d), DELTAS, SIZE))
    return m.select("x", "y", "delta", "u", *map(r9, mt.METRICS))


@query(f"WITH {_MOMENTS} SELECT x, y, u, " + ", ".join(f"round(max(CASE WHEN delta = {x} THEN dep END), 9) AS dep_{'m' if x < 0 else 'p'}{abs(x)}" for x in DELTAS) + " FROM k GROUP BY x, y, u")
def relation_table_wide(spark, d):
    w = re_.relation_table(occurrences_of(spark, d), DELTAS, SIZE, "dep", wide=True)
    return w.select("x", "y", "u", *[r9(F.col(f"`{x}`"), f"dep_{'m' if x < 0 else 'p'}{abs(x)}") for x in DELTAS])


@query(f"WITH {_MOMENTS} SELECT x, y, delta::BIGINT AS delta, u, round(ex, 9) AS ex, round(ey, 9) AS ey, {_SHOW} FROM k WHERE dep > 0.05 AND cov > 0.02")
def relation_edges(spark, d):
    e = re_.relation_edges(occurrences_of(spark, d), DELTAS, SIZE, mt.dependence, 0.05, "cov", 0.02)
    return e.select("x", "y", "delta", "u", r9("ex"), r9("ey"), *map(r9, mt.METRICS))


@query(f"WITH {_MOMENTS} SELECT x, y, delta::BIGINT AS delta, u, round(dep, 9) AS dep FROM k WHERE dep > 0.1")
def dependence_edges(spark, d):
    return re_.relation_edges(occurrences_of(spark, d), DELTAS, SIZE, "dep", 0.1).select("x", "y", "delta", "u", r9("dep"))


# whether each event type's latest value is 50 or more, by 10-minute ticks from the first event on, with siblings
_LEVELS = """h0 AS (SELECT event_type AS base, ((epoch_us(ts) // 1000000) - (SELECT min(epoch_us(ts) // 1000000) FROM events)) // 600 AS t, max(value) AS v FROM events GROUP BY ALL), n0 AS (SELECT max(t) + 1 AS stop FROM h0),
h1 AS (SELECT base, t AS t0, coalesce(lead(t) OVER (PARTITION BY base ORDER BY t), stop) AS t1, (v >= 50)::INT AS v FROM h0, n0),
h2 AS (SELECT base, unnest(range(t0, t1)) AS t, v FROM h1 UNION ALL SELECT base, unnest(range(0, min(t0))), 0 FROM h1 GROUP BY base),
h3 AS (SELECT base, t, v, lag(v, 1, 0) OVER (PARTITION BY base ORDER BY t) AS b FROM h2),
lv AS (SELECT base, t, unnest([v, 1 - v, (v > b)::INT, (v < b)::INT])::DOUBLE AS v, unnest(['orig', 'refl', 'rise', 'fall']) AS sibling FROM h3),
s AS (SELECT 'threshold.' || sibling || '.' || base AS signal, base, sibling, t, v FROM lv WHERE v <> 0),
se AS (SELECT base, (t // 64) * 64 AS u, sum(v) FILTER (sibling = 'orig') / 64 AS orig, sum(v) FILTER (sibling = 'refl') / 64 AS refl, sum(v) FILTER (sibling = 'rise') / 64 AS rise, sum(v) FILTER (sibling = 'fall') / 64 AS fall FROM lv GROUP BY ALL)"""
_BASED = ", dl" + _MOMENTS.split(", dl", 1)[1].replace("[-2, -1, 0, 1]", "[-1, 0]").replace("AND s.signal <> sh.y", "AND split_part(s.signal, '.', 3) <> split_part(sh.y, '.', 3)").replace("sg a JOIN sg b ON a.signal <> b.signal", "sg a JOIN sg b ON split_part(a.signal, '.', 3) <> split_part(b.signal, '.', 3)")


@query(f"WITH {_LEVELS}{_BASED} SELECT x, y, delta::BIGINT AS delta, k.u, round(dep, 9) AS dep, round(cov, 9) AS cov, " + ", ".join(f"round({a}.{s}, 9) AS e{n}_{s}" for a, n in (("p", "x"), ("q", "y")) for s in re_.SIBLINGS) + " FROM k JOIN se p ON p.base = split_part(x, '.', 3) AND p.u = k.u JOIN se q ON q.base = split_part(y, '.', 3) AND q.u = k.u")
def relation_table_siblings(spark, d):
    """Every measure against every other of another base, with the expectations of both sides' siblings."""
    e = table(spark, d, "events").select("event_type", _seconds("ts").alias("s"), "value")
    first, last = e.agg(F.min("s"), F.max("s")).first()
    stop = ((last or 0) - (first or 0)) // 600 + 1
    held = e.groupBy(F.col("event_type").alias("base"), F.floor((F.col("s") - (first or 0)) / 600).cast("long").alias("t")).agg(F.max("value").alias("v"))
    levels = me.measure_threshold(held, 50.0, None, stop, ("base",))
    named = levels.select(F.concat_ws(".", F.lit("threshold"), "sibling", "base").alias("signal"), "base", "t0", "t1", F.lit(1.0).alias("v"))
    m = re_.interval_moments(named, [-1, 0], SIZE, base="base", end=stop)
    rows = mt.with_metrics(m).select("x", "y", "delta", "u", r9("dep"), r9("cov"))
    out = re_.with_siblings(rows, levels, SIZE, stop, base_of=lambda c: me.split_measure_name(c)["base"])
    return out.select("x", "y", "delta", F.col("u").cast("long").alias("u"), "dep", "cov", *[r9(f"e{a}_{k}") for a in ("x", "y") for k in re_.SIBLINGS])


_LADDER = """ld(factor, delta) AS (VALUES (1, -2), (1, -1), (1, 0), (1, 1), (2, -6), (2, -4), (2, 2), (2, 4), (4, -14), (4, -10), (4, 6), (4, 10), (8, -16), (8, 14)),
du AS (SELECT signal, v, t - u + 16 AS r, u, factor FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((t - 80) / 64.0) AS BIGINT)), (t + 16) // 64 + 1)) * 64 AS u FROM s), (SELECT DISTINCT factor FROM ld)),
cs AS (SELECT signal, v, u, factor, r // factor AS b FROM du WHERE r % factor = xor((r // factor) & (factor - 1), ('0x' || substr(md5('3|' || signal), 1, 8))::BIGINT % factor)),
cx AS (SELECT * FROM cs WHERE b >= 16 // factor AND b < 16 // factor + 64 // factor), cy AS (SELECT cs.* EXCLUDE b, delta, b - floor(delta / factor)::BIGINT AS b FROM cs JOIN ld USING (factor) WHERE u + delta >= 0),
xe AS (SELECT signal AS x, u, factor, sum(v) / any_value(64 // factor) AS ex, sum(v * v) / any_value(64 // factor) AS exx FROM cx GROUP BY ALL),
ye AS (SELECT signal AS y, u, factor, delta, sum(v) / any_value(64 // factor) AS ey, sum(v * v) / any_value(64 // factor) AS eyy FROM cy WHERE b >= 16 // factor AND b < 16 // factor + 64 // factor GROUP BY ALL),
je AS (SELECT cx.signal AS x, cy.signal AS y, cx.u, cx.factor, delta, sum(cx.v * cy.v) / any_value(64 // cx.factor) AS exy, sum(least(cx.v, cy.v)) / any_value(64 // cx.factor) AS emin FROM cx JOIN cy ON cx.u = cy.u AND cx.factor = cy.factor AND cx.b = cy.b AND cx.signal <> cy.signal GROUP BY ALL),
us AS (SELECT u FROM xe UNION SELECT u FROM ye), sg AS (SELECT DISTINCT signal FROM s),
m AS (SELECT a.signal AS x, b.signal AS y, ld.factor, ld.delta, us.u, coalesce(ex, 0) AS ex, coalesce(ey, 0) AS ey, coalesce(exy, 0) AS exy, coalesce(exx, 0) AS exx, coalesce(eyy, 0) AS eyy, coalesce(emin, 0) AS emin FROM us JOIN ld ON us.u + ld.delta >= 0 CROSS JOIN sg a JOIN sg b ON a.signal <> b.signal
  LEFT JOIN xe ON xe.x = a.signal AND xe.u = us.u AND xe.factor = ld.factor LEFT JOIN ye ON ye.y = b.signal AND ye.u = us.u AND ye.factor = ld.factor AND ye.delta = ld.delta LEFT JOIN je ON je.x = a.signal AND je.y = b.signal AND je.u = us.u AND je.factor = ld.factor AND je.delta = ld.delta)"""
_K = "k AS (" + _MOMENTS.split("k AS (")[1]


def _ladder(spark: SparkSession) -> DataFrame:
    return rs.shift_set(spark, SIZE, 16, 16, 2)


@query(f"WITH {_S}, {_LADDER}, {_K} SELECT x, y, factor::BIGINT AS factor, delta::BIGINT AS delta, u, round(ex, 9) AS ex, round(ey, 9) AS ey, {_SHOW} FROM k WHERE dep > 0.05 AND cov > 0.02")
def ladder_edges(spark, d):
    e = re_.ladder_edges(occurrences_of(spark, d), _ladder(spark), SIZE, 16, 16, "dep", 0.05, "cov", 0.02, seed=3)
    return e.select("x", "y", "factor", "delta", "u", r9("ex"), r9("ey"), *map(r9, mt.METRICS))


@query(f"WITH {_S}, {_LADDER}, {_K} SELECT x, y, factor::BIGINT AS factor, delta::BIGINT AS delta, u, round(ham, 9) AS ham FROM k WHERE ham > 0.9")
def ladder_edges_hamming(spark, d):
    """A metric that pairs which never meet can pass."""
    return re_.ladder_edges(occurrences_of(spark, d), _ladder(spark), SIZE, 16, 16, "ham", 0.9, seed=3).select("x", "y", "factor", "delta", "u", r9("ham"))



# half-hour windows over seconds: each event type's value is held until the type's next event
_HELD = f"""hv AS (SELECT event_type AS signal, (epoch_us(ts) // 1000000)::BIGINT AS t, floor(least(1, max(value) / 100) * 64) / 64 AS v FROM events GROUP BY ALL), ev AS (SELECT max(t) + 1 AS stop FROM hv),
iv AS (SELECT signal, t AS t0, coalesce(lead(t) OVER (PARTITION BY signal ORDER BY t), stop) AS t1, v FROM hv, ev QUALIFY v <> 0),
sh AS (SELECT signal, delta, greatest(0, t0 - delta) AS t0, t1 - delta AS t1, v FROM iv, (SELECT unnest([0, 900]) AS delta) WHERE t1 - delta > 0),
xw AS (SELECT *, unnest(range(t0 // 1800, (t1 - 1) // 1800 + 1)) * 1800 AS u FROM iv), yw AS (SELECT *, unnest(range(t0 // 1800, (t1 - 1) // 1800 + 1)) * 1800 AS u FROM sh),
xs AS (SELECT signal AS x, u, sum((least(t1, u + 1800) - greatest(t0, u)) * v) / 1800 AS ex FROM xw GROUP BY ALL), ys AS (SELECT signal AS y, delta, u, sum((least(t1, u + 1800) - greatest(t0, u)) * v) / 1800 AS ey FROM yw GROUP BY ALL),
jt AS (SELECT a.signal AS x, b.signal AS y, b.delta, a.u, sum(w * a.v * b.v) / 1800 AS exy, sum(w * least(a.v, b.v)) / 1800 AS emin
  FROM (SELECT a.*, b.signal, b.delta, b.v, least(a.t1, b.t1, a.u + 1800) - greatest(a.t0, b.t0, a.u) AS w FROM xw a JOIN yw b ON a.u = b.u AND a.signal <> b.signal AND a.t0 < b.t1 AND b.t0 < a.t1) z(signal, t0, t1, v, u, signal_b, delta, v_b, w), LATERAL (SELECT z.signal, z.v, z.u) a, LATERAL (SELECT z.signal_b AS signal, z.delta, z.v_b AS v) b WHERE w > 0 GROUP BY ALL)"""


@query(f"WITH {_HELD} SELECT x, y, delta::BIGINT AS delta, jt.u, round(ex * 115200)::BIGINT AS ex, round(ey * 115200)::BIGINT AS ey, round(exy * 7372800)::BIGINT AS exy, round(emin * 115200)::BIGINT AS emin FROM jt JOIN xs USING (x, u) JOIN ys USING (y, delta, u)")
def interval_moments(spark, d):
    """Values are 64ths, so that means over 1,800 ticks are whole numbers of the units shown."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("signal"), _seconds("ts").cast("long").alias("t")).agg((F.floor(F.least(F.lit(1.0), F.max("value") / 100) * 64) / 64).alias("v"))
    stop = e.agg(F.max("t")).first()[0] or 0
    m = re_.interval_moments(sa.hold(e, stop + 1), [0, 900], 1800, frame=False)
    return m.select("x", "y", "delta", "u", *[F.round(F.col(c) * n).cast("long").alias(c) for c, n in (("ex", 115200), ("ey", 115200), ("exy", 7372800), ("emin", 115200))])


_AP = """e AS (SELECT label AS system, vec_id AS idx, unnest(range(len(embedding))) AS t, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT system, idx, t, (least(greatest(x, -1), 1) + 1) / 2 AS v FROM e), n AS (SELECT max(t) + 1 AS n FROM e),
o AS (SELECT system, idx, sum(v) / any_value(n) AS e1, sum(v * v) / any_value(n) AS e2 FROM s, n GROUP BY ALL),
j AS (SELECT a.system, a.idx AS x, b.idx AS y, sum(a.v * b.v) / any_value(n) AS exy, sum(least(a.v, b.v)) / any_value(n) AS emin FROM s a JOIN s b ON a.system = b.system AND a.t = b.t AND a.idx < b.idx, n GROUP BY ALL),
m AS (SELECT j.*, p.e1 AS ex, p.e2 AS exx, q.e1 AS ey, q.e2 AS eyy FROM j JOIN o p ON p.system = j.system AND p.idx = x JOIN o q ON q.system = j.system AND q.idx = y)"""


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("system"), F.col("vec_id").alias("idx"), F.posexplode("embedding").alias("t", "x"))
    return e.select("system", "idx", "t", sc.clip_norm("x", -1, 1).alias("v"))


@query(f"WITH {_AP} SELECT system, x, y, round(1 - (ex + ey - 2 * emin), 6) AS ham, round(exy / (ex + ey - exy), 6) AS tmt, round(1 - sqrt(greatest(0, exx + eyy - 2 * exy)), 6) AS cls, round(least(1, exy / (sqrt(exx) * sqrt(eyy))), 6) AS cos, round(4 * abs(exy - ex * ey), 6) AS cov, round(CASE WHEN exy / ey > ex THEN (exy / ey - ex) / (exy / ey) ELSE 0 END, 6) AS dep FROM m")
def all_pairs_vectors(spark, d):
    v = _vectors(spark, d)
    n = v.agg(F.max("t")).first()[0] + 1
    return re_.all_pairs(v, n).select("system", "x", "y", *map(r6, ("ham", "tmt", "cls", "cos", "cov", "dep")))


# measures

_TH = f"{_V}, x AS (SELECT signal, t, (CASE WHEN %s THEN 1 ELSE 0 END) AS v FROM v), g AS (SELECT *, lag(v, 1, 0) OVER w AS b, lead(t) OVER w AS nx, row_number() OVER w AS n FROM x WINDOW w AS (PARTITION BY signal ORDER BY t))"
_SIB = """ SELECT signal, 'orig' AS sibling, t AS t0, coalesce(nx, -1) AS t1 FROM g WHERE v = 1 UNION ALL SELECT signal, 'refl', t, coalesce(nx, -1) FROM g WHERE v = 0 UNION ALL SELECT signal, 'refl', 0, t FROM g WHERE n = 1 AND t > 0
UNION ALL SELECT signal, 'rise', t, t + 1 FROM g WHERE v = 1 AND b = 0 UNION ALL SELECT signal, 'fall', t, t + 1 FROM g WHERE v = 0 AND b = 1"""

for _n, (_g, _l, _c) in {"threshold_inside": (20.0, 60.0, "v >= 20 AND v <= 60"), "threshold_outside": (60.0, 20.0, "v >= 60 OR v <= 20"), "threshold_geq": (50.0, None, "v >= 50"), "threshold_leq": (None, 50.0, "v <= 50")}.items():
    query(f"WITH {_TH % _c}{_SIB}", _n)(lambda spark, d, g=_g, l=_l: me.measure_threshold(user_values(spark, d), g, l).na.fill(-1, ["t1"]))


@query(f"WITH {_TH % 'v >= 50'} SELECT signal, t, v, (v = 1 AND b = 0)::INT AS rise, (v = 0 AND b = 1)::INT AS fall FROM g")
def edges(spark, d):
    return me.edges(user_values(spark, d).withColumn("v", me.threshold(F.col("v"), geq=50.0)), block=1 << 16)


_DAILY = "dy AS (SELECT l_returnflag AS signal, (epoch_us(l_shipdate) // 86400000000)::BIGINT AS t, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def daily(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("signal"), _days("l_shipdate").alias("t")).agg(F.sum("l_quantity").alias("v"))


@query(f"WITH {_DAILY} SELECT signal, t, round(0.25 * (v + coalesce(lag(v, 1) OVER w, 0) + coalesce(lag(v, 2) OVER w, 0) + coalesce(lag(v, 3) OVER w, 0)), 6) AS smooth FROM dy WINDOW w AS (PARTITION BY signal ORDER BY t)")
def normal_fir(spark, d):
    return me.fir(daily(spark, d), [0.25] * 4).select("signal", "t", F.round("smooth", 6).alias("smooth"))


@query(f"""WITH {_DAILY}, h AS (SELECT signal, t AS t0, lead(t) OVER (PARTITION BY signal ORDER BY t) AS t1, v FROM dy),
k AS (SELECT signal, t0, t1, unnest(range(t0, least(coalesce(t1, t0 + 2), t0 + 2))) AS tk FROM h),
s AS (SELECT k.signal, k.tk, k.t0, k.t1, coalesce(max(a.v), 0) AS a, coalesce(max(b.v), 0) AS b FROM k
  LEFT JOIN h a ON a.signal = k.signal AND a.t0 <= k.tk AND (a.t1 IS NULL OR a.t1 > k.tk) LEFT JOIN h b ON b.signal = k.signal AND b.t0 <= k.tk - 1 AND (b.t1 IS NULL OR b.t1 > k.tk - 1) GROUP BY ALL)
SELECT signal, tk AS t0, coalesce(CASE WHEN tk < s.t0 + 1 THEN tk + 1 ELSE t1 END, -1) AS t1, round(least(greatest(0.5 * a + 0.5 * b, 0), 2000) / 2000, 9) AS v FROM s""")
def normal_measure(spark, d):
    return me.measure_normal(daily(spark, d), 0.0, 2000.0, [0.5, 0.5]).na.fill(-1, ["t1"]).select("signal", "t0", "t1", r9("v"))


@query(f"WITH {_V} SELECT signal, (t - 1600000000) // 60 AS t, v FROM v WHERE t >= 1600000000 AND t <= 1900000000 AND t % 60 = 0")
def sample_filter(spark, d):
    return me.sample_filter(user_values(spark, d), 1600000000, 1900000000, 60).select("signal", "t", "v")


@query("SELECT event_id, (value >= 1)::INT AS any_set, ((CAST(value AS BIGINT) >> 3) & 1)::INT AS bit3 FROM (SELECT event_id, floor(value) AS value FROM events)")
def decode_state(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("b"), F.bin(F.floor("value").cast("long"))).alias("raw"))
    return e.select("event_id", me.decode_state(F.col("raw")).alias("any_set"), me.decode_state(F.col("raw"), 3).alias("bit3"))


@query("""WITH n AS (SELECT DISTINCT event_type AS base, unnest(['event', 'bstate', 'threshold', 'normal']) AS mtype FROM events), x AS (SELECT base, mtype, unnest(CASE WHEN mtype IN ('event', 'normal') THEN ['orig'] ELSE ['orig', 'refl', 'rise', 'fall'] END) AS sibling FROM n)
SELECT mtype, sibling, base, mtype || '.' || sibling || '.' || base AS name FROM x""")
def sibling_names(spark, d):
    n = table(spark, d, "events").select(F.col("event_type").alias("base")).distinct().withColumn("mtype", F.explode(F.array(*map(F.lit, ("event", "bstate", "threshold", "normal")))))
    named = me.sibling_names(n).select("name").withColumn("p", me.split_measure_name(F.col("name")))
    return named.select("p.mtype", "p.sibling", "p.base", "name")


_NODE = f"""{_TH % 'v >= 50'}, mx AS (SELECT max(t) + 1 AS mt FROM v), iv AS (SELECT signal, t AS t0, coalesce(nx, mt) AS t1, v, b FROM g, mx)"""


@query(f"""WITH {_S}, p AS (SELECT signal AS base, t, lag(t) OVER (PARTITION BY signal ORDER BY t) AS before, lead(t) OVER (PARTITION BY signal ORDER BY t) AS after FROM s),
k AS (SELECT base, t, 1.0 AS o, (before IS NULL OR before < t - 1)::INT::DOUBLE AS r, 0.0 AS f FROM p UNION ALL SELECT base, t + 1, 0.0, 0.0, 1.0 FROM p WHERE after IS NULL OR after > t + 1),
m AS (SELECT base, (t // 64) * 64 AS u, sum(o) / 64 AS eo, sum(r) / 64 AS er, sum(f) / 64 AS ef FROM k GROUP BY ALL)
SELECT base, u, round(eo, 9) AS e_orig, round(1 - eo, 9) AS e_refl, round(er, 9) AS e_rise, round(CASE WHEN eo <> 0 THEN er / eo END, 9) AS cex_rise_orig, round(CASE WHEN 1 - eo <> 0 THEN ef / (1 - eo) END, 9) AS cex_fall_refl, round(4 * abs(eo - eo * eo), 9) AS cov_orig FROM m""")
def node_stats(spark, d):
    from pyspark.sql import Window

    s = occurrences_of(spark, d)
    w = Window.partitionBy("signal").orderBy("t")
    p = s.withColumn("before", F.lag("t").over(w)).withColumn("after", F.lead("t").over(w))
    kinds = F.array(F.struct(F.lit("orig").alias("kind"), F.col("t").alias("t")), F.when(F.col("before").isNull() | (F.col("before") < F.col("t") - 1), F.struct(F.lit("rise").alias("kind"), F.col("t").alias("t"))), F.when(F.col("after").isNull() | (F.col("after") > F.col("t") + 1), F.struct(F.lit("fall").alias("kind"), (F.col("t") + 1).alias("t"))))
    k = p.select(F.col("signal").alias("base"), F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("k")).select("base", "k.kind", "k.t", F.lit(1.0).alias("v"))
    out = re_.node_stats(k, SIZE)
    return out.select("base", "u", *map(r9, ("e_orig", "e_refl", "e_rise", "cex_rise_orig", "cex_fall_refl", "cov_orig")))


@query(f"WITH {_TH % 'v >= 50'} SELECT signal, t AS t0, coalesce(nx, -1) AS t1, 1.0::DOUBLE AS v FROM g WHERE v = 1")
def event_levels(spark, d):
    levels = user_values(spark, d).withColumn("v", me.threshold(F.col("v"), geq=50.0))
    return me.measure_event(levels, level=True).na.fill(-1, ["t1"])


# evaluation

_SC = """round(tp / nullif(tp + fn, 0), 9) AS tpr, round(tn / nullif(tn + fp, 0), 9) AS tnr, round(tp / nullif(tp + fp, 0), 9) AS ppv, round(tn / nullif(tn + fn, 0), 9) AS npv, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 9) AS acc,
round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 9) AS bacc, round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 9) AS mcc, round(tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0) - 1, 9) AS bmi"""
_CF = "count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS tp, count(*) FILTER (quality <> 1 AND toxic = 1)::DOUBLE AS fp, count(*) FILTER (quality = 1 AND toxic <> 1)::DOUBLE AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1)::DOUBLE AS tn"


@query(f"WITH c AS (SELECT lang, {_CF} FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT lang, tp, fp, fn, tn, {_SC} FROM c")
def confusion_stats(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return ev.confusion(j, "quality", "toxic", ["lang"]).select("lang", "tp", "fp", "fn", "tn", *map(r9, ev.SCORES))


@query(f"WITH c AS (SELECT lang, source, {_CF} FROM labels JOIN documents USING (doc_id) GROUP BY CUBE (lang, source)) SELECT lang, source, tp, fp, fn, tn, {_SC} FROM c")
def confusion_cube(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return ev.confusion(j, "quality", "toxic", ["lang", "source"], cube=True).select("lang", "source", "tp", "fp", "fn", "tn", *map(r9, ev.SCORES))


_KNOWN = """uu AS (SELECT DISTINCT event_type AS e, user_id FROM events), kn AS (SELECT a.e AS x, b.e AS y FROM uu a JOIN uu b ON a.user_id = b.user_id AND a.e < b.e GROUP BY ALL HAVING count(*) > 60),
lb AS (SELECT k.u AS system, k.x, k.y, ex, ey, exy, 1 - ham AS ediff, cex AS cex_xy, CASE WHEN ex <> 0 THEN exy / ex END AS cex_yx, ham, tmt, cls, cos, cov, dep, (kn.x IS NOT NULL)::INT AS known FROM k LEFT JOIN kn ON kn.x = k.x AND kn.y = k.y WHERE k.x < k.y AND k.delta = 0)"""


def labelled(spark, d):
    """Pairs of event types in each window, known where more than 60 users have both; a window is a system."""
    m = ev.with_features(re_.pair_moments(occurrences_of(spark, d), [0], SIZE)).where("x < y")
    uu = table(spark, d, "events").select(F.col("event_type").alias("e"), "user_id").distinct()
    known = uu.select(F.col("e").alias("x"), "user_id").join(uu.select(F.col("e").alias("y"), "user_id"), "user_id").where("x < y").groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 60")
    return ev.label_pairs(m, known).withColumnRenamed("u", "system")


@query(f"WITH {_MOMENTS}, {_KNOWN} SELECT system, x, y, known, round(tmt, 9) AS tmt FROM lb")
def label_pairs(spark, d):
    return labelled(spark, d).select("system", "x", "y", "known", r9("tmt"))


_SOFT = """lg AS (SELECT system, known, 'tmt' AS metric, tmt AS est FROM lb UNION ALL SELECT system, known, 'cos', cos FROM lb UNION ALL SELECT system, known, 'dep', dep FROM lb),
sf AS (SELECT system, metric, sum(least(known, est)) AS tp, sum(least(1 - known, est)) AS fp, sum(least(known, 1 - est)) AS fn, sum(least(1 - known, 1 - est)) AS tn FROM lg GROUP BY ALL),
ss AS (SELECT *, tp / nullif(tp + fn, 0) AS tpr_, tn / nullif(tn + fp, 0) AS tnr_, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS acc_ FROM sf)"""


@query(f"WITH {_MOMENTS}, {_KNOWN}, {_SOFT} SELECT system, metric, round(tp, 9) AS tp, round(fp, 9) AS fp, round(fn, 9) AS fn, round(tn, 9) AS tn, round(tpr_, 9) AS tpr, round(acc_, 9) AS acc FROM ss")
def soft_confusion(spark, d):
    return ev.soft_confusion(labelled(spark, d), ["tmt", "cos", "dep"]).select("system", "metric", *map(r9, ("tp", "fp", "fn", "tn", "tpr", "acc")))


_KIND = "CASE WHEN (system // 64) % 2 = 0 THEN 'even' ELSE 'odd' END"


@query(f"WITH {_MOMENTS}, {_KNOWN}, {_SOFT} SELECT {_KIND} AS system_type, metric, round(avg(tpr_), 9) AS tpr, round(avg(tnr_), 9) AS tnr, round(avg(acc_), 9) AS acc FROM ss GROUP BY GROUPING SETS (({_KIND}, metric), (metric))")
def score_summary(spark, d):
    s = ev.soft_confusion(labelled(spark, d), ["tmt", "cos", "dep"])
    s = s.withColumn("system_type", F.when(F.floor(F.col("system") / SIZE) % 2 == 0, "even").otherwise("odd"))
    return ev.score_summary(s, names=("tpr", "tnr", "acc")).select("system_type", "metric", *map(r9, ("tpr", "tnr", "acc")))


@query(f"WITH {_MOMENTS}, {_KNOWN}, {_SOFT} SELECT metric, 'acc' AS score, least(10, floor(acc_ * 10) + 1)::BIGINT AS bin, count(*) AS n FROM ss WHERE acc_ IS NOT NULL GROUP BY ALL")
def score_density(spark, d):
    s = ev.soft_confusion(labelled(spark, d), ["tmt", "cos", "dep"])
    return ev.score_density(s, 10, ("acc",))


_EXPORTED = ("ex", "ey", "cex_xy", "cex_yx", "exy", "ediff", "ham", "tmt", "cls", "cos", "cov", "dep")


@query(f"WITH {_MOMENTS}, {_KNOWN} SELECT system, x, y, known, " + ", ".join(f"printf('%.6f', coalesce(round(round({c}, 9), 6), 0)) AS {c}" for c in _EXPORTED) + " FROM lb")
def export_pairs(spark, d):
    return ev.export_pairs(labelled(spark, d).select("system", "x", "y", "known", *[F.round(F.round(c, 9), 6).alias(c) for c in _EXPORTED]))


@query("SELECT o_custkey AS system, least(l_suppkey, 1000 + l_partkey) AS x, greatest(l_suppkey, 1000 + l_partkey) AS y FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def known_pairs(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return ev.known_pairs(j.select(F.col("o_custkey").alias("system"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")), 1000)


@query(f"WITH {_MOMENTS}, {_KNOWN}, h AS (SELECT system, x, y, least(1, greatest(0, (2 * tmt - cos + 0.1) / 4 + 0.5)) AS a, greatest(0, 0.5 * tmt + cos - 0.2) AS b FROM lb) SELECT system, x, y, round(1 / (1 + exp(-(1.5 * a - 0.5 * b + 0.05))), 9) AS score FROM h")
def score_model(spark, d):
    s = labelled(spark, d)
    one = ev.score_model(s, ["tmt", "cos"], [[[2.0], [-1.0]]], [[0.1]], ["qsig"], "a")
    two = ev.score_model(one, ["tmt", "cos"], [[[0.5], [1.0]]], [[-0.2]], ["relu"], "b")
    return ev.score_model(two, ["a", "b"], [[[1.5], [-0.5]]], [[0.05]], ["sigmoid"]).select("system", "x", "y", r9("score"))


@query()
def fit_model(spark, d):
    s = labelled(spark, d)
    model, bmi, names = ev.fit_model(s, "fullAssist", iterations=20, seeds=(1,))
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=names, outputCol="features").transform(s.na.fill(0.0, names))
    return model.transform(x).select("system", "x", "y", "known", F.col("prediction").cast("int").alias("predicted"))


def _held_out() -> F.Column:
    """Each fourth window; a function, as columns can't be made before there is a session."""
    return F.floor(F.col("system") / SIZE) % 4 == 3


def shared_users(spark, d):
    """Pairs of event types in each window, known where a fifth of the users of one type have the other in that window too."""
    m = ev.with_features(re_.pair_moments(occurrences_of(spark, d), [0], SIZE)).where("x < y").withColumnRenamed("u", "system")
    tick = F.floor(_seconds("ts") / TICK).cast("long")
    uu = table(spark, d, "events").where("user_id is not null").select((tick - F.pmod(tick, F.lit(SIZE))).alias("system"), F.col("event_type").alias("e"), "user_id").distinct()
    n = uu.groupBy("system", "e").agg(F.count("*").alias("n"))
    both = uu.select("system", "user_id", F.col("e").alias("x")).join(uu.select("system", "user_id", F.col("e").alias("y")), ["system", "user_id"]).where("x < y").groupBy("system", "x", "y").agg(F.count("*").alias("both"))
    known = both.join(n.select("system", F.col("e").alias("x"), F.col("n").alias("nx")), ["system", "x"]).join(n.select("system", F.col("e").alias("y"), F.col("n").alias("ny")), ["system", "y"])
    return ev.label_pairs(m, known.where("5 * both >= least(nx, ny)"), ("system", "x", "y"))


@query()
def informedness_sweep(spark, d):
    """Every set of inputs with every net of the sweep, trained by informedness; each fourth window is held out."""
    return le.sweep_table(spark, le.train_nets(shared_users(spark, d), le.sweep(), held_out=_held_out(), steps=40))


@query()
def learned_metric(spark, d):
    """The best of three nets as one more metric of every pair."""
    s = shared_users(spark, d)
    trained = le.train_nets(s, le.sweep(("withAssist",), le.NETS[-4:-1]), held_out=_held_out(), steps=40)
    best = max(trained, key=lambda t: -2.0 if t["informedness"] is None else t["informedness"])
    return best["net"].score(s, "learned").select("system", "x", "y", "known", "learned")


# joins

_AS = "o AS (SELECT o_custkey AS k, (epoch_us(o_orderdate) // 3600000000)::BIGINT AS t, max(o_totalprice) AS v FROM orders GROUP BY ALL), e AS (SELECT DISTINCT user_id AS k, (epoch_us(ts) // 3600000000)::BIGINT AS t FROM events)"


def _asof(spark, d, direction):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.floor(_seconds("o_orderdate") / 3600).cast("long").alias("t")).agg(F.max("o_totalprice").alias("v"))
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), F.floor(_seconds("ts") / 3600).cast("long").alias("t")).distinct()
    return sa.asof(e, o, ["k"], direction).na.fill(-1, ["change_t"])


@query(f"WITH {_AS} SELECT e.k, e.t, coalesce(o.t, -1) AS change_t, o.v AS change_v FROM e ASOF LEFT JOIN o ON e.k = o.k AND e.t >= o.t")
def asof_prev(spark, d):
    return _asof(spark, d, "previous")


@query(f"WITH {_AS} SELECT e.k, e.t, coalesce(o.t, -1) AS change_t, o.v AS change_v FROM e ASOF LEFT JOIN o ON e.k = o.k AND e.t <= o.t")
def asof_next(spark, d):
    return _asof(spark, d, "next")


@query(f"""WITH {_S}, i AS (SELECT signal, t AS t0, lead(t) OVER (PARTITION BY signal ORDER BY t) AS t1 FROM s)
SELECT a.signal AS x, b.signal AS y, greatest(a.t0, b.t0) AS t0, coalesce(least(a.t1, b.t1), -1) AS t1 FROM i a JOIN i b ON a.signal < b.signal AND a.t0 < coalesce(b.t1, a.t0 + 1) AND b.t0 < coalesce(a.t1, b.t0 + 1)""")
def interval_overlap(spark, d):
    i = sa.hold(occurrences_of(spark, d), block=1024)
    return sa.interval_overlap(i, i, 8).where("x < y").select("x", "y", "t0", "t1").na.fill(-1, ["t1"])


def _two(spark, d):
    s = occurrences_of(spark, d)
    return (s.where(F.col("signal") == n).select("t", "v") for n in ("click", "purchase"))


_XY = f"{_S}, x AS (SELECT t, v FROM s WHERE signal = 'click'), y AS (SELECT t, v FROM s WHERE signal = 'purchase')"


@query(f"WITH {_XY} SELECT x.t, x.v * y.v AS v FROM x JOIN y ON x.t = y.t")
def occur_intersect(spark, d):
    return sa.occur_intersect(*_two(spark, d))


@query(f"WITH {_XY} SELECT t, max(v) AS v FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY t")
def occur_union(spark, d):
    return sa.occur_union(*_two(spark, d))


@query(f"WITH {_XY} SELECT coalesce(x.t, y.t) AS t, abs(coalesce(x.v, 0) - coalesce(y.v, 0)) AS v FROM x FULL JOIN y ON x.t = y.t WHERE coalesce(x.v, 0) <> coalesce(y.v, 0)")
def occur_symdiff(spark, d):
    return sa.occur_symdiff(*_two(spark, d))


@query(f"""WITH {_S}, n AS (SELECT signal, row_number() OVER (ORDER BY signal) AS r FROM (SELECT DISTINCT signal FROM s)), p AS (SELECT t, max((r = 1)::INT) AS a, max((r = 2)::INT) AS b, max((r = 3)::INT) AS c, count(*) AS every, count(*) FILTER (r > 3) AS later FROM s JOIN n USING (signal) GROUP BY t),
q AS (SELECT t, (greatest(least(a, b), c) + later) % 2 AS m, every % 2 AS x, CASE WHEN every > 0 THEN 1 ELSE 0 END AS o FROM p)
SELECT 'mixed' AS signal, t, m AS v FROM q WHERE m = 1 UNION ALL SELECT 'xor', t, x FROM q WHERE x = 1 UNION ALL SELECT 'or', t, o FROM q""")
def derive_signals(spark, d):
    from pyspark.sql import Window

    s = occurrences_of(spark, d)
    n = s.select("signal").distinct().withColumn("r", F.row_number().over(Window.orderBy("signal")))
    mixed = F.when(F.col("r") <= 2, "and").when(F.col("r") == 3, "or").otherwise("xor")
    con = n.withColumn("dst", F.explode(F.array(*map(F.lit, ("mixed", "xor", "or")))))
    con = con.select("dst", F.col("r").alias("ord"), F.col("signal").alias("src"), F.when(F.col("dst") == "mixed", mixed).otherwise(F.col("dst")).alias("op"))
    return sa.derive_signals(s, con)


# change logs

_CH = "c AS (SELECT user_id::VARCHAR AS var_id, (epoch_us(ts) // 60000000)::BIGINT AS t, event_id AS seq, event_type AS raw FROM events), l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY var_id, t ORDER BY seq DESC) = 1)"


def log(spark, d):
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("var_id"), F.floor(_seconds("ts") / 60).cast("long").alias("t"), F.col("event_id").alias("seq"), F.col("event_type").alias("raw"))


@query(f"WITH {_CH} SELECT * FROM l QUALIFY lag(raw) OVER (PARTITION BY var_id ORDER BY t) IS DISTINCT FROM raw OR row_number() OVER (PARTITION BY var_id ORDER BY t) = 1")
def clean_changes(spark, d):
    return ch.clean_changes(log(spark, d), drop_redundant=True)


@query(f"WITH {_CH} SELECT * FROM l", "clean_changes_keep")
def _keep(spark, d):
    return ch.clean_changes(log(spark, d))


@query(f"WITH {_CH}, g AS (SELECT *, lag(raw) OVER (PARTITION BY var_id ORDER BY t, seq) IS DISTINCT FROM raw AS new FROM c), a AS (SELECT var_id, count(*) AS changes, sum(new::INT)::BIGINT AS toggles, min(t) AS first_t, max(t) AS last_t FROM g GROUP BY var_id) SELECT *, rank() OVER (ORDER BY changes DESC) AS rank FROM a")
def describe_changes(spark, d):
    return ch.describe_changes(log(spark, d))


@query(f"WITH {_CH}, a AS (SELECT t, count(*) AS changes FROM c GROUP BY t) SELECT *, row_number() OVER (ORDER BY t) - 1 AS number FROM a")
def describe_chunks(spark, d):
    return ch.describe_chunks(log(spark, d))


_OS = "x AS (SELECT o_custkey AS k, (epoch_us(o_orderdate) // 86400000000)::BIGINT AS t, max(CASE WHEN o_orderstatus = 'F' THEN 'yes' WHEN o_orderstatus = 'O' THEN 'no' ELSE 'unknown' END) AS f, max(floor(o_totalprice / 1000))::BIGINT AS p FROM orders GROUP BY ALL)"


def _wide(spark, d):
    s = F.col("o_orderstatus")
    word = F.when(s == "F", "yes").when(s == "O", "no").otherwise("unknown")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), _days("o_orderdate").alias("t")).agg(F.max(word).alias("f"), F.max(F.floor(F.col("o_totalprice") / 1000)).cast("long").alias("p"))


_KINDS = {"f": ("wire", 1), "p": ("reg", 16)}
_W2C = f"""{_OS}, w AS (SELECT k, t, 'f' AS var_id, CASE f WHEN 'yes' THEN '1' WHEN 'no' THEN '0' ELSE 'x' END AS raw FROM x UNION ALL SELECT k, t, 'p', 'b' || bin(p) FROM x),
cg AS (SELECT * FROM w QUALIFY lag(raw) OVER (PARTITION BY k, var_id ORDER BY t) IS DISTINCT FROM raw)"""


@query(f"WITH {_W2C} SELECT * FROM cg")
def wide_to_changes(spark, d):
    return ch.wide_to_changes(_wide(spark, d), _KINDS, "t", keys=("k",))


@query(f"""WITH {_W2C}, pv AS (SELECT k, t, max(CASE WHEN var_id = 'f' THEN raw END) AS f, max(CASE WHEN var_id = 'p' THEN '0x' || lower(hex(('0b' || raw[2:])::BIGINT)) END) AS p FROM (SELECT k, t, var_id, raw FROM cg) GROUP BY ALL)
SELECT k, t, coalesce(last_value(f IGNORE NULLS) OVER w, '-') AS f, coalesce(last_value(p IGNORE NULLS) OVER w, '-') AS p FROM pv WINDOW w AS (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""".replace("lower(hex(('0b' || raw[2:])::BIGINT))", "printf('%x', (SELECT p FROM x WHERE x.k = q.k AND x.t = q.t))").replace("FROM (SELECT k, t, var_id, raw FROM cg)", "FROM cg q"))
def changes_to_wide(spark, d):
    c = ch.wide_to_changes(_wide(spark, d), _KINDS, "t", keys=("k",))
    return ch.changes_to_wide(c, _KINDS, ("k",))


@query(f"WITH {_CH}, n AS (SELECT t, var_id, raw, row_number() OVER (PARTITION BY t ORDER BY seq, var_id, raw) - 1 AS seq FROM c) SELECT t, seq, var_id, raw FROM n")
def nest_unnest(spark, d):
    lines = ch.to_json_lines(ch.nest_changes(log(spark, d)))
    return ch.unnest_changes(ch.from_json_lines(lines))


for _keep_, _row, _place in (("first", "ASC", "min"), ("last", "DESC", "min"), ("moved", "DESC", "max")):
    query(f"SELECT user_id, event_id, event_type, {_place}(event_id) OVER (PARTITION BY user_id) AS place FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id {_row}) = 1", f"dedupe_{_keep_}")(
        lambda spark, d, keep=_keep_: se.dedupe(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", keep)
    )

# resampling and series


for _m, _f in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max")):
    query(f"WITH {_DAILY} SELECT signal, t // 7 AS t, round({_f}(v)::DOUBLE, 9) AS v FROM dy GROUP BY signal, t // 7", f"downsample_{_m}")(lambda spark, d, m=_m: rs.downsample(daily(spark, d), 7, m).select("signal", "t", r9("v")))

_NUM = f"{_DAILY}, nb AS (SELECT signal, row_number() OVER (PARTITION BY signal ORDER BY t) - 1 AS t, v FROM dy), ct AS (SELECT signal, count(*) AS n, (7 - count(*) % 7) % 7 AS miss, avg(v) AS mean FROM nb GROUP BY signal)"


def _numbered(spark, d):
    from pyspark.sql import Window

    return daily(spark, d).withColumn("t", F.row_number().over(Window.partitionBy("signal").orderBy("t")) - 1)


_DRAWN = "('0x' || substr(md5({}), 1, 8))::BIGINT"
# rows with the last block filled up by mirrored ones, blocks, and the drawn place in each
_SUB = f"""{_DAILY}, nb AS (SELECT signal, row_number() OVER (PARTITION BY signal ORDER BY t) - 1 AS t, v FROM dy), ct AS (SELECT signal, count(*) AS n, (8 - count(*) % 8) % 8 AS miss FROM nb GROUP BY signal),
pd AS (SELECT * FROM nb UNION ALL SELECT signal, 2 * (n - 1) - t, v FROM nb JOIN ct USING (signal) WHERE 2 * (n - 1) - t BETWEEN n AND n + miss - 1)"""


@query(f"WITH {_SUB} SELECT signal, t // 8 AS t, v FROM pd WHERE t % 8 = xor((t // 8) & 7, {_DRAWN.format("'5|' || signal")} % 8)")
def subsample_xor(spark, d):
    return rs.subsample(_numbered(spark, d), 8, "xor", 5, padding="reflect")


@query(f"WITH {_SUB} SELECT signal, t // 8 AS t, v FROM pd WHERE t % 8 = {_DRAWN.format("'5|' || signal || '|' || (t // 8)")} % 8")
def subsample_uniform(spark, d):
    return rs.subsample(_numbered(spark, d), 8, "uniform", 5, padding="reflect")


@query(f"WITH {_DAILY} SELECT signal, t // 8 AS t, v FROM dy WHERE t % 8 = {_DRAWN.format("'5|' || signal || '|' || (t // 8)")} % 8")
def subsample_sparse(spark, d):
    return rs.subsample(daily(spark, d), 8, "uniform", 5)


@query(f"WITH {_NUM} SELECT signal, t, v FROM nb UNION ALL SELECT signal, 2 * (n - 1) - t, v FROM nb JOIN ct USING (signal) WHERE 2 * (n - 1) - t BETWEEN n AND n + miss - 1")
def pad_reflect(spark, d):
    return rs.pad_tail(_numbered(spark, d), 7, "reflect")


@query(f"WITH {_NUM} SELECT signal, t, round(v, 9) AS v FROM nb UNION ALL SELECT signal, unnest(range(n, n + miss)), round(mean, 9) FROM ct")
def pad_mean(spark, d):
    return rs.pad_tail(_numbered(spark, d), 7, "mean").select("signal", "t", r9("v"))


for _m in ("minimum", "maximum", "median"):
    query(f"WITH {_NUM}, one AS (SELECT signal, {_m.replace('imum', '')}(v)::DOUBLE AS x FROM nb GROUP BY signal) SELECT signal, t, round(v, 9) AS v FROM nb UNION ALL SELECT signal, unnest(range(n, n + miss)), round(x, 9) FROM ct JOIN one USING (signal)", f"pad_{_m}")(lambda spark, d, m=_m: rs.pad_tail(_numbered(spark, d), 7, m).select("signal", "t", r9("v")))


@query(f"WITH {_NUM} SELECT signal, t, v FROM nb UNION ALL SELECT signal, t + n, v FROM nb JOIN ct USING (signal) WHERE t < miss")
def pad_wrap(spark, d):
    return rs.pad_tail(_numbered(spark, d), 7, "wrap")


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 4) AS total FROM orders")
def running_total(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return se.running_total(o, "o_totalprice", ["o_orderdate", "o_orderkey"], ["o_custkey"]).select("o_custkey", "o_orderkey", F.round("total", 4).alias("total"))


@query("""WITH a AS (SELECT o_custkey, o_orderkey, (o_totalprice - first(o_totalprice) OVER w + 10) * 0.5 AS x FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), b AS (SELECT o_custkey, o_orderkey, x - coalesce(lag(x) OVER w, x) AS x FROM a WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, o_orderkey, round(x, 6) AS x, round(x * 1.0, 6) AS p FROM b""")
def series_transform(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("x"))
    t = se.series_transform(o, ["x"], "o_orderkey", ["o_custkey"], base=True, add=10.0, mul=0.5, diff=True, product="p")
    return t.select("o_custkey", "o_orderkey", F.round("x", 6).alias("x"), F.round("p", 6).alias("p"))


@query("""WITH n AS (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) AS i FROM orders), g AS (SELECT o_custkey, i // 4 AS chunk, list(o_orderkey ORDER BY i) AS items FROM n GROUP BY ALL)
SELECT o_custkey, chunk, array_to_string(list_concat(items, list_resize([]::BIGINT[], (4 - len(items))::BIGINT, -1)), ',') AS items FROM g""")
def chunk(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return se.chunk(o, 4, "o_orderkey", ["o_orderdate", "o_orderkey"], ["o_custkey"], -1).select("o_custkey", "chunk", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20) SELECT user_id, n, rank() OVER (ORDER BY n DESC) AS rank FROM n")
def top_by_count(spark, d):
    return se.top_by_count(table(spark, d, "events"), "user_id", 20)


# text, binary and parameter jobs

_LN = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)"


@query(f"WITH {_LN} SELECT doc_id, line::INT AS line, md5(rtrim(ltrim(regexp_replace(lower(value), ' +', ' ', 'g')))) AS h FROM ln WHERE NOT starts_with(ltrim(value), '#')")
def normalise_lines(spark, d):
    lines = tj.split_lines(table(spark, d, "documents"))
    return tj.normalise_lines(lines, fold=True).select("doc_id", "line", F.md5("value").alias("h"))


@query(f"WITH {_LN} SELECT doc_id, line::INT AS line, md5(value) AS h FROM ln WHERE NOT regexp_matches(value, '(^The )|([0-9]{{3}})')")
def filter_lines(spark, d):
    return tj.filter_lines(tj.split_lines(table(spark, d, "documents")), ["^The ", "[0-9]{3}"]).select("doc_id", "line", F.md5("value").alias("h"))


_PT = """bw AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z]{3,}') AS w FROM benchmark), pt AS (SELECT DISTINCT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM bw))"""


def _word_pairs(spark, d):
    """A pattern for each two words that follow each other in an item of the benchmark."""
    w = table(spark, d, "benchmark").select(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)).alias("w")).where(F.size("w") > 1)
    pairs = w.select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))).alias("p"))
    return pairs.select(F.concat("p.a", F.lit("[ .,]+"), "p.b").alias("pattern")).distinct()


@query(f"WITH {_LN}, {_PT} SELECT doc_id, line::INT AS line, md5(value) AS h FROM ln WHERE NOT EXISTS (SELECT 1 FROM pt WHERE contains(ln.value, a) AND contains(ln.value, b) AND regexp_matches(ln.value, a || '[ .,]+' || b))")
def filter_lines_table(spark, d):
    return tj.filter_lines(tj.split_lines(table(spark, d, "documents")), _word_pairs(spark, d)).select("doc_id", "line", F.md5("value").alias("h"))


@query(f"WITH {_LN}, {_PT} SELECT doc_id, line::INT AS line, md5(value) AS h FROM ln WHERE EXISTS (SELECT 1 FROM pt WHERE contains(ln.value, a) AND contains(ln.value, b) AND regexp_matches(ln.value, a || '[ .,]+' || b))")
def matching_lines_table(spark, d):
    return tj.filter_lines(tj.split_lines(table(spark, d, "documents")), _word_pairs(spark, d), invert=True).select("doc_id", "line", F.md5("value").alias("h"))


@query("WITH b AS (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) SELECT ('0x' || h)::INT AS byte, count(*) AS n FROM b GROUP BY h")
def byte_histogram_text(spark, d):
    return bf.byte_histogram(table(spark, d, "documents"), "text")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_linenumber::BIGINT * 100000000000 + l_partkey * 10000 + l_suppkey AS o, 'Item ' || l_linenumber || ' (' || (l_partkey % 7) || 'm' || (l_suppkey % 60) || 's)' AS value FROM lineitem),
y AS (SELECT *, regexp_extract(value, '(.*) \\((.*)\\)', 1) AS title, coalesce(nullif(regexp_extract(value, '(\\d+)m', 1), '')::BIGINT, 0) * 60 + coalesce(nullif(regexp_extract(value, '(\\d+)s', 1), '')::BIGINT, 0) AS seconds FROM x)
SELECT l_orderkey, l_linenumber, title, seconds, sum(seconds) OVER (PARTITION BY l_orderkey ORDER BY o)::BIGINT AS finish FROM y""")
def annotated_durations(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber").cast("long") * 100000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("o"), F.concat(F.lit("Item "), F.col("l_linenumber").cast("string"), F.lit(" ("), (F.col("l_partkey") % 7).cast("string"), F.lit("m"), (F.col("l_suppkey") % 60).cast("string"), F.lit("s)")).alias("value"))
    return tj.annotated_durations(x, r"(.*) \((.*)\)", "o", ("l_orderkey",)).select("l_orderkey", "l_linenumber", "title", "seconds", "finish")


@query("SELECT 'event' AS mtype, n_name || '-' || c || '-' || i AS name, 'top.' || n_name || '.' || i AS hook, ((row_number() OVER (ORDER BY n_nationkey, p, i)) - 1)::INT AS idx FROM nation, (SELECT unnest(['red', 'blue']) AS c, unnest([0, 1]) AS p), range(0, 6, 2) r(i)")
def expand_templates(spark, d):
    t = table(spark, d, "nation").select(F.lit("event").alias("mtype"), F.col("n_nationkey").alias("seq"), F.concat("n_name", F.lit("-{}-{}")).alias("name"), F.concat(F.lit("top."), "n_name", F.lit(".{1}")).alias("hook"), F.array(F.array(F.lit("red"), F.lit("blue")), F.array(F.lit("0..6..2"))).alias("subs"))
    return pa.expand_templates(t, 2).select("mtype", "name", "hook", "idx")


@query(f"""WITH g AS (SELECT r_name || '.' || a || '.' || b AS name FROM region, (SELECT unnest(['x', 'y']) AS a), range(3) r(b)), v AS (SELECT name, CASE WHEN {_DRAWN.format("'1|' || name")} % 2 = 0 THEN 'low' ELSE 'high' END AS value FROM g)
SELECT name, value, '(' || name || ' = ' || value || ')' AS text FROM v""")
def param_grid(spark, d):
    t = table(spark, d, "region").select(F.concat("r_name", F.lit(".$.$")).alias("name"), F.array(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("0..3")), F.array(F.lit("low"), F.lit("high"))).alias("lists"))
    return pa.param_grid(t, 2, 1, "(", ")").select("name", "value", "text")


# column functions and reports


@query("""SELECT p_partkey, round(sqrt(pow(p_retailprice - p_size, 2) + pow(p_size - 1, 2)), 6) AS distance, round((p_size - p_retailprice) * 0.75 + p_retailprice, 6) AS between_x, (20 - p_size)::DOUBLE AS mirror_y, round(cos(0.5) * p_retailprice - sin(0.5) * p_size, 6) AS rot_x, round(p_retailprice * 2, 6) AS scale_x FROM part""")
def points(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.array(F.col("p_retailprice").cast("double"), F.col("p_size").cast("double")).alias("a"), F.array(F.col("p_size").cast("double"), F.lit(1.0)).alias("b"))
    s = lambda c, n: F.round(c, 6).alias(n)
    return p.select("p_partkey", s(sc.pt_distance("a", "b"), "distance"), s(sc.pt_between("a", "b", 0.75)[0], "between_x"), s(sc.pt_mirror("a", F.array(F.lit(None).cast("double"), F.lit(10.0)))[1], "mirror_y"), s(sc.pt_rotate_2d("a", 0.5)[0], "rot_x"), s(sc.pt_scale("a", 2.0)[0], "scale_x"))


_RGB = "printf('%02x', floor(255 * {})::INT)"


@query("WITH x AS (SELECT p_partkey, p_size / 50.0 AS a, (p_partkey % 100) / 99.0 AS b FROM part), y AS (SELECT *, 1 - sqrt(a * a + b * b) / sqrt(2.0) AS th, atan2(a, b) AS ph FROM x) SELECT p_partkey, " + _RGB.format("(1 - a)") + " || " + _RGB.format("(1 - a)") + " || " + _RGB.format("(1 - a)") + " AS grey, " + _RGB.format("th") + " || " + _RGB.format("pow(th, 1 + greatest(0, ph - pi() / 4))") + " || " + _RGB.format("pow(th, 1 + greatest(0, pi() / 4 - ph))") + " AS colour FROM y")
def colors(spark, d):
    x = table(spark, d, "part").select("p_partkey", (F.col("p_size") / F.lit(50.0)).alias("a"), ((F.col("p_partkey") % 100) / F.lit(99.0)).alias("b"))
    return x.select("p_partkey", sc.rgb1d("a").alias("grey"), sc.rgb2d("a", "b").alias("colour"))


@query("""WITH x AS (SELECT event_id, event_id * 977 + 0.5 AS s FROM events), y AS (SELECT *, floor(s)::BIGINT AS w FROM x)
SELECT event_id, CASE WHEN w // 604800 > 0 THEN (w // 604800) || 'w' ELSE '' END || CASE WHEN w % 604800 // 86400 > 0 THEN (w % 604800 // 86400) || 'd' ELSE '' END || CASE WHEN w % 86400 // 3600 > 0 THEN (w % 86400 // 3600) || 'h' ELSE '' END || CASE WHEN w % 3600 // 60 > 0 THEN (w % 3600 // 60) || 'm' ELSE '' END || printf('%.3fs', (w % 60) + 0.5) AS text FROM y""")
def durations(spark, d):
    return table(spark, d, "events").select("event_id", sc.duration_text(F.col("event_id") * 977 + F.lit(0.5)).alias("text"))


@query("SELECT page_id, regexp_replace(regexp_replace('module:' || url || '.wire:a:b[7:0].c', '\\[.*$', '', 's'), '[^.]*:', '', 'g') AS path FROM pages")
def detype(spark, d):
    return table(spark, d, "pages").select("page_id", sc.detype(F.concat(F.lit("module:"), "url", F.lit(".wire:a:b[7:0].c"))).alias("path"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%e' THEN p_name[:-2] ELSE p_name END AS stripped, p_name || '.csv' AS appended, regexp_replace(p_type, ' +', ' ', 'g') AS spaced,
lower(p_brand[1]) || regexp_replace(p_brand[2:], '\\W+', '_', 'g') AS camel, coalesce(nullif(list_position(string_split(p_name, ' '), 'red'), 0) - 1, -1)::BIGINT AS place FROM part""")
def strings(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", sc.strip_suffix("p_name", "e").alias("stripped"), sc.append_extension("p_name", "csv").alias("appended"), sc.dedup_spaces("p_type").alias("spaced"), sc.lower_camel_case("p_brand").alias("camel"), sc.first_index(F.split("p_name", " "), "red", -1).alias("place"))


@query("SELECT event_id, (event_id % 2 = 0) AS even, (event_id > 0 AND bit_count(event_id) = 1) AS pow2, CASE WHEN event_id = 1 THEN 0 WHEN event_id > 1 THEN length(bin(event_id - 1)) ELSE -1 END::INT AS clog2, round((least(greatest(value, 10), 90) - 10) / 80, 9) AS norm, lower(to_base(event_id, 16)) AS hex FROM events")
def integers(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", sc.is_even("event_id").alias("even"), sc.is_pow2("event_id").alias("pow2"), F.coalesce(sc.clog2("event_id").cast("int"), F.lit(-1)).alias("clog2"), r9(sc.clip_norm("value", 90.0, 10.0), "norm"), sc.int_to_base("event_id", 16).alias("hex"))


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS dot, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_aggregates(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(sc.dot("embedding", "embedding"), 6).alias("dot"), F.round(sc.l2_norm("embedding"), 6).alias("norm"))


_Q8 = "qs AS (SELECT event_type AS signal, event_id, floor(least(greatest(value / 100, 0), 1) * 255)::BIGINT AS x, event_id % 256 AS y FROM events)"


def _q8(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("signal"), "event_id", q.from_float(sc.clip_norm(F.col("value") / 100), 8).alias("x"), (F.col("event_id") % 256).alias("y"))


@query(f"WITH {_Q8} SELECT event_id, x, (x + y + 1) & 255 AS added, greatest(0, x - y - 1) AS subbed, greatest(0, 254 - x) AS reflected, (x * y + x + y) >> 8 AS had, round((x + 1) / 256.0, 9) AS f FROM qs")
def quantised_columns(spark, d):
    return _q8(spark, d).select("event_id", "x", q.add("x", "y", 8).alias("added"), q.sub("x", "y", 8).alias("subbed"), q.reflect("x", 8).alias("reflected"), q.hadamard("x", "y", 8).alias("had"), r9(q.to_float("x", 8), "f"))


@query(f"WITH {_Q8}, b AS (SELECT event_id // 16 AS block, count(*) AS n, sum(x) AS sx, sum((x * y + x + y) >> 8) AS sp FROM qs GROUP BY ALL) SELECT block, CASE WHEN bit_count(n) = 1 THEN (floor((sx + n) / n) - 1)::BIGINT END AS mean, CASE WHEN bit_count(n) = 1 THEN (floor((sp + n) / n) - 1)::BIGINT END AS product_mean FROM b")
def quantised_metrics(spark, d):
    x = _q8(spark, d).withColumn("block", F.floor(F.col("event_id") / 16).cast("long"))
    return x.groupBy("block").agg(q.mean("x", 8).alias("mean"), q.expectation("y", "x", 8).alias("product_mean"))


@query(f"WITH {_Q8} SELECT signal, event_id, greatest(0, x - coalesce(lag(x) OVER (PARTITION BY signal ORDER BY event_id), x) - 1) AS deriv FROM qs")
def quantised_derivative(spark, d):
    return rs.non_negative_derivative(_q8(spark, d), "x", order="event_id").select("signal", "event_id", "deriv")


@query("""SELECT 'discount' AS "column", count(*) FILTER (l_discount < 0) AS low, count(*) FILTER (l_discount > 1) AS high, count(*) FILTER (l_discount IS NULL) AS undefined, count(*) AS rows FROM lineitem UNION ALL SELECT 'quantity', count(*) FILTER (l_quantity < 0), count(*) FILTER (l_quantity > 1), count(*) FILTER (l_quantity IS NULL), count(*) FROM lineitem""")
def unit_interval_report(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_discount").alias("discount"), F.col("l_quantity").alias("quantity"))
    return me.unit_interval_report(x, ["discount", "quantity"])


@query("SELECT 'small' AS rule, count(*) FILTER (NOT l_quantity <= 40) AS violations, count(*) AS rows FROM lineitem UNION ALL SELECT 'taxed', count(*) FILTER (NOT l_tax > l_discount), count(*) FROM lineitem")
def comparison_report(spark, d):
    return me.comparison_report(table(spark, d, "lineitem"), {"small": ("l_quantity", "leq", 40.0), "taxed": ("l_tax", "gt", "l_discount")})


# files: what is written from the given tables is read back


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share."""
    sc_ = spark.sparkContext
    base = sc_.getCheckpointDir() or sc_.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not (sc_.master == "local" or sc_.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="sigrel-stream-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


_LOG = "lg AS (SELECT 'top.u' || user_id AS name, (epoch_us(ts) // 60000000)::BIGINT AS t, max_by(floor(value)::BIGINT % 65536, event_id) AS v FROM events GROUP BY ALL)"


def _user_log(spark, d):
    """Each user's value as a vector of 16 bits, the last one of each minute."""
    e = table(spark, d, "events").select(F.concat(F.lit("top.u"), F.col("user_id").cast("string")).alias("name"), F.floor(_seconds("ts") / 60).cast("long").alias("t"), "event_id", (F.floor("value").cast("long") % 65536).alias("v"))
    return e.groupBy("name", "t").agg(F.max_by("v", "event_id").alias("v"))


@query(f"WITH {_LOG} SELECT t, name, 'b' || lpad(bin(v), 16, '0') AS raw FROM lg")
def change_files(spark, d):
    c = _user_log(spark, d).select("t", F.col("name").alias("var_id"), F.concat(F.lit("b"), F.bin("v")).alias("raw"))
    c = c.withColumn("seq", F.monotonically_increasing_id())
    v = c.select("var_id").distinct().select("var_id", F.col("var_id").alias("name"), F.lit(16).alias("width"), F.lit("reg").alias("kind"), F.lit("").alias("bit_sel"))
    where = _shared(spark, "log")
    cf.write_changes(v, c, where)
    _, variables, changes = cf.read_changes(spark, where, parts=True)
    return changes.join(variables.select("src", "var_id", "name"), ["src", "var_id"]).select("t", "name", "raw")


@query(f"WITH {_LOG}, r AS (SELECT *, lag(v, 1, 0) OVER (PARTITION BY name ORDER BY t) AS b FROM lg), c AS (SELECT name, t, v FROM r WHERE v <> b), z AS (SELECT unnest(generate_series(min(t), max(t), 10000)) AS moment FROM lg) SELECT name AS signal, moment AS t, max_by(v, c.t)::DOUBLE AS v FROM c JOIN z ON c.t <= moment GROUP BY ALL HAVING max_by(v, c.t) <> 0")
def values_at_times(spark, d):
    """Each signal's value at some moments, read from the snapshots of a store: one segment a moment."""
    g = _user_log(spark, d).select(F.lit("normal").alias("mtype"), F.col("name").alias("signal"), "t", F.col("v").cast("double").alias("v"))
    where = _shared(spark, "measures")
    cf.store_measures(g, where, every=4096)
    first, last = g.agg(F.min("t"), F.max("t")).first()
    moments = [cf.load_measures(spark, where, None, t, t + 1) for t in range(first or 0, (last or 0) + 1, 10000)]
    return reduce(DataFrame.unionByName, moments).select("signal", "t", "v")


@query(f"WITH {_LOG}, r AS (SELECT *, lag(v, 1, 0) OVER (PARTITION BY name ORDER BY t) AS b FROM lg), c AS (SELECT name, t, v FROM r WHERE v <> b), m AS (SELECT min(t) + 1000 AS t0, min(t) + 9000 AS t1 FROM lg) SELECT name AS signal, c.t, v::DOUBLE AS v FROM c, m WHERE c.t > t0 AND c.t < t1 UNION ALL SELECT name, any_value(t0), max_by(v, c.t)::DOUBLE FROM c, m WHERE c.t <= t0 GROUP BY name HAVING max_by(v, c.t) <> 0")
def store_measures(spark, d):
    g = _user_log(spark, d).select(F.lit("normal").alias("mtype"), F.col("name").alias("signal"), "t", F.col("v").cast("double").alias("v"))
    where = _shared(spark, "measures")
    cf.store_measures(g, where, every=4096)
    first = g.agg(F.min("t")).first()[0] or 0
    return cf.load_measures(spark, where, None, first + 1000, first + 9000).select("signal", "t", "v")


@query("""WITH x AS (SELECT ((epoch_us(ts) // 1000000) // 600 * 600)::BIGINT AS t, event_id % 3 AS ch, user_id AS addr FROM events), s AS (SELECT c_custkey AS addr, regexp_replace(c_name, '[^A-Za-z0-9_]', '_', 'g') AS symbol FROM customer WHERE c_custkey % 3 <> 0),
c AS (SELECT t, CASE WHEN symbol IS NULL THEN 'unknown.0x' || lower(to_base(x.addr, 16)) WHEN x.addr < 100 THEN 'low.' || symbol ELSE symbol END AS signal, CASE ch WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE 'x' END AS raw FROM x LEFT JOIN s USING (addr)), m AS (SELECT min(t) AS t FROM c)
SELECT * FROM c UNION ALL SELECT m.t, signal, '0' FROM (SELECT DISTINCT signal FROM c), m WHERE signal NOT IN (SELECT signal FROM c JOIN m USING (t))""")
def trace_changes(spark, d):
    e = table(spark, d, "events")
    lines = e.select(F.concat_ws(" ", _seconds("ts").cast("string"), (F.col("event_id") % 3).cast("string"), F.concat(F.lit("0x"), F.lower(F.hex("user_id")))).alias("value"))
    symbols = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("0x"), F.hex("c_custkey")).alias("address"), F.lit("func").alias("type"), F.col("c_name").alias("name"))
    return tr.trace_to_changes(lines, symbols, 600, {"low": (0, 100)})


@query("SELECT l_returnflag AS mode, l_orderkey, l_linenumber::INT AS l_linenumber, l_quantity::DOUBLE AS l_quantity FROM lineitem")
def union_runs(spark, d):
    where = _shared(spark, "runs")
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_returnflag").alias("mode"))
    x.write.option("header", True).partitionBy("mode").csv(where)
    runs = tr.union_runs(spark, f"{where}/*/*.csv", r"mode=(\w+)/", ["mode"], "l_orderkey bigint, l_linenumber int, l_quantity double")
    return runs.select("mode", "l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT n_name AS name, CASE WHEN n_nationkey % 4 = 3 THEN 'unknown type' WHEN n_nationkey % 4 = 1 THEN 'threshold without bound' ELSE 'empty range' END AS rule FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT n_name, 'no hook' FROM nation WHERE n_regionkey = 0""")
def check_measures(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey") % 4
    m = n.select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") != 0, F.lit("top.x")).alias("hook"), F.when(k == 0, "event").when(k == 1, "threshold").when(k == 2, "normal").otherwise("odd").alias("mtype"), F.when(k == 2, 5.0).alias("geq"), F.when(k == 2, 5.0).alias("leq"))
    return me.check_measures(m)


@query("""WITH m AS (SELECT n_name AS name, n_nationkey AS k FROM nation), v AS (SELECT 'top.' || r_name || '.part' AS path, r_regionkey AS id FROM region)
SELECT name, CASE WHEN k < 5 THEN 'r' || k END AS var_id, CASE WHEN k % 2 = 0 THEN (k % 12)::INT END AS bit, CASE WHEN k >= 5 THEN 'no such variable' WHEN k % 2 = 0 AND k % 12 >= 3 THEN 'bit outside of width' END AS problem FROM m""")
def bind_measures(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    m = n.select(F.col("n_name").alias("name"), F.concat(F.lit("n"), k.cast("string"), F.lit(".sig"), F.when(k % 2 == 0, F.concat(F.lit("["), (k % 12).cast("string"), F.lit("]"))).otherwise(F.lit(""))).alias("hook"))
    v = table(spark, d, "region").select(F.concat(F.lit("top.n"), F.col("r_regionkey").cast("string"), F.lit(".sig[2:0]")).alias("name"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("var_id"), F.lit("reg").alias("kind"), F.lit(3).alias("width"))
    return me.bind_measures(m, v, "top.").select("name", "var_id", "bit", "problem")


# binary files: text whose line ends are the last byte of a record

_REC = "rc AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS i, l_orderkey % 127 + 1 AS a, l_linenumber % 128 AS b, l_quantity::BIGINT % 128 AS c, 10 AS z FROM lineitem)"


def _records(spark: SparkSession, d: str, bytes_of: list[str]) -> str:
    """Line items in order as records of a byte for each expression (1 to 127) and a line end, in a new folder."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    x = table(spark, d, "lineitem").select(*order, F.concat(*[F.char(F.expr(b)) for b in bytes_of]).alias("value"))
    where = _shared(spark, "records")
    x.repartitionByRange(4, *order).sortWithinPartitions(*order).select("value").write.text(where)
    return where


_BYTES = ["l_orderkey % 127 + 1", "l_linenumber % 128", "cast(l_quantity as bigint) % 128"]


@query(f"WITH {_REC} SELECT i AS index, (a + 256 * b + 65536 * c + 16777216 * z)::BIGINT AS value, lower(printf('%02x%02x%02x%02x', z, c, b, a)) AS hex, lpad(bin(16777216 * z + 65536 * c + 256 * b + a), 32, '0') AS bits FROM rc")
def decode_records(spark, d):
    return bf.decode_records(spark, _records(spark, d, _BYTES), "u32").select("index", "value", "hex", "bits")


@query(f"WITH {_REC} SELECT i AS index, (z + 256 * c + 65536 * b + 16777216 * a)::BIGINT AS value FROM rc")
def decode_records_big_endian(spark, d):
    return bf.decode_records(spark, _records(spark, d, _BYTES), "i32", little_endian=False).select("index", "value")


@query(f"WITH {_REC} SELECT i AS index, a::INT AS win_num, b::INT AS count_x, c::INT AS count_y, 1 AS count_isect, z::INT AS count_symdiff, b / 128 AS ex, c / 128 AS ey, 1 / 128 AS exy, z / 128 AS ediff, i * 64.0::DOUBLE AS seconds FROM rc")
def counter_packets(spark, d):
    return bf.decode_counter_packets(spark, _records(spark, d, [*_BYTES, "1"]), 128, 0.5)


@query(f"WITH {_LN}, x AS (SELECT md5(rtrim(ltrim(regexp_replace(lower(value), ' +', ' ', 'g')))) AS h FROM ln WHERE NOT starts_with(ltrim(value), '#')) SELECT h, count(*) AS n FROM x GROUP BY h")
def lines_there_and_back(spark, d):
    """Lines of documents, normalised as they are written to text files and as they are read again."""
    where = _shared(spark, "lines")
    tj.write_lines(tj.split_lines(table(spark, d, "documents")), where, ("doc_id", "line"), fold=True)
    return tj.read_lines(spark, where, comments=True).groupBy(F.md5("value").alias("h")).agg(F.count("*").alias("n"))


# streams


def _streamed(spark: SparkSession, d: str, name: str, build) -> DataFrame:
    """Run a stream over a table's files to its end and read back what it wrote."""
    where = _shared(spark, f"stream-{name}")
    src = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    out = build(src)
    run = out.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{where}/out")


@query("""WITH e AS (SELECT DISTINCT event_type AS signal, time_bucket(INTERVAL 1 MINUTE, ts) AS ts FROM events), m AS (SELECT max(time_bucket(INTERVAL 1 MINUTE, ts)) - INTERVAL 10 MINUTE AS w FROM events), b AS (SELECT signal, time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*) AS n FROM e GROUP BY ALL)
SELECT signal, (epoch_us(s) // 1000000)::BIGINT AS u, round(n / 60.0, 9) AS ex FROM b, m WHERE s + INTERVAL 1 HOUR <= w""")
def stream_expectation(spark, d):
    from ..streaming.streams import stream_expectation as f

    def build(src):
        e = src.select(F.col("event_type").alias("signal"), F.expr("timestamp_seconds(timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) div 60 * 60)").alias("ts"), F.lit(1.0).alias("v"))
        e = e.withWatermark("ts", "10 minutes").dropDuplicates(["signal", "ts"])
        return f(e, "1 hour", late=None, n=60).select("signal", F.unix_timestamp(F.col("window.start")).alias("u"), F.round("ex", 9).alias("ex"))

    return _streamed(spark, d, "expectation", build)


@query("""WITH e AS (SELECT DISTINCT event_type AS s, time_bucket(INTERVAL 1 MINUTE, ts) AS ts FROM events WHERE event_type IN ('click', 'purchase')), m AS (SELECT max(time_bucket(INTERVAL 1 MINUTE, ts)) - INTERVAL 10 MINUTE AS w FROM events WHERE event_type IN ('click', 'purchase')),
p AS (SELECT ts, max((s = 'click')::INT) AS x, max((s = 'purchase')::INT) AS y FROM e GROUP BY ts), b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, sum(x)::BIGINT AS count_x, sum(y)::BIGINT AS count_y, sum(x * y)::BIGINT AS count_isect, sum(abs(x - y))::BIGINT AS count_symdiff FROM p GROUP BY h)
SELECT (epoch_us(h) // 1000000)::BIGINT AS u, count_x, count_y, count_isect, count_symdiff FROM b, m WHERE h + INTERVAL 1 HOUR <= w""")
def stream_counters(spark, d):
    from ..streaming.streams import stream_counters as f

    def build(src):
        minute = F.expr("timestamp_seconds(timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) div 60 * 60)").alias("ts")
        x, y = (src.where(F.col("event_type") == k).select(minute) for k in ("click", "purchase"))
        return f(x, y, "1 hour").select(F.unix_timestamp(F.col("window.start")).alias("u"), "count_x", "count_y", "count_isect", "count_symdiff")

    return _streamed(spark, d, "counters", build)


@query("""WITH e AS (SELECT event_type AS signal, time_bucket(INTERVAL 1 MINUTE, ts) AS ts, event_id, user_id FROM events), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM e)
SELECT signal, (epoch_us(ts) // 1000000)::BIGINT AS t, max_by(user_id, event_id) AS raw FROM e, m WHERE ts <= w GROUP BY ALL""")
def stream_last(spark, d):
    from ..streaming.streams import stream_last as f

    def build(src):
        e = src.select(F.col("event_type").alias("signal"), F.expr("timestamp_seconds(timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) div 60 * 60)").alias("ts"), F.col("event_id").alias("seq"), F.col("user_id").alias("raw"))
        return f(e).select("signal", F.unix_timestamp("ts").alias("t"), "raw")

    return _streamed(spark, d, "last", build)


@query("""WITH c AS (SELECT concat(event_type, ':', user_id) AS signal, epoch_us(ts)::BIGINT AS t, max((value > 20)::INT) AS v FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
l AS (SELECT *, lag(v, 1, 0) OVER (PARTITION BY signal ORDER BY t) AS before FROM c), x AS (SELECT signal, t, v, lag(t, 1, 0) OVER (PARTITION BY signal ORDER BY t) AS t0 FROM l WHERE v <> before)
SELECT signal, CASE v WHEN 1 THEN 'rise' ELSE 'fall' END AS kind, t AS t0, t + 1 AS t1 FROM x UNION ALL SELECT signal, CASE v WHEN 1 THEN 'refl' ELSE 'orig' END AS kind, t0, t AS t1 FROM x WHERE t > t0""")
def stream_measures(spark, d):
    """Each user's events of a type as a signal that is on while their value is over 20: what the stream gives is what a batch gives."""
    from ..streaming.streams import stream_measures as f

    def build(src):
        signal = F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("signal")
        t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("t")
        whole = src.where("event_type is not null and user_id is not null and ts is not null and value is not null")
        return f(whole.select(signal, t, (F.col("value") > 20).cast("int").alias("v")))

    return _streamed(spark, d, "measures", build)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
