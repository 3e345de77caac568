"""Distribution queries on month rain: fits, bounds, tests, histograms, quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.catalog.months import HISTORY, rounded
from freshet.catalog.registry import query
from freshet.catalog.sqltext import select
from freshet.catalog.tables import PRIORITY, daily_log, priority_log, table
from freshet.functions.calendar import season
from freshet.functions.numeric import interval_band, sigma_band
from freshet.operators import distributions, products, quantiles
from freshet.plans.monthly import month_history_table
from freshet.session import durable

BY = ["series_id", "month"]


def _rain(spark, sf_dir):
    return month_history_table(daily_log(spark, sf_dir))


CUBIC_FEET_PER_ACRE_FOOT = 43560


def _daily(spark, sf_dir):
    """Daily inflow of the five series in larger units, a row per series and day; read several times, so written once."""
    inflow = (F.col("inflow_adj") / CUBIC_FEET_PER_ACRE_FOOT).alias("x")
    return durable(priority_log(spark, sf_dir).select("series_id", F.month("date_day").alias("month"), inflow))


DAILY_X = PRIORITY + f""", xs AS (
  SELECT series_id, CAST(month(date_day) AS INTEGER) AS month, inflow_adj / {CUBIC_FEET_PER_ACRE_FOOT} AS x FROM prio)"""
NORMAL = HISTORY + """, fit AS (
  SELECT series_id, month, count(rainfall) AS n, avg(rainfall) AS mean, stddev_samp(rainfall) AS sigma,
         min(rainfall) AS low, max(rainfall) AS high FROM history GROUP BY 1, 2)"""


@query(
    "month_normal_bounds",
    select(NORMAL, """SELECT series_id, month, n, round(mean, 4) AS mean, round(sigma, 4) AS sigma,
  round(mean - 2 * sigma, 4) AS lower, round(mean + 2 * sigma, 4) AS upper FROM fit WHERE n >= 5"""),
)
def _(spark, sf_dir):
    out = distributions.normal_bounds(_rain(spark, sf_dir), "rainfall")
    return rounded(out, {c: 4 for c in ("mean", "sigma", "lower", "upper")})


@query(
    "normal_pdf_grid",
    select(NORMAL + """, grid AS (
  SELECT *, low + (high - low) * i / 99.0 AS x FROM fit, (SELECT CAST(unnest(range(0, 100)) AS INTEGER) AS i))""",
           """SELECT series_id, month, i, round(x, 5) AS x,
  round(exp(-(x - mean) * (x - mean) / (2 * sigma * sigma)) / (sigma * sqrt(2 * pi())), 12) AS density FROM grid"""),
)
def _(spark, sf_dir):
    grid = distributions.normal_grid(distributions.normal_fit(_rain(spark, sf_dir), "rainfall"))
    return rounded(grid, {"x": 5, "density": 12})


@query(
    "sigma_intervals",
    select(NORMAL, "SELECT series_id, month, round(mean, 4) AS mean, " + ", ".join(
        f"round(mean {s} {k} * sigma, 4) AS {n}_{k}s" for k in (1, 2) for s, n in (("-", "low"), ("+", "high")))
        + " FROM fit"),
)
def _(spark, sf_dir):
    out = products.sigma_intervals(distributions.normal_fit(_rain(spark, sf_dir), "rainfall"))
    return rounded(out, {c: 4 for c in ("mean", "low_1s", "high_1s", "low_2s", "high_2s")})


# ln k - digamma(k), solved for k by bisection; digamma by recurrence to k + 10 and its asymptotic series.
def _digamma(k: str) -> str:
    y = f"({k} + 10)"
    tail = (f"ln({y}) - 0.5 / {y} - (1.0/12 - (1.0/120 - (1.0/252 - (1.0/240 - (1.0/132) / ({y}*{y})) / ({y}*{y})) "
            f"/ ({y}*{y})) / ({y}*{y})) / ({y}*{y})")
    return f"({tail} - " + " - ".join(f"1.0 / ({k} + {i})" for i in range(10)) + ")"


def _lower_gamma(a: str, x: str) -> str:
    """Regularised lower incomplete gamma as its power series, from 12 deviations before the largest term to 12 behind."""
    first = f"CAST(greatest(0, floor({x} - {a} - 12 * sqrt({x}) - 40)) AS BIGINT)"
    last = f"CAST(greatest(0, ceil({x} - {a})) + 12 * sqrt(greatest({x}, {a})) + 60 AS BIGINT)"
    return (f"(CASE WHEN {x} <= 0 THEN 0.0::DOUBLE ELSE list_sum(list_transform(range({first}, {last}), lambda n: "
            f"exp(({a} + n) * ln({x}) - {x} - lgamma({a} + n + 1)))) END)")


GAMMA_ML = HISTORY + f""", sums AS (
  SELECT series_id, month, count(*) AS n, avg(rainfall) AS mean, ln(avg(rainfall)) - avg(ln(rainfall)) AS gap
  FROM history WHERE rainfall > 0 GROUP BY 1, 2),
shapes AS (
  WITH RECURSIVE s AS (
    SELECT series_id, month, n, mean, gap, 1e-3::DOUBLE AS lo, 1e7::DOUBLE AS hi, 0 AS i FROM sums
    UNION ALL
    SELECT series_id, month, n, mean, gap,
           CASE WHEN ln(sqrt(lo * hi)) - {_digamma('sqrt(lo * hi)')} > gap THEN sqrt(lo * hi) ELSE lo END,
           CASE WHEN ln(sqrt(lo * hi)) - {_digamma('sqrt(lo * hi)')} > gap THEN hi ELSE sqrt(lo * hi) END, i + 1
    FROM s WHERE i < 70)
  SELECT series_id, month, n, mean, sqrt(lo * hi) AS shape FROM s WHERE i = 70)"""


def _quantiles_sql(source: str, levels: dict[str, float]) -> str:
    """Gamma quantiles of ``source`` rows by bisection, one column per level."""
    return f"""wanted AS (
  SELECT t.*, q.name, q.p FROM {source} t, (VALUES {', '.join(f"('{n}', {p})" for n, p in levels.items())}) q(name, p)),
found AS (
  WITH RECURSIVE b AS (
    SELECT *, 0.0::DOUBLE AS lo, (shape + 40 * sqrt(shape) + 40)::DOUBLE AS hi, 0 AS i FROM wanted
    UNION ALL
    SELECT * EXCLUDE (lo, hi, i, below), CASE WHEN below THEN (lo + hi) / 2 ELSE lo END,
           CASE WHEN below THEN hi ELSE (lo + hi) / 2 END, i + 1
    FROM (SELECT *, {_lower_gamma('shape', '((lo + hi) / 2)')} < p AS below FROM b WHERE i < 50))
  SELECT * EXCLUDE (lo, hi, i), (lo + hi) / 2 AS z FROM b WHERE i = 50)"""


@query(
    "gamma_fit",
    select(GAMMA_ML, """SELECT series_id, month, n, round(shape, 4) AS shape, 0.0::DOUBLE AS loc,
  round(mean / shape, 4) AS scale, round(mean, 4) AS mean FROM shapes"""),
)
def _(spark, sf_dir):
    fit = distributions.gamma_fit(_rain(spark, sf_dir), "rainfall")
    return rounded(fit, {"shape": 4, "scale": 4, "mean": 4})


_LEVELS = {"lower_50": 0.25, "upper_50": 0.75, "lower_95": 0.025, "upper_95": 0.975}


@query(
    "gamma_intervals",
    select(GAMMA_ML + ", " + _quantiles_sql("shapes", _LEVELS), """SELECT series_id, month, round(mean, 4) AS mean,
  round(mean - max(mean / shape * z) FILTER (name = 'lower_50'), 3) AS down_50,
  round(mean - max(mean / shape * z) FILTER (name = 'lower_95'), 3) AS down_95,
  round(max(mean / shape * z) FILTER (name = 'upper_50') - mean, 3) AS up_50,
  round(max(mean / shape * z) FILTER (name = 'upper_95') - mean, 3) AS up_95 FROM found GROUP BY series_id, month, mean"""),
)
def _(spark, sf_dir):
    fit = distributions.gamma_fit(_rain(spark, sf_dir), "rainfall")
    fit = distributions.with_gamma_interval(distributions.with_gamma_interval(fit, 0.50, "_50"), 0.95, "_95")
    out = products.interval_offsets(fit, ["_50", "_95"])
    return rounded(out, {"mean": 4, "down_50": 3, "down_95": 3, "up_50": 3, "up_95": 3})


GAMMA_MOMENTS = DAILY_X + """, raw AS (
  SELECT series_id, month, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sigma, stddev_pop(x) AS pop,
         min(x) AS low, max(x) AS high FROM xs GROUP BY 1, 2),
third AS (
  SELECT r.series_id, r.month, CASE WHEN any_value(pop) > 0 THEN avg(pow(x - mean, 3)) / pow(any_value(pop), 3) END AS skew
  FROM xs JOIN raw r ON xs.series_id = r.series_id AND xs.month = r.month GROUP BY 1, 2),
gfit AS (
  SELECT series_id, month, n, mean, coalesce(sigma, 0) AS sigma, low, high, fit, shape, sigma / sqrt(shape) AS scale,
         CASE fit WHEN 'moments' THEN mean - sqrt(shape) * sigma WHEN 'location_0' THEN 0.0 END AS loc
  FROM (SELECT *, CASE fit WHEN 'moments' THEN 4 / (skew * skew) WHEN 'location_0' THEN pow(mean / sigma, 2) END AS shape
        FROM (SELECT raw.*, skew, CASE WHEN sigma > 0 AND skew > 0.01 THEN 'moments' WHEN sigma > 0 AND mean > 0 THEN 'location_0'
              ELSE 'none' END AS fit FROM raw JOIN third USING (series_id, month))))"""


@query(
    "gamma_moment_bounds",
    select(GAMMA_MOMENTS + ", " + _quantiles_sql("(SELECT * FROM gfit WHERE shape IS NOT NULL AND n >= 5)", {"lower": 0.025, "upper": 0.975}),
           """SELECT g.series_id, g.month, g.n, g.fit, round(g.shape, 5) AS shape, round(g.loc, 4) AS loc, round(g.scale, 5) AS scale,
  round(g.loc + g.scale * max(z) FILTER (name = 'lower'), 4) AS lower,
  round(g.loc + g.scale * max(z) FILTER (name = 'upper'), 4) AS upper
FROM gfit g LEFT JOIN found f ON g.series_id = f.series_id AND g.month = f.month
GROUP BY g.series_id, g.month, g.n, g.fit, g.shape, g.loc, g.scale"""),
)
def _(spark, sf_dir):
    fit = distributions.gamma_moment_fit(_daily(spark, sf_dir), "x")
    out = distributions.with_gamma_interval(fit, 0.95, "", min_rows=5)
    out = out.select(*BY, "n", "fit", "shape", "loc", "scale", "lower", "upper")
    return rounded(out, {"shape": 5, "loc": 4, "scale": 5, "lower": 4, "upper": 4})


@query(
    "gamma_pdf_grid",
    select(GAMMA_MOMENTS + """, grid AS (
  SELECT *, greatest(low - sigma, 0) + (high + sigma - greatest(low - sigma, 0)) * i / 199.0 AS x
  FROM gfit, (SELECT CAST(unnest(range(0, 200)) AS INTEGER) AS i))""",
           """SELECT series_id, month, i, round(x, 6) AS x, round(CASE WHEN x > loc
  THEN exp((shape - 1) * ln((x - loc) / scale) - (x - loc) / scale - lgamma(shape) - ln(scale))
  WHEN shape IS NOT NULL THEN 0.0 END, 9) AS density
FROM grid"""),
)
def _(spark, sf_dir):
    grid = distributions.gamma_grid(distributions.gamma_moment_fit(_daily(spark, sf_dir), "x"))
    return rounded(grid, {"x": 6, "density": 9})


@query(
    "gamma_ks",
    select(GAMMA_MOMENTS + f""", ranked AS (
  SELECT series_id, month, x, row_number() OVER (PARTITION BY series_id, month ORDER BY x) AS i,
         count(*) OVER (PARTITION BY series_id, month) AS n FROM xs),
scored AS (
  SELECT r.series_id, r.month, r.i, r.n, CASE WHEN g.shape IS NOT NULL THEN {_lower_gamma('g.shape', '((r.x - g.loc) / g.scale)')} END AS f
  FROM ranked r JOIN gfit g ON r.series_id = g.series_id AND r.month = g.month),
ks AS (
  SELECT series_id, month, n, max(greatest(i / n - f, f - (i - 1) / n)) AS d FROM scored GROUP BY 1, 2, 3)""",
           """SELECT series_id, month, n, round(d, 7) AS d, round(CASE WHEN sqrt(n) * d < 0.2 THEN 1.0 ELSE
  least(greatest(list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END)
  * exp(-2.0 * k * k * n * d * d))), 0.0), 1.0) END, 7) AS p_value FROM ks"""),
)
def _(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    ks = distributions.gamma_ks(daily, distributions.gamma_moment_fit(daily, "x"), "x")
    return rounded(ks, {"d": 7, "p_value": 7})


@query(
    "jarque_bera_by_month",
    select(DAILY_X + """, m AS (SELECT series_id, month, avg(x) AS mean, count(*) AS n FROM xs GROUP BY 1, 2),
p AS (
  SELECT m.series_id, m.month, any_value(n) AS n, avg(pow(x - mean, 2)) AS m2, avg(pow(x - mean, 3)) AS m3,
         avg(pow(x - mean, 4)) AS m4
  FROM xs JOIN m ON xs.series_id = m.series_id AND xs.month = m.month GROUP BY 1, 2),
t AS (SELECT series_id, month, n, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS k FROM p)""",
           """SELECT series_id, month, n, round(skew, 7) AS skew, round(k, 7) AS excess_kurtosis,
  round(n / 6 * (skew * skew + k * k / 4), 6) AS statistic,
  round(exp(-n / 12 * (skew * skew + k * k / 4)), 9) AS p_value FROM t"""),
)
def _(spark, sf_dir):
    jb = distributions.jarque_bera(_daily(spark, sf_dir), "x")
    return rounded(jb, {"skew": 7, "excess_kurtosis": 7, "statistic": 6, "p_value": 9})


def _histogram_sql(k: str) -> str:
    return DAILY_X + f""", g AS (
  SELECT series_id, month, count(*) AS n, min(x) AS low, max(x) AS high, avg(x) AS mean, stddev_samp(x) AS sigma
  FROM xs GROUP BY 1, 2),
kk AS (SELECT series_id, month, n, mean, sigma, CASE WHEN low = high THEN low - 0.5 ELSE low END AS low,
              CASE WHEN low = high THEN high + 0.5 ELSE high END AS high, CAST({k} AS INTEGER) AS k FROM g),
hits AS (
  SELECT kk.series_id, kk.month, least(floor((x - low) / (high - low) * k), k - 1) AS bin, count(*) AS c
  FROM xs JOIN kk ON xs.series_id = kk.series_id AND xs.month = kk.month GROUP BY 1, 2, 3),
hist AS (
  SELECT b.series_id, b.month, b.bin, low + (high - low) / k * (b.bin + 0.5) AS center, (high - low) / k AS width,
         coalesce(c, 0) AS count, coalesce(c, 0) / (n * ((high - low) / k)) AS density, mean, sigma
  FROM (SELECT *, CAST(unnest(range(0, k)) AS INTEGER) AS bin FROM kk) b
  LEFT JOIN hits ON hits.series_id = b.series_id AND hits.month = b.month AND hits.bin = b.bin)"""


_HIST = "series_id, month, bin, round(center, 6) AS center, round(width, 6) AS width, count, round(density, 9) AS density"


@query(
    "density_histogram",
    select(_histogram_sql("15"), f"""SELECT {_HIST}, CASE WHEN abs(center - mean) / sigma <= 1 THEN 'within_1'
  WHEN abs(center - mean) / sigma <= 2 THEN 'within_2' WHEN sigma IS NOT NULL THEN 'beyond_2' END AS band FROM hist"""),
)
def _(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    fit = distributions.normal_fit(daily, "x").select(*BY, "mean", "sigma")
    bars = distributions.histogram(daily, "x").join(fit, BY)
    band = sigma_band(F.col("center"), F.col("mean"), F.col("sigma"))
    return rounded(bars.withColumn("band", band).drop("mean", "sigma"), {"center": 6, "width": 6, "density": 9})


@query(
    "density_histogram_root_bins",
    select(_histogram_sql("least(15, greatest(12, floor(sqrt(n))))"),
           f"""SELECT {_HIST}, CASE WHEN center BETWEEN mean - 2 * sigma AND mean + 2 * sigma THEN 'inside'
  ELSE 'outside' END AS band FROM hist"""),
)
def _(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    fit = distributions.normal_fit(daily, "x").select(*BY, "mean", "sigma")
    bars = distributions.histogram(daily, "x", bins="sqrt").join(fit, BY)
    reach = 2 * F.col("sigma")
    band = interval_band(F.col("center"), F.col("mean") - reach, F.col("mean") + reach)
    return rounded(bars.withColumn("band", band).drop("mean", "sigma"), {"center": 6, "width": 6, "density": 9})


_SEASON = """CASE WHEN month IN (12, 1, 2) THEN 'DJF' WHEN month IN (3, 4, 5) THEN 'MAM'
  WHEN month IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"""
_Q = [0.05, 0.25, 0.75, 0.95]


@query(
    "quantiles_by_season_month",
    select(DAILY_X + f", ss AS (SELECT *, {_SEASON} AS season FROM xs)",
           "SELECT series_id, season, month, CAST(grouping(series_id, season, month) AS BIGINT) AS grouping, count(*) AS n, "
           + ", ".join(f"round(quantile_cont(x, {p}), 7) AS {quantiles.quantile_name(p)}" for p in _Q)
           + " FROM ss GROUP BY GROUPING SETS ((series_id, season, month), (series_id, season), (series_id))"),
)
def _(spark, sf_dir):
    daily = _daily(spark, sf_dir).withColumn("season", season(F.col("month")))
    keys = ["series_id", "season", "month"]
    out = quantiles.quantile_table(daily, "x", _Q, [keys, keys[:2], keys[:1]], keys)
    return rounded(out, {quantiles.quantile_name(p): 7 for p in _Q})


@query(
    "winsorize",
    select(DAILY_X + """, q AS (
  SELECT series_id, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM xs GROUP BY 1)""",
           """SELECT series_id, month, x, round(greatest(least(x, hi), lo), 7) AS clipped FROM xs JOIN q USING (series_id)"""),
)
def _(spark, sf_dir):
    clipped = quantiles.winsorized(_daily(spark, sf_dir), "x", 0.01, "clipped")
    return rounded(clipped, {"clipped": 7})


@query(
    "pooled_quantiles",
    f"""SELECT l_returnflag, count(*) AS n, {', '.join(
        f"round(quantile_cont(l_extendedprice * l_quantity, {p}), 5) AS {quantiles.quantile_name(p)}" for p in (0.01, *_Q, 0.99))}
FROM lineitem GROUP BY 1""",
)
def _(spark, sf_dir):
    """A few groups that hold all line items between them."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", (F.col("l_extendedprice") * F.col("l_quantity")).alias("amount")
    )
    out = quantiles.pooled_quantiles(lines, "amount", [0.01, *_Q, 0.99], ["l_returnflag"])
    return rounded(out, {quantiles.quantile_name(p): 5 for p in (0.01, *_Q, 0.99)})
