"""Model and evaluation queries."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from freshet.catalog.distributions import _quantiles_sql, GAMMA_ML, NORMAL
from freshet.catalog.months import HISTORY, rounded
from freshet.catalog.panels import _panel_sql as panel_query_sql
from freshet.catalog.registry import query
from freshet.catalog.sqltext import MONTH_MEANS, over, select
from freshet.catalog.tables import (
    DAILY, PRIORITY, TRAIN_END, VAL_END, daily_log, priority_log, rain_by_area, soil_by_area,
)
from freshet.catalog.windows import FEATURES_SQL
from freshet.functions.numeric import from_log_target
from freshet.operators import bands, distributions, evaluation, linear, panel, products, trees
from freshet.operators.groups import with_facts
from freshet.operators.windows import SeriesWindow, latest_rows
from freshet.plans import daily as daily_plan, monthly as monthly_plan
from freshet.plans.daily import DailyConfig
from freshet.session import durable

CONFIG = DailyConfig(TRAIN_END, VAL_END)
SPLIT = f"CASE WHEN year <= {TRAIN_END} THEN 'train' WHEN year <= {VAL_END} THEN 'val' ELSE 'test' END"

# Model rows: next-30-day target, prior inflow, rain and seasonality, thresholds from the training years.
ROWS = FEATURES_SQL + f""", plain AS (
  SELECT series_id, date_day, year, month, qin_30d, doy_sin, doy_cos, inflow_next30 AS y_true,
         inflow_next30_log AS y_log, {SPLIT} AS split FROM features
  WHERE qin_30d IS NOT NULL AND inflow_next30 IS NOT NULL),
limits AS (
  SELECT series_id, quantile_cont(y_true, 0.90) AS flood, quantile_cont(y_true, 0.75) AS event
  FROM plain WHERE split = 'train' GROUP BY 1),
model_rows AS (SELECT plain.*, flood, event FROM plain JOIN limits USING (series_id))"""


def model_rows(spark, sf_dir):
    features = daily_plan.daily_features(daily_log(spark, sf_dir))
    return daily_plan.model_table(features, None, CONFIG)[0]


def solve_sql(source: str, features: list[str], label: str, name: str, ridge: float = 0.0, where: str = "true") -> str:
    """CTEs that solve the normal equations by elimination; ``name`` ends up with n, b0, w0, w1, ..."""
    k = len(features)
    full = " AND ".join(f"{c} IS NOT NULL" for c in [*features, label])
    cells = [f"covar_pop({features[i]}, {features[j]})" + (f" + {ridge}::DOUBLE / count(*)" if i == j and ridge else "")
             + f" AS a{i}_{j}" for i in range(k) for j in range(k)]
    rhs = [f"covar_pop({features[i]}, {label}) AS r{i}" for i in range(k)]
    means = [f"avg({features[i]}) AS m{i}" for i in range(k)] + [f"avg({label}) AS my"]
    parts = [f"{name}_e0 AS (SELECT series_id, count(*) AS n, {', '.join(cells + rhs + means)} FROM {source} "
             f"WHERE {full} AND {where} GROUP BY 1)"]
    for p in range(k):
        ratio = lambda i: f"a{i}_{p} / a{p}_{p}"
        new = []
        for i in range(k):
            for j in range(k):
                new.append(f"a{i}_{j}" if i == p else f"a{i}_{j} - {ratio(i)} * a{p}_{j} AS a{i}_{j}")
            new.append(f"r{i}" if i == p else f"r{i} - {ratio(i)} * r{p} AS r{i}")
        keep = ", ".join(f"m{i}" for i in range(k))
        parts.append(f"{name}_e{p + 1} AS (SELECT series_id, n, my, {keep}, {', '.join(new)} FROM {name}_e{p})")
    weights = ", ".join(f"r{i} / a{i}_{i} AS w{i}" for i in range(k))
    dot = " - ".join(["my"] + [f"m{i} * r{i} / a{i}_{i}" for i in range(k)])
    parts.append(f"{name} AS (SELECT series_id, n, {dot} AS b0, {weights} FROM {name}_e{k})")
    return ",\n".join(parts)


def value_sql(features: list[str], alias: str = "") -> str:
    dot = alias + "." if alias else ""
    return " + ".join([f"{dot}b0"] + [f"{dot}w{i} * {c}" for i, c in enumerate(features)])


# splits, thresholds, weights


@query(
    "split_labels",
    select(DAILY, f"""SELECT series_id, date_day,
  CASE WHEN year(date_day) = 1996 THEN NULL WHEN year(date_day) <= {TRAIN_END} THEN 'train'
       WHEN year(date_day) <= {VAL_END} THEN 'val' ELSE 'test' END AS split FROM daily"""),
)
def _(spark, sf_dir):
    split = evaluation.split_by_year(F.year("date_day"), TRAIN_END, VAL_END, [1996])
    return daily_log(spark, sf_dir).select("series_id", "date_day", split.alias("split"))


@query(
    "hash_split",
    select(PRIORITY, """SELECT series_id, date_day,
  CASE WHEN CAST('0x' || substr(md5(strftime(date_day, '%Y-%m-%d') || '#42'), 1, 8) AS BIGINT) % 100 < 80
       THEN 'train' ELSE 'test' END AS split FROM prio"""),
)
def _(spark, sf_dir):
    return priority_log(spark, sf_dir).select(
        "series_id", "date_day", evaluation.hash_split(F.col("date_day"), 42).alias("split")
    )


@query(
    "ordered_split",
    select(PRIORITY, """SELECT series_id, date_day, inflow_adj,
  CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY date_day)
       <= floor(count(*) OVER (PARTITION BY series_id) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM prio"""),
)
def _(spark, sf_dir):
    return evaluation.ordered_split(priority_log(spark, sf_dir), "date_day")


@query(
    "tail_weights",
    select(ROWS, """SELECT series_id, date_day, split, y_true, round(flood, 2) AS flood, round(event, 2) AS event,
  CASE WHEN y_true >= flood THEN 3.0::DOUBLE WHEN y_true >= event THEN 1.8::DOUBLE ELSE 1.0::DOUBLE END AS weight,
  CASE WHEN y_true >= event THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS high FROM model_rows"""),
)
def _(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    return rounded(
        rows.select("series_id", "date_day", "split", "y_true", "flood", "event", "weight", "high"),
        {"flood": 2, "event": 2},
    )


# linear models


_TWO = ["qin_30d", "doy_sin"]


def _scaled(rows):
    return rows.withColumn("y_small", F.col("y_true") / 1e6).withColumn("q_small", F.col("qin_30d") / 1e6)


SCALED = ROWS + ", scaled AS (SELECT *, y_true / 1e6 AS y_small, qin_30d / 1e6 AS q_small FROM model_rows)"
_X3 = ["q_small", "doy_sin", "doy_cos"]


def _coefficients(model, k):
    flat = [F.round(F.col("coefficients")[i], 7).alias(f"w{i}") for i in range(k)]
    return model.select("series_id", "n", F.round("intercept", 5).alias("b0"), *flat)


_FLAT3 = "SELECT series_id, n, round(b0, 5) AS b0, round(w0, 7) AS w0, round(w1, 7) AS w1, round(w2, 7) AS w2 FROM m"


@query(
    "ols_closed_form",
    select(PRIORITY + f""", pairs AS (
  SELECT series_id, inflow_adj / 1e6 AS y, lag(inflow_adj) {over()} / 1e6 AS x FROM prio)""",
           """SELECT series_id, regr_count(y, x)::BIGINT AS n, round(regr_intercept(y, x), 7) AS b0,
  round(regr_slope(y, x), 9) AS w0 FROM pairs GROUP BY 1"""),
)
def _(spark, sf_dir):
    w = SeriesWindow()
    pairs = priority_log(spark, sf_dir).select(
        "series_id", (F.col("inflow_adj") / 1e6).alias("y"), (w.lag("inflow_adj") / 1e6).alias("x")
    )
    model = linear.fit_linear(pairs, ["x"], "y")
    return model.select(
        "series_id", "n", F.round("intercept", 7).alias("b0"), F.round(F.col("coefficients")[0], 9).alias("w0")
    )


@query("ols", select(SCALED + ", " + solve_sql("scaled", _X3, "y_small", "m", where="split = 'train'"), _FLAT3))
def _(spark, sf_dir):
    train = _scaled(model_rows(spark, sf_dir)).where("split = 'train'")
    return _coefficients(linear.fit_linear(train, _X3, "y_small"), 3)


@query("ridge", select(SCALED + ", " + solve_sql("scaled", _X3, "y_small", "m", ridge=1.0, where="split = 'train'"), _FLAT3))
def _(spark, sf_dir):
    train = _scaled(model_rows(spark, sf_dir)).where("split = 'train'")
    return _coefficients(linear.fit_linear(train, _X3, "y_small", "ridge", 1.0), 3)


def eliminated_sql(source: str, k: int, keys: str, name: str) -> str:
    """CTEs that solve the systems a{i}_{j}, r{i} in the rows of ``source``; ``name`` holds the keys and w0, w1, ..."""
    parts, previous = [], source
    for p in range(k):
        new = []
        for i in range(k):
            less = lambda x, y: x if i == p else f"{x} - a{i}_{p} / a{p}_{p} * {y} AS {x}"
            new += [less(f"a{i}_{j}", f"a{p}_{j}") for j in range(k)] + [less(f"r{i}", f"r{p}")]
        parts.append(f"{name}_e{p} AS (SELECT {keys}, {', '.join(new)} FROM {previous})")
        previous = f"{name}_e{p}"
    weights = ", ".join(f"r{i} / a{i}_{i} AS w{i}" for i in range(k))
    return ",\n".join([*parts, f"{name} AS (SELECT {keys}, {weights} FROM {previous})"])


def moments_sql(source: str, features: list[str], label: str, name: str, by: str = "series_id") -> str:
    """Counts, means m{i} and my, covariances c{i}_{j}, q{i} (with the label) and qy per group, over whole rows."""
    k = range(len(features))
    cells = [f"avg({features[i]}) AS m{i}" for i in k] + [f"avg({label}) AS my", f"var_pop({label}) AS qy"]
    cells += [f"covar_pop({features[i]}, {features[j]}) AS c{i}_{j}" for i in k for j in k]
    cells += [f"covar_pop({features[i]}, {label}) AS q{i}" for i in k]
    full = " AND ".join(f"{c} IS NOT NULL" for c in [*features, label])
    return f"{name} AS (SELECT {by}, count(*) AS n, {', '.join(cells)} FROM {source} WHERE {full} GROUP BY {by})"


def active_sets_sql(moments: str, k: int, name: str, by: str = "series_id", signs: tuple[int, ...] = (0, 1)) -> str:
    """The optimum among all sets of free coefficients: for each sign pattern the system of the free ones is solved, and
    the pattern that meets the optimality conditions stays. Signs (0, 1) without a penalty make non-negative least
    squares, (-1, 0, 1) with the column ``penalty`` the lasso. ``name`` holds by, n, b0, w{i} and the slopes g{i}."""
    r = range(k)
    on, pen = [f"s{i} <> 0" for i in r], "penalty" if -1 in signs else "0.0"
    system = [f"CASE WHEN {on[i]} AND {on[j]} THEN c{i}_{j} ELSE {float(i == j)} END::DOUBLE AS a{i}_{j}" for i in r for j in r]
    system += [f"CASE WHEN {on[i]} THEN q{i} - {pen} * s{i} ELSE 0.0 END::DOUBLE AS r{i}" for i in r]
    key = f"{by}, {', '.join(f's{i}' for i in r)}"
    values = " CROSS JOIN ".join(f"(VALUES {', '.join(f'({s})' for s in signs)}) t{i}(s{i})" for i in r)
    slope = [f"q{i} - " + " - ".join(f"c{i}_{j} * w{j}" for j in r) for i in r]
    limit = (lambda i: f"abs(g{i})") if -1 in signs else (lambda i: f"g{i}")
    off = [f"CASE WHEN {on[i]} THEN greatest(-s{i} * w{i}, 0) * c{i}_{i} ELSE greatest({limit(i)} - {pen}, 0) END / sqrt(c{i}_{i} * qy)" for i in r]
    mine = " AND ".join(f"o.{c} = p.{c}" for c in by.split(", "))
    columns = f"{', '.join('p.' + c for c in by.split(', '))}, n, {', '.join(f'w{i}, p.s{i}, m{i}, c{i}_{i}' for i in r)}, my, qy"
    extra = ", penalty" if -1 in signs and "penalty" not in by.split(", ") else ""
    return f"""{name}_p AS (SELECT * FROM {moments} CROSS JOIN {values}),
{name}_s AS (SELECT {key}, {', '.join(system)} FROM {name}_p),
{eliminated_sql(f'{name}_s', k, key, f'{name}_o')},
{name}_g AS (
  SELECT {columns}{extra}, {', '.join(f'{slope[i]} AS g{i}' for i in r)}
  FROM {name}_p p JOIN {name}_o o ON {mine} AND {' AND '.join(f'o.s{i} = p.s{i}' for i in r)}),
{name} AS (
  SELECT {by}{extra}, n, my - {' - '.join(f'w{i} * m{i}' for i in r)} AS b0, {', '.join(f'w{i}, g{i}' for i in r)} FROM {name}_g
  QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {' + '.join(off)}, {' + '.join(f'abs(s{i})' for i in r)}) = 1)"""


def nonnegative_sql(source: str, features: list[str], label: str, name: str) -> str:
    return moments_sql(source, features, label, f"{name}_m") + ",\n" + active_sets_sql(f"{name}_m", len(features), name)


def lasso_sql(source: str, features: list[str], label: str, name: str, order: str = "date_day", folds: int = 5, path: int = 100) -> str:
    """The lasso whose penalty has the smallest mean error over contiguous folds."""
    k = len(features)
    r = range(k)
    full = " AND ".join(f"{c} IS NOT NULL" for c in [*features, label])
    fold, penalty = "series_id, fold", "series_id, fold, j, penalty"
    others = f"(SELECT h.fold, f.* EXCLUDE (fold) FROM (SELECT DISTINCT {fold} FROM {name}_x) h JOIN {name}_x f ON h.series_id = f.series_id AND h.fold <> f.fold)"
    square = " + ".join(f"w{i} * w{j} * h.c{i}_{j}" for i in r for j in r)
    gap = "h.my - t.b0 - " + " - ".join(f"h.m{i} * w{i}" for i in r)
    return f"""{name}_x AS (SELECT *, ntile({folds}) OVER (PARTITION BY series_id ORDER BY {order}) AS fold FROM {source} WHERE {full}),
{moments_sql(f'{name}_x', features, label, f'{name}_held', fold)},
{moments_sql(others, features, label, f'{name}_fit', fold)},
{moments_sql(f'{name}_x', features, label, f'{name}_all')},
{name}_grid AS (
  SELECT series_id, j, greatest({', '.join(f'abs(q{i})' for i in r)}) * pow(1e-3, j / {path - 1}.0) AS penalty
  FROM {name}_all, (SELECT unnest(range(0, {path})) AS j)),
{name}_tries AS (SELECT f.*, g.j, g.penalty FROM {name}_fit f JOIN {name}_grid g ON f.series_id = g.series_id),
{active_sets_sql(f'{name}_tries', k, f'{name}_t', penalty, (-1, 0, 1))},
{name}_errors AS (
  SELECT t.series_id, t.j, any_value(t.penalty) AS penalty,
         avg(h.qy - 2 * ({' + '.join(f'w{i} * h.q{i}' for i in r)}) + {square} + pow({gap}, 2)) AS e
  FROM {name}_t t JOIN {name}_held h ON t.series_id = h.series_id AND t.fold = h.fold GROUP BY 1, 2),
{name}_best AS (SELECT series_id, penalty FROM {name}_errors QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(e, 9), j) = 1),
{name}_chosen AS (SELECT a.*, b.penalty FROM {name}_all a JOIN {name}_best b ON a.series_id = b.series_id),
{active_sets_sql(f'{name}_chosen', k, name, 'series_id', (-1, 0, 1))}"""


_LAGGED = ["x1", "x2", "x3", "x4"]
PRIO_LAGS = PRIORITY + f""", lagged AS (
  SELECT series_id, date_day, inflow_adj / 1e6 AS y, {', '.join(f"lag(inflow_adj, {k}) {over()} / 1e6 AS x{i}" for i, k in ((1, 1), (2, 7), (3, 30)))},
         (lag(inflow_adj, 2) {over()} - lag(inflow_adj, 1) {over()}) / 1e6 AS x4 FROM prio)"""


def _lagged(spark, sf_dir):
    w = SeriesWindow()
    lag = lambda k: w.lag("inflow_adj", k) / 1e6
    return durable(priority_log(spark, sf_dir).select(
        "series_id", "date_day", (F.col("inflow_adj") / 1e6).alias("y"), lag(1).alias("x1"), lag(7).alias("x2"),
        lag(30).alias("x3"), ((w.lag("inflow_adj", 2) - w.lag("inflow_adj", 1)) / 1e6).alias("x4"),
    ))


def _certified(model, k, more=()):
    """Rounded coefficients with the slopes that prove them."""
    cells = [c for i in range(k) for c in (
        F.round(F.col("coefficients")[i], 7).alias(f"w{i}"), (F.round(F.col("slopes")[i], 6) + 0.0).alias(f"g{i}"))]
    return model.select("series_id", *more, F.round("intercept", 5).alias("b0"), *cells)


@query(
    "non_negative",
    select(PRIO_LAGS + ", " + nonnegative_sql("lagged", _LAGGED, "y", "m"), "SELECT series_id, n, round(b0, 5) AS b0, " + ", ".join(
        f"round(w{i}, 7) AS w{i}, round(g{i}, 6) + 0.0 AS g{i}" for i in range(4)) + " FROM m"),
)
def _(spark, sf_dir):
    """Four lags, one of which enters twice with opposite signs, so that sides of the region are touched."""
    return _certified(linear.fit_linear(_lagged(spark, sf_dir), _LAGGED, "y", "non_negative"), 4, ["n"])


def _lasso_columns(k):
    return "SELECT series_id, round(penalty, 7) AS penalty, round(b0, 5) AS b0, " + ", ".join(
        f"round(w{i}, 7) + 0.0 AS w{i}, round(g{i}, 6) + 0.0 AS g{i}" for i in range(k)) + " FROM m"


@query("lasso_cv", select(PRIO_LAGS + ", " + lasso_sql("lagged", _LAGGED[:3], "y", "m"), _lasso_columns(3)))
def _(spark, sf_dir):
    model = linear.fit_lasso_cv(_lagged(spark, sf_dir), _LAGGED[:3], "y", "date_day")
    return _certified(model, 3, [F.round("penalty", 7).alias("penalty")])


TRAIN_SCALED = SCALED + ", train AS (SELECT * FROM scaled WHERE split = 'train')"


@query("lasso_cv_daily", select(TRAIN_SCALED + ", " + lasso_sql("train", _X3, "y_small", "m"), _lasso_columns(3)))
def _(spark, sf_dir):
    """All features of the daily model."""
    train = durable(_scaled(model_rows(spark, sf_dir)).where("split = 'train'"))
    model = linear.fit_lasso_cv(train, _X3, "y_small", "date_day")
    return _certified(model, 3, [F.round("penalty", 7).alias("penalty")])


@query(
    "model_formula",
    select(SCALED + ", " + solve_sql("scaled", _X3, "y_small", "m", where="split = 'train'"),
           """SELECT series_id, printf('inflow = %.3f + (%.3f * q_small) + (%.3f * doy_sin) + (%.3f * doy_cos)',
  b0, w0, w1, w2) AS formula FROM m"""),
)
def _(spark, sf_dir):
    train = _scaled(model_rows(spark, sf_dir)).where("split = 'train'")
    model = linear.fit_linear(train, _X3, "y_small")
    return model.select("series_id", linear.formula(_X3, "inflow").alias("formula"))


# scores: a log-target line against the last 30 days' inflow


PREDICTED = ROWS + ", " + solve_sql("model_rows", ["qin_30d"], "y_log", "m", where="split = 'train'") + """,
side AS (SELECT r.*, exp(b0 + w0 * qin_30d) - 1 AS y_line, qin_30d AS y_last FROM model_rows r JOIN m USING (series_id)),
long AS (
  SELECT series_id, date_day, month, split, y_true, flood, event, 'linear' AS name, y_line AS y_pred FROM side
  UNION ALL SELECT series_id, date_day, month, split, y_true, flood, event, 'last_value', y_last FROM side)"""
KEEP = ["series_id", "date_day", "month", "split", "y_true", "flood", "event"]


def scores_sql(source: str, by: str, name: str = "scores") -> str:
    return f"""{name} AS (
  SELECT {by}, count(*) AS n, avg(abs(y_true - y_pred)) AS mae, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse,
    1 - sum(pow(y_true - y_pred, 2)) / (var_pop(y_true) * count(*)) AS r2,
    1 - sum(pow(y_true - y_pred, 2)) / (var_pop(y_true) * count(*)) AS nse, max(flood) AS flood_threshold,
    count(*) FILTER (y_true >= flood) AS flood_n, avg(abs(y_true - y_pred)) FILTER (y_true >= flood) AS flood_mae,
    sqrt(avg(pow(y_true - y_pred, 2)) FILTER (y_true >= flood)) AS flood_rmse, max(event) AS event_threshold,
    count(*) FILTER (y_true >= event) AS event_n,
    CASE WHEN count(*) FILTER (y_true >= event) > 0 THEN count(*) FILTER (y_true >= event AND y_pred >= event)
      / count(*) FILTER (y_true >= event) END AS event_recall,
    CASE WHEN count(*) FILTER (y_pred >= event) > 0 THEN count(*) FILTER (y_true >= event AND y_pred >= event)
      / count(*) FILTER (y_pred >= event) END AS event_precision
  FROM {source} GROUP BY {by})"""


_SCORE_DIGITS = {"mae": 1, "rmse": 1, "r2": 8, "nse": 8, "flood_threshold": 2, "flood_mae": 1, "flood_rmse": 1,
                 "event_threshold": 2, "event_recall": 9, "event_precision": 9}
_ROUND_SCORES = "SELECT * REPLACE (" + ", ".join(f"round({c}, {d}) AS {c}" for c, d in _SCORE_DIGITS.items()) + ") FROM scores"


def predicted_long(spark, sf_dir):
    rows = durable(model_rows(spark, sf_dir))
    model = linear.fit_linear(rows.where("split = 'train'"), ["qin_30d"], "y_log")
    out = linear.predict_linear(rows, model, ["qin_30d"], "y_line")
    out = out.withColumns({"y_line": from_log_target(F.col("y_line")), "y_last": F.col("qin_30d")})
    return evaluation.stack_predictions(out, {"linear": "y_line", "last_value": "y_last"}, KEEP)


def _scores(long):
    return evaluation.score(long, ["series_id", "split", "name"], flood="flood", event="event")


@query("metrics_by_split", select(PREDICTED + ", " + scores_sql("long", "series_id, split, name"), _ROUND_SCORES))
def _(spark, sf_dir):
    return rounded(_scores(predicted_long(spark, sf_dir)), _SCORE_DIGITS)


@query(
    "best_model",
    select(PREDICTED + ", " + scores_sql("long", "series_id, split, name"), """SELECT series_id, name FROM scores
WHERE split = 'val' QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY flood_mae, mae, rmse) = 1"""),
)
def _(spark, sf_dir):
    return evaluation.best_model(_scores(predicted_long(spark, sf_dir)))


@query(
    "cadence_metrics",
    select(PREDICTED + """, tagged AS (
  SELECT 'daily_all' AS cadence, * FROM long WHERE split = 'test' AND name = 'linear' UNION ALL
  SELECT 'monthly_day1', * FROM long WHERE split = 'test' AND name = 'linear' AND day(date_day) = 1), """
           + scores_sql("tagged", "series_id, cadence"), _ROUND_SCORES),
)
def _(spark, sf_dir):
    test = predicted_long(spark, sf_dir).where("split = 'test' AND name = 'linear'")
    return rounded(evaluation.cadence_scores(test, 1, flood="flood", event="event"), _SCORE_DIGITS)


@query(
    "model_comparison_wide",
    select(PREDICTED, """SELECT series_id, date_day, y_true, round(max(y_pred) FILTER (name = 'linear'), 1) AS y_lin,
  max(y_pred) FILTER (name = 'last_value') AS y_last FROM long WHERE split = 'test' GROUP BY 1, 2, 3"""),
)
def _(spark, sf_dir):
    test = predicted_long(spark, sf_dir).where("split = 'test'")
    wide = evaluation.widen_predictions(test, {"linear": "y_lin", "last_value": "y_last"}, ["series_id", "date_day"])
    return rounded(wide, {"y_lin": 1})


@query(
    "outlier_flags",
    select(PREDICTED, """SELECT date_day, name,
  abs(y_true - y_pred) > 2 * stddev_pop(y_true - y_pred) OVER (PARTITION BY series_id, name) AS outlier
FROM long WHERE split = 'test'"""),
)
def _(spark, sf_dir):
    test = predicted_long(spark, sf_dir).where("split = 'test'")
    return evaluation.outlier_flags(test, "y_true", "y_pred", ["series_id", "name"]).select("date_day", "name", "outlier")


@query(
    "trend_line",
    select(PREDICTED, """SELECT series_id, name, round(regr_slope(y_pred, y_true), 8) AS slope,
  round(regr_intercept(y_pred, y_true), 1) AS intercept FROM long WHERE split = 'test' GROUP BY 1, 2"""),
)
def _(spark, sf_dir):
    test = predicted_long(spark, sf_dir).where("split = 'test'")
    return rounded(evaluation.trend_line(test, "y_true", "y_pred", ["series_id", "name"]), {"slope": 8, "intercept": 1})


# bands and products


def bands_sql(source: str) -> str:
    """Band offsets per month from the residuals r of ``source`` (series_id, month, r)."""
    q = {"lo90": 0.05, "hi90": 0.95, "lo50": 0.25, "hi50": 0.75}
    cells = ", ".join(f"quantile_cont(r, {p}) AS {b}" for b, p in q.items())
    mix = ", ".join(
        f"CASE WHEN wm + ws > 0 THEN (wm * m.{b} + ws * s.{b}) / (wm + ws) ELSE g.{b} END AS {b}" for b in q)
    season = """CASE WHEN month IN (12, 1, 2) THEN 'DJF' WHEN month IN (3, 4, 5) THEN 'MAM'
  WHEN month IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"""
    return f"""ends AS (SELECT series_id, quantile_cont(r, 0.01) AS lo, quantile_cont(r, 0.99) AS hi FROM {source} GROUP BY 1),
wins AS (SELECT t.series_id, month, {season} AS season, greatest(least(r, hi), lo) AS r FROM {source} t JOIN ends USING (series_id)),
bm AS (SELECT series_id, month, season, count(*) AS n, {cells} FROM wins GROUP BY 1, 2, 3),
bs AS (SELECT series_id, season, count(*) AS n, {cells} FROM wins GROUP BY 1, 2),
bg AS (SELECT series_id, {cells} FROM wins GROUP BY 1),
weighted AS (
  SELECT bm.series_id, bm.month, bm.season, CASE WHEN bm.n >= 10 THEN least(1.0, bm.n / 30) ELSE 0.0 END AS wm,
         bs.n AS sn FROM bm JOIN bs ON bm.series_id = bs.series_id AND bm.season = bs.season),
bands AS (
  SELECT m.series_id, m.month, m.n, {mix}
  FROM (SELECT *, CASE WHEN sn >= 20 THEN 1 - wm ELSE 0.0 END AS ws FROM weighted) w
  JOIN bm m ON w.series_id = m.series_id AND w.month = m.month
  JOIN bs s ON w.series_id = s.series_id AND w.season = s.season JOIN bg g ON w.series_id = g.series_id
  UNION ALL SELECT series_id, NULL, NULL, lo90, hi90, lo50, hi50 FROM bg)"""


_VAL = """, val AS (SELECT series_id, month, y_true - y_pred AS r FROM long WHERE split = 'val' AND name = 'last_value')"""
_BANDS = ["lo90", "hi90", "lo50", "hi50"]


def _val_residuals(long):
    val = long.where("split = 'val' AND name = 'last_value'")
    return val.withColumn("residual", F.col("y_true") - F.col("y_pred"))


@query(
    "quantile_bands",
    select(PREDICTED + _VAL + ", " + bands_sql("val"), "SELECT series_id, CAST(month AS INTEGER) AS month, n, "
           + ", ".join(f"round({b}, 3) AS {b}" for b in _BANDS) + " FROM bands"),
)
def _(spark, sf_dir):
    out = bands.residual_bands(_val_residuals(durable(predicted_long(spark, sf_dir))), "residual")
    return rounded(out, {b: 3 for b in _BANDS})


_INTERVALS = """, wide_bands AS (SELECT * FROM bands WHERE month IS NULL),
test AS (SELECT * FROM long WHERE split = 'test' AND name = 'last_value'),
ivals AS (
  SELECT t.series_id, t.date_day, y_true AS y_true_next30, y_pred AS y_pred_next30, """ + ", ".join(
    f"y_pred + coalesce(b.{b}, g.{b}) AS y_{b}" for b in _BANDS) + """
  FROM test t JOIN wide_bands g ON t.series_id = g.series_id
  LEFT JOIN bands b ON t.series_id = b.series_id AND t.month = b.month)"""
_ROUND_IVALS = "SELECT * REPLACE (" + ", ".join(f"round(y_{b}, 3) AS y_{b}" for b in _BANDS) + ") FROM ivals"


def _intervals(spark, sf_dir):
    long = durable(predicted_long(spark, sf_dir))
    offsets = bands.residual_bands(_val_residuals(long), "residual")
    test = long.where("split = 'test' AND name = 'last_value'")
    out = bands.with_intervals(test, offsets).select(
        "series_id", "date_day", F.col("y_true").alias("y_true_next30"), F.col("y_pred").alias("y_pred_next30"),
        *[f"y_{b}" for b in _BANDS],
    )
    return rounded(out, {f"y_{b}": 3 for b in _BANDS})


@query("forecast_intervals", select(PREDICTED + _VAL + ", " + bands_sql("val") + _INTERVALS, _ROUND_IVALS))
def _(spark, sf_dir):
    return _intervals(spark, sf_dir)


@query("issue_day_forecast", select(PREDICTED + _VAL + ", " + bands_sql("val") + _INTERVALS,
                                    _ROUND_IVALS + " WHERE day(date_day) = 1"))
def _(spark, sf_dir):
    return evaluation.issue_day_rows(_intervals(spark, sf_dir), 1)


_F3 = ["qin_30d", "doy_sin", "doy_cos"]
LINEAR3 = ROWS + ", " + solve_sql("model_rows", _F3, "y_log", "m", where="split = 'train'") + f""",
long AS (
  SELECT r.series_id, date_day, month, split, y_true, flood, event, 'linear' AS name,
         exp({value_sql(_F3, 'm')}) - 1 AS y_pred FROM model_rows r JOIN m USING (series_id)),
val AS (SELECT series_id, month, y_true - y_pred AS r FROM long WHERE split = 'val'), """ + bands_sql("val") \
    + _INTERVALS.replace("last_value", "linear")


_LARGE = ["y_pred_next30"] + [f"y_{b}" for b in _BANDS]


@query(
    "daily_forecast_linear",
    select(LINEAR3, "SELECT * REPLACE (" + ", ".join(f"round({c} / 1e6, 5) AS {c}" for c in _LARGE) + ") FROM ivals"),
)
def _(spark, sf_dir):
    """The whole daily analysis with the linear model; predictions in millions."""
    config = DailyConfig(TRAIN_END, VAL_END, models=("linear",))
    out = daily_plan.daily_forecast(daily_log(spark, sf_dir), config=config).forecast
    return out.withColumns({c: F.round(F.col(c) / 1e6, 5) for c in _LARGE})


_F12 = [*_F3, *daily_plan.PANEL_FEATURES]
_CELLS = ", ".join(
    f"max({f}) FILTER (subbasin = '{sb}') AS {n}" for n in daily_plan.PANEL_FEATURES for f, sb in [panel.cell_name(n)])
LINEAR12 = FEATURES_SQL + ", " + panel_query_sql(True) + f""", wide AS (SELECT date_day, {_CELLS} FROM panel GROUP BY 1),
plain AS (
  SELECT f.series_id, f.date_day, year, month, {', '.join(_F12)}, inflow_next30 AS y_true, inflow_next30_log AS y_log, {SPLIT} AS split
  FROM features f LEFT JOIN wide ON f.date_day = wide.date_day
  WHERE inflow_next30 IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in _F12)})""" \
    + LINEAR3[LINEAR3.index(",\nlimits AS"):].replace(
        solve_sql("model_rows", _F3, "y_log", "m", where="split = 'train'"), solve_sql("model_rows", _F12, "y_log", "m", where="split = 'train'")
    ).replace(value_sql(_F3, "m"), value_sql(_F12, "m"))


@query(
    "daily_forecast_linear_panel",
    select(LINEAR12, "SELECT * REPLACE (" + ", ".join(f"round({c} / 1e6, 4) AS {c}" for c in _LARGE) + ") FROM ivals"),
)
def _(spark, sf_dir):
    """The whole daily analysis with the published subbasin features and the linear model; predictions in millions."""
    config = DailyConfig(TRAIN_END, VAL_END, models=("linear",))
    rain, soil = rain_by_area(spark, sf_dir), soil_by_area(spark, sf_dir)
    out = daily_plan.daily_forecast(daily_log(spark, sf_dir), rain, soil, config).forecast
    return out.withColumns({c: F.round(F.col(c) / 1e6, 4) for c in _LARGE})


@query("interval_coverage", select(LINEAR3 + """, covered AS (
  SELECT t.series_id, t.month, (y_true BETWEEN y_lo90 AND y_hi90)::INTEGER AS c90, (y_true BETWEEN y_lo50 AND y_hi50)::INTEGER AS c50
  FROM test t JOIN ivals i ON t.series_id = i.series_id AND t.date_day = i.date_day)""",
    """SELECT series_id, CAST(month AS INTEGER) AS month, count(*) AS n, round(avg(c90), 6) AS covered_90, round(avg(c50), 6) AS covered_50
FROM covered GROUP BY 1, 2 UNION ALL SELECT series_id, NULL, count(*), round(avg(c90), 6), round(avg(c50), 6) FROM covered GROUP BY 1"""))
def _(spark, sf_dir):
    """Share of the test rows inside their bands, for each month and for all (month null)."""
    config = DailyConfig(TRAIN_END, VAL_END, models=("linear",))
    rows = durable(daily_plan.daily_forecast(daily_log(spark, sf_dir), config=config).forecast.withColumn("month", F.month("date_day")))
    by_month = evaluation.coverage(rows, ["series_id", "month"], "y_true_next30")
    whole = evaluation.coverage(rows, ["series_id"], "y_true_next30").withColumn("month", F.lit(None).cast("int"))
    return rounded(by_month.unionByName(whole), {"covered_90": 6, "covered_50": 6})


_CUTS = SCALED + """, cuts AS (SELECT DISTINCT series_id, year AS cut FROM scaled),
upto AS (
  SELECT c.series_id || '#' || c.cut AS series_id, c.series_id AS own, c.cut, r.* EXCLUDE (series_id)
  FROM cuts c JOIN scaled r ON r.series_id = c.series_id AND r.year <= c.cut), """ + solve_sql("upto", _X3, "y_small", "m") + f""",
spreads AS (
  SELECT u.series_id, u.own, u.cut, any_value(m.n) AS n_train, sqrt(sum(pow(y_small - ({value_sql(_X3)}), 2)) / (any_value(m.n) - 4)) AS sigma
  FROM upto u JOIN m USING (series_id) GROUP BY 1, 2, 3 HAVING any_value(m.n) >= 6),
ahead AS (
  SELECT s.own AS series_id, s.cut, s.n_train, r.y_small AS y, {value_sql(_X3)} AS f, sigma
  FROM spreads s JOIN m USING (series_id) JOIN scaled r ON r.series_id = s.own AND r.year = s.cut + 1)"""
_INSIDE = lambda share: f"round(avg((abs(y - f) <= sigma * {NormalDist().inv_cdf((1 + share) / 2)!r})::INTEGER), 6)"


@query("rolling_backtest", select(_CUTS, f"""SELECT series_id, CAST(cut AS BIGINT) AS cut, count(*) AS n, max(n_train) AS n_train,
  round(avg(abs(y - f)), 6) AS mae, round(sqrt(avg(pow(y - f, 2))), 6) AS rmse,
  round(1 - sum(pow(y - f, 2)) / (var_pop(y) * count(*)), 6) AS r2, {_INSIDE(0.9)} AS covered_90, {_INSIDE(0.5)} AS covered_50
FROM ahead GROUP BY 1, 2"""))
def _(spark, sf_dir):
    """Each year predicted from all years before it: errors and interval coverage per cut year."""
    rows = durable(_scaled(model_rows(spark, sf_dir)).select("series_id", "year", *_X3, "y_small"))
    ahead = durable(linear.rolling_origin(rows, _X3, "y_small"))
    scores = evaluation.score(ahead, ["series_id", "cut", "n_train"], y="y_small").select(
        "series_id", "cut", "n", F.col("n_train").cast("long").alias("n_train"), "mae", "rmse", "r2"
    )
    covered = evaluation.coverage(ahead, ["series_id", "cut"], "y_small", prefix="").drop("n")
    return rounded(scores.join(covered, ["series_id", "cut"]), {c: 6 for c in ("mae", "rmse", "r2", "covered_90", "covered_50")})


# tree models: SQL cannot fit them, but it knows what holds for each of them. Forests have the published sizes. Boosting
# rounds run one after another, several Spark jobs each, so the queries run fewer rounds than published; README.md gives
# the measured time of a round.


_TREE_KEYS = ["series_id", "date_day", "split", "y_true"]


def _fact_sql(name: str) -> str:
    return select(ROWS, f"SELECT {', '.join(_TREE_KEYS)}, true AS {name} FROM model_rows")


def _within(rows, column: str = "y_pred"):
    """Whether a prediction lies in the range of its series' training values, as means of these do."""
    on_train = F.when(F.col("split") == "train", F.col("y_true"))
    ranged = with_facts(rows, [F.min(on_train).alias("_low"), F.max(on_train).alias("_high")], ["series_id"])
    return ranged.withColumn("in_range", F.col(column).between(F.col("_low") * (1 - 1e-9), F.col("_high") * (1 + 1e-9)))


def _forest(spark, sf_dir, spec, weight=None):
    def fit(train):
        model = trees.fit_forest(train, _F3, "y_log", spec, weight)
        return lambda df: trees.predict(df, model, _F3)

    out = trees.per_series(durable(model_rows(spark, sf_dir)), {"y_pred": fit})
    return _within(out).select(*_TREE_KEYS, "in_range")


@query("forest", _fact_sql("in_range"))
def _(spark, sf_dir):
    return _forest(spark, sf_dir, trees.DAILY_FOREST)


@query("weighted_forest", _fact_sql("in_range"))
def _(spark, sf_dir):
    return _forest(spark, sf_dir, trees.WEIGHTED_FOREST, "weight")


@query("regime_blend", _fact_sql("between_regimes"))
def _(spark, sf_dir):
    """The blend lies between the forecasts of its two regimes."""
    rows = durable(model_rows(spark, sf_dir))
    blend = trees.fit_regime_blend(rows.where("split = 'train'"), _F3, "y_log", "high", "weight")
    if blend is None:
        raise ValueError(f"a regime has fewer than {trees.REGIME_MIN_ROWS} training rows")
    out = trees.predict_regime_blend(rows, blend, _F3, parts=True)
    low, high = F.least("y_pred_low", "y_pred_high"), F.greatest("y_pred_low", "y_pred_high")
    return out.select(*_TREE_KEYS, F.col("y_pred").between(low * (1 - 1e-9), high * (1 + 1e-9)).alias("between_regimes"))


@query("boosted_trees", _fact_sql("above_zero"))
def _(spark, sf_dir):
    """Sums of trees may leave the training range, but stay finite and, in this table, above zero."""

    def fit(train):
        model = trees.fit_boosted(train, _F3, "y_log", trees.BoostSpec(rounds=10))
        return lambda df: trees.predict(df, model, _F3)

    out = trees.per_series(durable(model_rows(spark, sf_dir)), {"y_pred": fit})
    known = (F.col("y_pred") > 0) & (F.col("y_pred") < float("inf"))
    return out.select(*_TREE_KEYS, known.alias("above_zero"))


@query("daily_forecast")
def _(spark, sf_dir):
    """Subbasin features, all six models, selection, bands and the test forecast of the best model."""
    config = DailyConfig(TRAIN_END, VAL_END, boost_share=0.02)
    result = daily_plan.daily_forecast(
        daily_log(spark, sf_dir), rain_by_area(spark, sf_dir), soil_by_area(spark, sf_dir), config
    )
    return result.forecast.join(result.best, "series_id")


@query("monthly_forecast")
def _(spark, sf_dir):
    """Scores of every monthly model."""
    wanted = [c for c in monthly_plan.FEATURES if not c.startswith("soil")]
    result = monthly_plan.monthly_forecast(
        daily_log(spark, sf_dir), None, TRAIN_END, VAL_END, features=wanted, boost_share=0.01
    )
    return result.scores


# month forecasts


FOUR = monthly_plan.MONTH_FEATURES
SCALED_ONLY = """scaled AS (
  SELECT * REPLACE (inflow_adj / 1e6 AS inflow_adj, inflow_next / 1e6 AS inflow_next) FROM history)"""
IN_MILLIONS = HISTORY + ", " + SCALED_ONLY
FITTED4 = IN_MILLIONS + ", " + nonnegative_sql("scaled", FOUR, "inflow_next", "m")
_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in FOUR)
_FITTED = FITTED4 + f""", fitted AS (
  SELECT h.series_id, h.year, {value_sql(FOUR)} AS predicted_inflow
  FROM scaled h JOIN m USING (series_id) WHERE h.month = 1 AND {_WHOLE})"""


def _history(spark, sf_dir):
    """Month table with the inflow in millions."""
    history = monthly_plan.month_history_table(daily_log(spark, sf_dir))
    return durable(history.withColumns({c: F.col(c) / 1e6 for c in ("inflow_adj", "inflow_next")}))


@query("fitted_by_year", select(_FITTED, "SELECT series_id, year, round(predicted_inflow, 6) AS predicted_inflow FROM fitted"))
def _(spark, sf_dir):
    out = linear.fitted_by_year(_history(spark, sf_dir), FOUR, "inflow_next", 1)
    return rounded(out, {"predicted_inflow": 6})


@query(
    "latest_years",
    select(_FITTED, """SELECT series_id, year, round(predicted_inflow, 6) AS predicted_inflow FROM fitted
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY year DESC) <= 4"""),
)
def _(spark, sf_dir):
    out = products.latest_years(linear.fitted_by_year(_history(spark, sf_dir), FOUR, "inflow_next", 1), 4)
    return rounded(out, {"predicted_inflow": 6})


SIMULATED = FITTED4 + f""", inputs AS (
  SELECT h.series_id, h.year, h.month, h.simulated_rain, b0, w0, w1, w2, w3, {', '.join(
      f"coalesce({'simulated_rain' if c == 'rainfall_next' else c}, m{i}) AS x{i}" for i, c in enumerate(FOUR))}
  FROM (SELECT *, CASE WHEN rainfall IS NOT NULL THEN greatest(rainfall, 0) END AS simulated_rain FROM scaled WHERE month = 1) h
       JOIN m USING (series_id) JOIN m_m USING (series_id)),
simulated AS (
  SELECT series_id, year, month, simulated_rain,
         round(greatest(b0 + w0 * x0 + w1 * x1 + w2 * x2 + w3 * x3, 0), 2) AS predicted_inflow FROM inputs)"""


def _simulated(spark, sf_dir):
    return linear.simulated_by_year(_history(spark, sf_dir), FOUR, "inflow_next", 1, "rainfall", "rainfall_next")


@query(
    "simulated_inflow",
    select(SIMULATED, "SELECT * FROM simulated"),
)
def _(spark, sf_dir):
    return _simulated(spark, sf_dir)


@query(
    "prediction_summary",
    select(SIMULATED, """SELECT series_id, month, round(avg(predicted_inflow), 7) AS mean_predicted,
  min(predicted_inflow) AS min_predicted, max(predicted_inflow) AS max_predicted
FROM simulated GROUP BY 1, 2"""),
)
def _(spark, sf_dir):
    out = products.prediction_summary(_simulated(spark, sf_dir), "predicted_inflow", ["series_id", "month"])
    return rounded(out, {"mean_predicted": 7})


@query(
    "last12_with_forecast",
    select(SIMULATED + """, observed AS (
  SELECT series_id, date, inflow_adj, NULL::DOUBLE AS low, NULL::DOUBLE AS high, 'observed' AS kind FROM scaled
  WHERE inflow_adj IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) <= 12),
ahead AS (
  SELECT o.series_id, CAST(max(o.date) + INTERVAL 1 MONTH AS DATE) AS date, any_value(s.mean) AS inflow, any_value(s.low) AS low,
         any_value(s.high) AS high, 'forecast' AS kind
  FROM observed o JOIN (SELECT series_id, avg(predicted_inflow) AS mean, min(predicted_inflow) AS low,
                               max(predicted_inflow) AS high FROM simulated GROUP BY 1) s ON o.series_id = s.series_id
  GROUP BY 1)""",
           """SELECT series_id, date, round(inflow_adj, 7) AS inflow, low, high, kind,
  strftime(date, '%b') AS label FROM (SELECT * FROM observed UNION ALL SELECT * FROM ahead)"""),
)
def _(spark, sf_dir):
    history = _history(spark, sf_dir)
    simulated = linear.simulated_by_year(history, FOUR, "inflow_next", 1, "rainfall", "rainfall_next")
    summary = products.prediction_summary(simulated, "predicted_inflow", ["series_id"])
    out = products.recent_months_with_forecast(history, "inflow_adj", summary)
    return rounded(out, {"inflow": 7})


_MARKED = IN_MILLIONS + """, marked AS (
  SELECT *, CASE WHEN CAST('0x' || substr(md5(strftime(date, '%Y-%m-%d') || '#42'), 1, 8) AS BIGINT) % 100 < 80
                 THEN 'train' ELSE 'test' END AS split FROM scaled WHERE inflow_next IS NOT NULL AND """ + _WHOLE + "), " \
    + nonnegative_sql("(SELECT * FROM marked WHERE split = 'train')", FOUR, "inflow_next", "m")


@query(
    "positive_regression_scores",
    select(_MARKED + f", p AS (SELECT series_id, split, inflow_next AS y, {value_sql(FOUR)} AS f FROM marked JOIN m USING (series_id))",
           """SELECT series_id, split, count(*) AS n, round(avg(abs(y - f)), 5) AS mae, round(sqrt(avg(pow(y - f, 2))), 5) AS rmse,
  round(1 - sum(pow(y - f, 2)) / (var_pop(y) * count(*)), 6) AS r2, round(1 - sum(pow(y - f, 2)) / (var_pop(y) * count(*)), 6) AS nse,
  round(avg(pow(y - f, 2)), 3) AS mse FROM p GROUP BY 1, 2"""),
)
def _(spark, sf_dir):
    """The non-negative month model fitted on four fifths of the months, scored on both parts."""
    scores = linear.held_out_scores(_history(spark, sf_dir), FOUR, "inflow_next", "date", "non_negative")
    return rounded(scores, {"mae": 5, "rmse": 5, "r2": 6, "nse": 6, "mse": 3})


@query(
    "last12",
    select(HISTORY, """SELECT series_id, date, inflow_adj FROM history WHERE inflow_adj > 0
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) <= 12"""),
)
def _(spark, sf_dir):
    known = monthly_plan.month_history_table(daily_log(spark, sf_dir)).where("inflow_adj > 0")
    return latest_rows(known, SeriesWindow(order=["date"]), 12).select("series_id", "date", "inflow_adj")


_SCENARIO = """, newest AS (
  SELECT * FROM history WHERE month = 1 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) = 1)"""


@query(
    "scenario_predict",
    select(NORMAL + ", " + SCALED_ONLY + ", " + nonnegative_sql("scaled", FOUR, "inflow_next", "m") + _SCENARIO + """, points AS (
  SELECT series_id, 'lower' AS scenario, mean - 2 * sigma AS x FROM fit WHERE month = 1
  UNION ALL SELECT series_id, 'mean', mean FROM fit WHERE month = 1
  UNION ALL SELECT series_id, 'upper', mean + 2 * sigma FROM fit WHERE month = 1)""",
           """SELECT p.series_id, scenario, round(x, 4) AS rainfall_next, round(b0 + w0 * rainfall_1 + w1 * rainfall + w2 * x + w3 * evap_in, 6) AS predicted_inflow
FROM points p JOIN m USING (series_id) JOIN newest n ON n.series_id = p.series_id"""),
)
def _(spark, sf_dir):
    history = _history(spark, sf_dir)
    model = linear.fit_linear(history, FOUR, "inflow_next", "non_negative")
    january = history.where("month = 1")
    bounds = distributions.normal_bounds(january, "rainfall").drop("month")
    newest = latest_rows(january, SeriesWindow(order=["date"]))
    out = linear.scenario_predictions(bounds, model, newest, FOUR, "rainfall_next")
    return rounded(out, {"rainfall_next": 4, "predicted_inflow": 6})


@query(
    "scenario_predict_gamma",
    select(GAMMA_ML + ", " + _quantiles_sql("(SELECT * FROM shapes WHERE month = 1)", {"lower": 0.025, "upper": 0.975})
           + ", " + SCALED_ONLY + ", " + nonnegative_sql("scaled", FOUR, "inflow_next", "m") + _SCENARIO + """, points AS (
  SELECT series_id, name AS scenario, mean / shape * z AS x FROM found
  UNION ALL SELECT series_id, 'mean', mean FROM shapes WHERE month = 1)""",
           """SELECT p.series_id, scenario, round(x, 3) AS rainfall_next, round(b0 + w0 * rainfall_1 + w1 * rainfall + w2 * x + w3 * evap_in, 6) AS predicted_inflow
FROM points p JOIN m USING (series_id) JOIN newest n ON n.series_id = p.series_id"""),
)
def _(spark, sf_dir):
    history = _history(spark, sf_dir)
    model = linear.fit_linear(history, FOUR, "inflow_next", "non_negative")
    january = history.where("month = 1")
    fit = distributions.gamma_fit(january, "rainfall")
    bounds = distributions.with_gamma_interval(fit, 0.95, "").select("series_id", "lower", "mean", "upper")
    newest = latest_rows(january, SeriesWindow(order=["date"]))
    out = linear.scenario_predictions(bounds, model, newest, FOUR, "rainfall_next")
    return rounded(out, {"rainfall_next": 3, "predicted_inflow": 6})


_R7 = monthly_plan.RAIN_INPUTS
RAIN_ROWS = MONTH_MEANS + f""", tall AS (SELECT *, rain_dam_in + rain_bsn_in AS rainfall FROM months),
history AS (
  SELECT *, lead(rainfall) {over('date')} AS rainfall_next, """ + ", ".join(
    f"lag({c}, {k}) {over('date')} AS {n}_{k}" for c, n in (("rainfall", "rainfall"), ("evap_in", "evap")) for k in range(1, 4)
) + f""" FROM tall),
complete AS (
  SELECT *, CASE WHEN CAST('0x' || substr(md5(strftime(date, '%Y-%m-%d') || '#42'), 1, 8) AS BIGINT) % 100 < 80
                 THEN 'train' ELSE 'test' END AS split
  FROM history WHERE rainfall_next IS NOT NULL AND """ + " AND ".join(f"{c} IS NOT NULL" for c in _R7) + "), " \
    + solve_sql("complete", _R7, "rainfall_next", "m", where="split = 'train'")


@query(
    "next_month_rain",
    select(RAIN_ROWS, f"""SELECT series_id, CAST(date + INTERVAL 1 MONTH AS DATE) AS date, round({value_sql(_R7, 'm')}, 4) AS rainfall
FROM complete JOIN m USING (series_id) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) = 1"""),
)
def _(spark, sf_dir):
    return rounded(monthly_plan.next_month_rain(durable(daily_log(spark, sf_dir)))[1], {"rainfall": 4})


@query(
    "next_month_rain_scores",
    select(RAIN_ROWS + f", p AS (SELECT series_id, split, rainfall_next AS y, {value_sql(_R7, 'm')} AS f FROM complete JOIN m USING (series_id))",
           """SELECT series_id, split, count(*) AS n, round(avg(abs(y - f)), 4) AS mae, round(sqrt(avg(pow(y - f, 2))), 4) AS rmse,
  round(1 - sum(pow(y - f, 2)) / (var_pop(y) * count(*)), 7) AS r2,
  round(1 - sum(pow(y - f, 2)) / (var_pop(y) * count(*)), 7) AS nse FROM p GROUP BY 1, 2"""),
)
def _(spark, sf_dir):
    scores = monthly_plan.next_month_rain(durable(daily_log(spark, sf_dir)))[0]
    return rounded(scores, {"mae": 4, "rmse": 4, "r2": 7, "nse": 7})


_ENDS = {"lower_50": 0.25, "upper_50": 0.75, "lower_95": 0.025, "upper_95": 0.975}
OUTLOOK = (
    GAMMA_ML + ", " + _quantiles_sql("(SELECT * FROM shapes WHERE month = 1)", _ENDS)
    + ", " + nonnegative_sql("history", FOUR, "inflow_next", "m") + """,
fitted AS (
  SELECT h.series_id, h.year, """ + value_sql(FOUR) + f""" AS predicted_inflow
  FROM history h JOIN m USING (series_id) WHERE h.month = 1 AND {_WHOLE}
  QUALIFY row_number() OVER (PARTITION BY h.series_id ORDER BY h.year DESC) <= 12),
spread AS (
  SELECT series_id, avg(rainfall) AS mean, stddev_samp(rainfall) AS sigma FROM history
  WHERE month = 1 AND rainfall > 0 GROUP BY 1),
reach AS (
  SELECT series_id, mean, """ + ", ".join(f"max(mean / shape * z) FILTER (name = '{n}') AS {n}" for n in _ENDS) + """
  FROM found GROUP BY 1, 2)"""
)
_OUTLOOK_DIGITS = {"predicted_inflow": 0, "mean": 4, "low_1s": 4, "high_1s": 4, "low_2s": 4, "high_2s": 4,
                   "down_50": 3, "down_95": 3, "up_50": 3, "up_95": 3}


@query(
    "month_outlook",
    select(OUTLOOK, """SELECT f.series_id, f.year, round(predicted_inflow, 0) AS predicted_inflow, round(s.mean, 4) AS mean,
  round(s.mean - sigma, 4) AS low_1s, round(s.mean + sigma, 4) AS high_1s, round(s.mean - 2 * sigma, 4) AS low_2s,
  round(s.mean + 2 * sigma, 4) AS high_2s, round(r.mean - lower_50, 3) AS down_50, round(r.mean - lower_95, 3) AS down_95,
  round(upper_50 - r.mean, 3) AS up_50, round(upper_95 - r.mean, 3) AS up_95
FROM fitted f JOIN spread s ON f.series_id = s.series_id JOIN reach r ON f.series_id = r.series_id"""),
)
def _(spark, sf_dir):
    """Fitted January inflow of the latest years, beside the normal and gamma intervals of January's rain."""
    outlook = monthly_plan.month_outlook(durable(daily_log(spark, sf_dir)), 1, FOUR)
    both = outlook.fitted.join(outlook.normal.drop("month"), "series_id")
    return rounded(both.join(outlook.gamma.drop("month", "mean"), "series_id"), _OUTLOOK_DIGITS)


@query(
    "chart_split_series",
    select(FEATURES_SQL, f"SELECT series_id, date_day, inflow, inflow_30d_sum, {SPLIT} AS split FROM features"),
)
def _(spark, sf_dir):
    features = daily_plan.daily_features(daily_log(spark, sf_dir))
    split = evaluation.split_by_year(F.col("year"), TRAIN_END, VAL_END)
    return features.select("series_id", "date_day", "inflow", "inflow_30d_sum", split.alias("split"))
