"""Linear models fitted from moments, one model per series.

A fit needs only the row count, the means and the covariances. Spark computes them in one aggregation with map-side
partials, so rows never meet in one place, and all series are fitted by the same job. What is left is a k x k
problem per series, solved in numpy on one summary row each.
"""

from __future__ import annotations

from itertools import combinations_with_replacement
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from freshet.functions.numeric import floor_at_zero, round_half_even
from freshet.operators.evaluation import hash_split, score
from freshet.operators.ranks import tiles

SERIES = ["series_id"]

_FIT = StructType(
    [
        StructField("intercept", DoubleType()),
        StructField("coefficients", ArrayType(DoubleType())),
        StructField("penalty", DoubleType()),
        StructField("slopes", ArrayType(DoubleType())),
    ]
)

#: share of its terms by which an optimality condition may be off for rounding
TOLERANCE = 1e-8


def moments(df: DataFrame, features: list[str], label: str, by: list[str] = SERIES) -> DataFrame:
    """Count, means and population covariances of features and label, over rows without a null among them."""
    columns = [*features, label]
    pairs = list(combinations_with_replacement(columns, 2))
    out = df.select(*by, *columns).na.drop(subset=columns).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in columns]).alias("means"),
        F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("covariances"),
    )
    return out


def _square(covariances, size: int) -> np.ndarray:
    c = np.zeros((size, size))
    c[np.triu_indices(size)] = np.asarray(covariances, dtype=float)
    return c + np.triu(c, 1).T


def _standardised(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature matrix and label vector in units of one standard deviation, and those deviations.

    Features may differ by many orders of magnitude, which a plain solve would mistake for rank deficiency. A constant
    feature keeps the unit 1 and ends up with coefficient 0.
    """
    scale = np.sqrt(np.diag(c)[:-1])
    scale = np.where(scale > 0, scale, 1.0)
    return c[:-1, :-1] / np.outer(scale, scale), c[:-1, -1] / scale, scale


def _least_squares(c):
    a, b, scale = _standardised(c)
    return np.linalg.lstsq(a, b, rcond=None)[0] / scale


def _ridge(c, n, penalty):
    a, b, scale = _standardised(c)
    return np.linalg.solve(a + np.diag(penalty / n / scale**2), b) / scale


def _non_negative(c):
    """Least squares over coefficients >= 0: free the most promising one, step back from any that turns negative."""
    a, b, scale = _standardised(c)
    x, free = np.zeros(len(b)), np.zeros(len(b), dtype=bool)
    tol = 1e-12 * max(1.0, np.abs(b).max())
    while True:
        slope = np.where(free, -np.inf, b - a @ x)
        if slope.max() <= tol:
            return x / scale
        free[slope.argmax()] = True
        while True:
            trial = np.zeros(len(b))
            trial[free] = np.linalg.lstsq(a[np.ix_(free, free)], b[free], rcond=None)[0]
            negative = free & (trial <= 0)
            if not negative.any():
                break
            step = x[negative] / (x[negative] - trial[negative])
            x = x + step.min() * (trial - x)
            out = np.flatnonzero(negative)[step == step.min()]
            free[out] = False
            x[out] = 0.0
        x = trial


def _lasso(c, penalty, start=None, sweeps=100_000, tol=1e-13):
    """Coordinate descent on half the mean squared error plus penalty times the absolute coefficients."""
    a, b, scale = _standardised(c)
    limit = penalty / scale
    x = np.zeros(len(b)) if start is None else start * scale
    stop = tol * max(np.sqrt(c[-1, -1]), 1e-300)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(b)):
            if a[j, j] <= 0:
                continue
            rest = b[j] - a[j] @ x + a[j, j] * x[j]
            new = np.sign(rest) * max(abs(rest) - limit[j], 0.0) / a[j, j]
            moved = max(moved, abs(new - x[j]))
            x[j] = new
        if moved <= stop:
            return _settled(a, b, limit, x) / scale
    raise ArithmeticError(f"lasso did not settle in {sweeps} sweeps at penalty {penalty}")


def _settled(a, b, limit, x) -> np.ndarray:
    """``x`` with its coefficients that are not 0 solved for at once, where they keep their signs."""
    on = x != 0
    if not on.any():
        return x
    exact = np.linalg.lstsq(a[np.ix_(on, on)], b[on] - limit[on] * np.sign(x[on]), rcond=None)[0]
    if (np.sign(exact) != np.sign(x[on])).any():
        return x
    out = x.copy()
    out[on] = exact
    return out


def slopes(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Covariance of each feature with the residual: how fast the error falls as its coefficient grows."""
    return c[:-1, -1] - c[:-1, :-1] @ x


def certify(method: str, c: np.ndarray, n: float, penalty: float, x: np.ndarray) -> np.ndarray:
    """The slopes at ``x``, after proving that no other coefficients are better.

    The error functions are convex, so these conditions are enough. Least squares: every slope is 0; ridge: it balances
    the penalty's pull; non-negative: no slope is above 0, and those of coefficients above 0 are 0; lasso: no slope exceeds
    the penalty in size, and those of coefficients other than 0 equal it, with their sign. Raises where one does not hold.
    """
    g = slopes(c, x)
    room = TOLERANCE * (np.abs(c[:-1, -1]) + np.abs(c[:-1, :-1]) @ np.abs(x) + np.sqrt(np.diag(c)[:-1] * c[-1, -1]))
    on = x != 0
    if method == "non_negative":
        off = np.maximum(g, 0) + np.where(on, np.abs(g), 0) + np.maximum(-x, 0) * np.diag(c)[:-1]
    elif method == "lasso":
        off = np.where(on, np.abs(g - penalty * np.sign(x)), np.maximum(np.abs(g) - penalty, 0))
        room = room + TOLERANCE * penalty
    elif method == "ridge":
        off = np.abs(g - penalty / n * x)
        room = room + TOLERANCE * penalty / n * np.abs(x)
    else:
        off = np.abs(g)
    if (off > room).any():
        raise ArithmeticError(f"{method} is not optimal: conditions are off by {off.tolist()}, allowed {room.tolist()}")
    return g


def _solve(method: str, c: np.ndarray, n: float, penalty: float) -> np.ndarray:
    if method == "least_squares":
        return _least_squares(c)
    if method == "non_negative":
        return _non_negative(c)
    if method == "ridge":
        return _ridge(c, n, penalty)
    if method == "lasso":
        return _lasso(c, penalty)
    raise ValueError(f"unknown method {method}")


def fit_linear(
    df: DataFrame,
    features: list[str],
    label: str,
    method: str = "least_squares",
    penalty: float = 1.0,
    by: list[str] = SERIES,
) -> DataFrame:
    """One model per series as (by, n, intercept, coefficients in feature order, penalty).

    ``method``: least_squares, non_negative (coefficients >= 0), ridge (penalty on the squared coefficients against
    the summed squared error) or lasso (penalty on the absolute coefficients against half the mean squared error).
    The intercept is never penalised. ``slopes`` holds each feature's covariance with the residual, by which every model
    is proved optimal before it is returned (``certify``).
    """
    size = len(features) + 1

    @F.pandas_udf(_FIT)
    def solve(n: pd.Series, means: pd.Series, covariances: pd.Series) -> pd.DataFrame:
        rows = []
        for count, mean, cov in zip(n, means, covariances):
            c = _square(cov, size)
            x = _solve(method, c, count, penalty)
            g = certify(method, c, count, penalty, x)
            rows.append((float(mean[-1] - np.dot(mean[:-1], x)), [float(v) for v in x], float(penalty), [float(v) for v in g]))
        return pd.DataFrame(rows, columns=["intercept", "coefficients", "penalty", "slopes"])

    return moments(df, features, label, by).select(*by, "n", solve("n", "means", "covariances").alias("m")).select(
        *by, "n", "m.*"
    )


def fit_lasso_cv(
    df: DataFrame,
    features: list[str],
    label: str,
    order: str,
    folds: int = 5,
    path: int = 100,
    path_ratio: float = 1e-3,
    by: list[str] = SERIES,
) -> DataFrame:
    """Lasso with the penalty chosen by cross-validation over contiguous folds in ``order``, a total order.

    Folds are cut at counted positions, so no task holds a series. Fold moments add up to those of every training
    complement, and held-out errors follow from moments too, so the table is read once however long the penalty path is.
    The chosen model is proved optimal (``certify``) and carries its slopes.
    """
    whole = df.select(*by, order, *features, label).na.drop(subset=[*features, label])
    per_fold = moments(tiles(whole, folds, [order], list(by), "_fold"), features, label, [*by, "_fold"])
    size = len(features) + 1
    schema = StructType([df.schema[c] for c in by] + list(_FIT.fields))

    def solve(fold_rows: pd.DataFrame) -> pd.DataFrame:
        parts = [
            (float(r.n), np.asarray(r.means, dtype=float), _square(r.covariances, size))
            for r in fold_rows.sort_values("_fold").itertuples()
        ]
        _, mean, c = _pooled(parts)
        top = np.abs(c[:-1, -1]).max()
        grid = np.geomspace(top, top * path_ratio, path)
        errors = np.zeros((len(parts), path))
        for i, (_, held_mean, held_c) in enumerate(parts):
            _, fit_mean, fit_c = _pooled(parts[:i] + parts[i + 1:])
            x = np.zeros(size - 1)
            for j, penalty in enumerate(grid):
                x = _lasso(fit_c, penalty, x)
                gap = held_mean - fit_mean
                offset = gap[-1] - gap[:-1] @ x
                errors[i, j] = held_c[-1, -1] - 2 * held_c[:-1, -1] @ x + x @ held_c[:-1, :-1] @ x + offset**2
        best = float(grid[errors.mean(axis=0).argmin()])
        x = _lasso(c, best)
        keys = {k: fold_rows[k].iloc[0] for k in by}
        g = certify("lasso", c, 1.0, best, x)
        out = {**keys, "intercept": float(mean[-1] - mean[:-1] @ x), "coefficients": x.tolist(), "penalty": best}
        return pd.DataFrame([out | {"slopes": g.tolist()}])

    return per_fold.groupBy(*by).applyInPandas(solve, schema)


def _pooled(parts):
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    c = sum(p[0] * (p[2] + np.outer(p[1] - mean, p[1] - mean)) for p in parts) / n
    return n, mean, c


def rolling_origin(
    df: DataFrame, features: list[str], label: str, levels: tuple[float, ...] = (0.9, 0.5), year: str = "year", by: list[str] = SERIES
) -> DataFrame:
    """Rows of each year but the first, predicted by the model fitted on all earlier years of the series.

    Adds ``cut`` (the last year fitted on), ``n_train``, ``y_pred`` and for each level the ends ``lo90``, ``hi90`` of the
    interval that normal residuals of that model would keep to. All models come from one aggregation: moments per year,
    merged year by year in one row per year and series. A cut needs two rows more than coefficients.
    """
    size, schema = len(features) + 1, StructType(
        [df.schema[c] for c in by] + [StructField("cut", LongType()), StructField("n_train", DoubleType()),
                                      StructField("intercept", DoubleType()), StructField("coefficients", ArrayType(DoubleType())),
                                      StructField("sigma", DoubleType())]
    )

    def cuts(years: pd.DataFrame) -> pd.DataFrame:
        rows, total = [], None
        for r in years.sort_values(year).itertuples():
            own = (float(r.n), np.asarray(r.means, dtype=float), _square(r.covariances, size))
            total = own if total is None else _pooled([total, own])
            n, mean, c = total
            if n < size + 2:
                continue
            x = _least_squares(c)
            g = certify("least_squares", c, n, 0.0, x)
            error = max(float(c[-1, -1] - x @ (c[:-1, -1] + g)), 0.0)  # mean squared residual
            keys = [getattr(r, k) for k in by]
            rows.append((*keys, int(getattr(r, year)), n, float(mean[-1] - mean[:-1] @ x), x.tolist(), float(np.sqrt(error * n / (n - size)))))
        return pd.DataFrame(rows, columns=schema.fieldNames())

    models = moments(df, features, label, [*by, year]).groupBy(*by).applyInPandas(cuts, schema)
    fit = models.select(*by, "cut", "n_train", F.col("intercept").alias("_b"), F.col("coefficients").alias("_w"), F.col("sigma").alias("_s"))
    rows = df.withColumn("cut", F.col(year).cast("long") - 1).join(fit, [*by, "cut"])
    value = linear_value(F.col("_b"), F.col("_w"), [F.col(c) for c in features])
    predicted = rows.withColumn("y_pred", value)
    ends = {}
    for level in levels:
        reach = F.lit(NormalDist().inv_cdf((1 + level) / 2)) * F.col("_s")
        ends |= {f"lo{round(100 * level)}": F.col("y_pred") - reach, f"hi{round(100 * level)}": F.col("y_pred") + reach}
    return predicted.withColumns(ends).select(*df.columns, "cut", "n_train", "y_pred", *ends)


def linear_value(intercept: Column, coefficients: Column, inputs: list[Column]) -> Column:
    """Intercept plus coefficients times inputs as built-in arithmetic; null when an input is missing."""
    value = intercept
    for i, x in enumerate(inputs):
        value = value + coefficients[i] * x
    return value


def predict_linear(df: DataFrame, model: DataFrame, features: list[str], name: str = "y_pred", by=SERIES) -> DataFrame:
    """Add the model's prediction as ``name``."""
    fit = model.select(*by, F.col("intercept").alias("_b"), F.col("coefficients").alias("_w"))
    value = linear_value(F.col("_b"), F.col("_w"), [F.col(c) for c in features])
    return df.join(fit, by, "left").withColumn(name, value).select(*df.columns, name)


def formula(features: list[str], label: str, digits: int = 3) -> Column:
    """Readable equation of a model row."""
    number = f"%.{digits}f"
    terms = [F.format_string(f" + ({number} * {c})", F.col("coefficients")[i]) for i, c in enumerate(features)]
    return F.concat(F.format_string(f"{label} = {number}", F.col("intercept")), *terms)


def fitted_by_year(
    df: DataFrame, features: list[str], label: str, month: int, method: str = "non_negative"
) -> DataFrame:
    """Prediction for one calendar month in every year."""
    model = fit_linear(df, features, label, method)
    rows = df.where(F.col("month") == month).na.drop(subset=features)
    return predict_linear(rows, model, features, "predicted_inflow").select("series_id", "year", "predicted_inflow")


def held_out_scores(df: DataFrame, features: list[str], label: str, key: str, method: str, seed: int = 42) -> DataFrame:
    """Errors (mse among them) of a model fitted on the four fifths of the rows that ``hash_split`` puts into train."""
    rows = df.na.drop(subset=[*features, label]).withColumn("split", hash_split(F.col(key), seed))
    model = fit_linear(rows.where("split = 'train'"), features, label, method)
    return score(predict_linear(rows, model, features), ["series_id", "split"], y=label, mse=True)


def simulated_by_year(df: DataFrame, features: list[str], label: str, month: int, rain: str, next_rain: str):
    """Next-month value for every year, with that year's own rain of the month standing in for next month's rain.

    Missing inputs are filled with the training mean. Columns: year, month, simulated_rain, predicted_inflow (clipped
    at 0, two digits).
    """
    train = df.na.drop(subset=[*features, label])
    model = fit_linear(train, features, label, "non_negative")
    filled = train.groupBy("series_id").agg(*[F.avg(c).alias(f"_mean_{c}") for c in features])
    rows = df.where(F.col("month") == month).withColumn(next_rain, floor_at_zero(F.col(rain)))
    rows = rows.join(filled, "series_id")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.col(f"_mean_{c}")) for c in features})
    predicted = predict_linear(rows, model, features, "_raw")
    return predicted.select(
        "series_id",
        "year",
        "month",
        F.col(next_rain).alias("simulated_rain"),
        round_half_even(floor_at_zero(F.col("_raw"))).alias("predicted_inflow"),
    )


def scenario_predictions(bounds: DataFrame, model: DataFrame, latest: DataFrame, features: list[str], rain: str):
    """Predictions with ``rain`` at the lower bound, the mean and the upper bound, other inputs from ``latest``.

    ``bounds`` and ``latest`` hold one row per series.
    """
    names = ["lower", "mean", "upper"]
    points = F.array(*[F.struct(F.lit(n).alias("scenario"), F.col(n).alias(rain)) for n in names])
    scenarios = bounds.select("series_id", F.explode(points).alias("s")).select("series_id", "s.*")
    rows = latest.drop(rain).join(scenarios, "series_id")
    predicted = predict_linear(rows, model, features, "predicted_inflow")
    return predicted.select("series_id", "scenario", rain, "predicted_inflow")
