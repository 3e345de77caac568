import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import linear
from freshet.plans.reports import simulation_report

NAMES = ["a", "b", "c"]


def make(frame, seed=0, n=60, scales=(1.0, 1e6, 1e-3), weights=(2.0, -3e-6, 500.0), name="s"):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * scales + np.array(scales) * 5
    y = x @ np.array(weights) + 7 + rng.normal(size=n)
    rows = [(name, i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return frame(rows, "series_id string, t int, a double, b double, c double, y double"), x, y


def fitted(df, method, penalty=1.0, features=NAMES):
    r = linear.fit_linear(df, features, "y", method, penalty).first()
    return r.intercept, np.array(r.coefficients)


def test_least_squares_over_many_magnitudes(frame):
    df, x, y = make(frame)
    want = np.linalg.lstsq(np.c_[np.ones(len(y)), x], y, rcond=None)[0]
    base, w = fitted(df, "least_squares")
    assert base == pytest.approx(want[0], rel=1e-6) and w == pytest.approx(want[1:], rel=1e-6)


def test_rows_with_nulls_do_not_count_and_series_are_separate(frame):
    one, x, y = make(frame, 1)
    two, x2, y2 = make(frame, 2, name="t")
    hole = one.limit(1).withColumn("y", F.lit(None).cast("double"))
    got = {r.series_id: r for r in linear.fit_linear(one.unionAll(two).unionAll(hole), NAMES, "y").collect()}
    for key, xs, ys in (("s", x, y), ("t", x2, y2)):
        want = np.linalg.lstsq(np.c_[np.ones(len(ys)), xs], ys, rcond=None)[0]
        assert got[key].n == 60 and got[key].coefficients == pytest.approx(want[1:], rel=1e-6)


def test_ridge_closed_form(frame):
    df, x, y = make(frame, 3, scales=(1, 2, 3), weights=(1, 2, 3))
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 10 * np.eye(3), xc.T @ yc)
    base, w = fitted(df, "ridge", 10.0)
    assert w == pytest.approx(want) and base == pytest.approx(y.mean() - x.mean(0) @ want)


@pytest.mark.parametrize("weights", [(2, -1, 3), (-1, -2, -3), (1, 2, 3), (-1, 5, -0.1)])
def test_non_negative_meets_its_optimality_conditions(frame, weights):
    df, x, y = make(frame, 4, scales=(1, 2, 3), weights=weights)
    base, w = fitted(df, "non_negative")
    xc, yc = x - x.mean(0), y - y.mean()
    slope = xc.T @ (yc - xc @ w) / len(y)
    assert (w >= 0).all() and (slope <= 1e-9).all() and np.abs(slope * w).max() < 1e-8


def test_non_negative_equals_the_best_of_all_subsets(frame):
    rng = np.random.default_rng(9)
    for trial in range(30):
        k = 5
        root = rng.normal(size=(k, k + 2))
        c = np.zeros((k + 1, k + 1))
        c[:k, :k] = root @ root.T
        c[:k, k] = c[k, :k] = rng.normal(size=k)
        w = linear._non_negative(c)
        loss = lambda v: v @ c[:k, :k] @ v - 2 * c[:k, k] @ v
        best = 0.0
        for mask in range(1, 2**k):
            on = [i for i in range(k) if mask >> i & 1]
            part = np.linalg.solve(c[np.ix_(on, on)], c[on, k])
            if (part >= 0).all():
                full = np.zeros(k)
                full[on] = part
                best = min(best, loss(full))
        assert (w >= 0).all() and loss(w) == pytest.approx(best, abs=1e-10)


def test_lasso_meets_its_optimality_conditions(frame):
    df, x, y = make(frame, 5, scales=(1, 2, 3), weights=(2, 0, 0.1))
    _, w = fitted(df, "lasso", 0.5)
    xc, yc = x - x.mean(0), y - y.mean()
    slope = xc.T @ (yc - xc @ w) / len(y)
    for g, v in zip(slope, w):
        assert abs(g) <= 0.5 + 1e-9 if v == 0 else g == pytest.approx(0.5 * np.sign(v), abs=1e-9)


def test_lasso_cv_equals_fitting_every_fold(frame):
    df, x, y = make(frame, 6, n=63, scales=(1, 2, 3), weights=(0.3, 0, 0.1))
    got = linear.fit_lasso_cv(df, NAMES, "y", "t").first()
    xc, yc = x - x.mean(0), y - y.mean()
    grid = np.geomspace(np.abs(xc.T @ yc / len(y)).max(), np.abs(xc.T @ yc / len(y)).max() * 1e-3, 100)
    errors = np.zeros((5, 100))
    for f, held in enumerate(np.array_split(np.arange(63), 5)):
        keep = np.setdiff1d(np.arange(63), held)
        mx, my = x[keep].mean(0), y[keep].mean()
        z = np.c_[x[keep] - mx, y[keep] - my]
        c = z.T @ z / len(keep)
        for j, penalty in enumerate(grid):
            w = linear._lasso(c, penalty)
            errors[f, j] = np.mean((y[held] - my - (x[held] - mx) @ w) ** 2)
    assert got.penalty == pytest.approx(grid[errors.mean(0).argmin()])


def test_constant_feature_gets_no_weight(frame):
    df, x, y = make(frame, 7)
    df = df.withColumn("a", F.lit(3.0))
    for method in ("least_squares", "ridge", "non_negative", "lasso"):
        assert fitted(df, method)[1][0] == 0


def test_prediction_and_formula(frame):
    df = frame([("s", 1.0, 2.0), ("s", None, 1.0)], "series_id string, a double, b double")
    model = frame([("s", 1.0, [2.0, -0.5])], "series_id string, intercept double, coefficients array<double>")
    assert sorted((r.y_pred for r in linear.predict_linear(df, model, ["a", "b"]).collect()), key=str) == [2.0, None]
    text = model.select(linear.formula(["a", "b"], "y")).first()[0]
    assert text == "y = 1.000 + (2.000 * a) + (-0.500 * b)"


def test_simulation_fills_missing_inputs_and_clips(frame):
    rows = [("s", 2000 + i, 1, float(i), float(i + 1), 10.0 * i) for i in range(5)] + [("s", 2010, 1, None, None, None)]
    df = frame(rows, "series_id string, year int, month int, rain double, rain_next double, y double")
    out = {r.year: r for r in linear.simulated_by_year(df, ["rain", "rain_next"], "y", 1, "rain", "rain_next").collect()}
    assert set(out) == {2000, 2001, 2002, 2003, 2004, 2010}
    assert all(r.predicted_inflow >= 0 for r in out.values()) and out[2003].simulated_rain == 3
    assert out[2010].predicted_inflow == pytest.approx(20, abs=0.01)  # both inputs at their means
    names = {"Year (used)", "Month used for rainfall", "Simulated rainfall__1", "Predicted inflow__1"}
    assert names <= set(simulation_report(linear.simulated_by_year(
        df, ["rain", "rain_next"], "y", 1, "rain", "rain_next")).columns)
    fitted = linear.fitted_by_year(df, ["rain", "rain_next"], "y", 1)
    assert {r.year: round(r.predicted_inflow, 6) for r in fitted.collect()} == {2000 + i: 10.0 * i for i in range(5)}


def test_scenarios(frame):
    bounds = frame([("s", 1.0, 2.0, 3.0)], "series_id string, lower double, mean double, upper double")
    model = frame([("s", 1.0, [10.0, 1.0])], "series_id string, intercept double, coefficients array<double>")
    latest = frame([("s", 99.0, 0.5)], "series_id string, rain double, evap double")
    out = linear.scenario_predictions(bounds, model, latest, ["rain", "evap"], "rain")
    assert {r.scenario: r.predicted_inflow for r in out.collect()} == {"lower": 11.5, "mean": 21.5, "upper": 31.5}
