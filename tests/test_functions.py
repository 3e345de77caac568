import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.functions import calendar, gamma, numeric


def one(df, **columns):
    return df.select(*[c.alias(n) for n, c in columns.items()]).collect()


def test_month_number_from_code_number_and_junk(frame):
    df = frame([("JAN",), ("dec",), ("7",), (" Mar ",), ("x",), (None,)], "m string")
    assert [r.m for r in one(df, m=calendar.month_number(F.col("m")))] == [1, 12, 7, 3, None, None]
    ints = frame([(4,), (None,)], "m int")
    assert [r.m for r in one(ints, m=calendar.month_number(F.col("m")))] == [4, None]


def test_date_from_parts_rejects_impossible_days(frame):
    df = frame([(2024, 2, 29), (2023, 2, 29), (2023, 13, 1), (2023, None, 1)], "y int, m int, d int")
    got = [r.d for r in one(df, d=calendar.date_from_parts(F.col("y"), F.col("m"), F.col("d")))]
    assert got == [date(2024, 2, 29), None, None, None]


def test_parse_time_strict_and_lenient(frame):
    df = frame([("2024-03-01 05:00:00",), ("soon",)], "t string")
    got = [r.t for r in one(df, t=calendar.floor_to_day(calendar.parse_time(F.col("t"))))]
    assert got == [date(2024, 3, 1), None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(calendar.parse_time(F.col("t"), strict=True)).collect()


def test_seasons_cycles_and_labels(frame):
    df = frame([(m,) for m in range(1, 13)], "m int")
    rows = one(
        df, s=calendar.season(F.col("m")), n=calendar.next_month_number(F.col("m")),
        sin=calendar.cycle_sin(F.col("m"), 12), cos=calendar.cycle_cos(F.col("m"), 12),
    )
    assert [r.s for r in rows] == ["DJF"] * 2 + ["MAM"] * 3 + ["JJA"] * 3 + ["SON"] * 3 + ["DJF"]
    assert [r.n for r in rows] == [*range(2, 13), 1]
    assert all(math.isclose(r.sin**2 + r.cos**2, 1) for r in rows)
    assert math.isclose(rows[2].sin, 1)
    labels = frame([(1,), (12,), (13,), (15,)], "p int")
    got = [r.l for r in one(labels, l=calendar.climatology_row_label(F.col("p")))]
    assert got == ["January", "December", "Extra 1", "Extra 3"]


def test_numeric_helpers(frame):
    df = frame([("1.5",), ("NaN",), ("n/a",), (None,), ("-2",)], "t string")
    x = numeric.to_double(F.col("t"))
    assert [r.x for r in one(df, x=x)] == [1.5, None, None, None, -2.0]
    assert [r.x for r in one(df, x=numeric.floor_at_zero(x))] == [1.5, None, None, None, 0.0]
    assert [r.x for r in one(df, x=numeric.zero_if_null(x))] == [1.5, 0.0, 0.0, 0.0, -2.0]
    assert [r.x for r in one(df, x=numeric.at_least(x, 1.5))] == [1.0, None, None, None, 0.0]
    halves = frame([(0.125,), (0.375,)], "x double")
    assert [r.x for r in one(halves, x=numeric.round_half_even(F.col("x")))] == [0.12, 0.38]


def test_bands_at_their_edges(frame):
    df = frame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    loose = numeric.sigma_band(F.col("x"), F.lit(0.0), F.lit(1.0))
    strict = numeric.sigma_band(F.col("x"), F.lit(0.0), F.lit(1.0), strict=True)
    assert [r.b for r in one(df, b=loose)] == ["within_1", "within_2", "beyond_2", None]
    assert [r.b for r in one(df, b=strict)] == ["within_2", "beyond_2", "beyond_2", None]
    band = numeric.interval_band(F.col("x"), F.lit(1.0), F.lit(2.0))
    assert [r.b for r in one(df, b=band)] == ["inside", "inside", "outside", None]


def test_log_gamma_and_digamma():
    x = np.array([0.01, 0.5, 1.0, 2.5, 9.99, 10.0, 170.0, 5000.0])
    assert np.allclose(gamma.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-13)
    # digamma(1) is minus Euler's constant, and digamma(x + 1) = digamma(x) + 1/x
    assert math.isclose(gamma.digamma(np.array([1.0]))[0], -0.5772156649015329, rel_tol=1e-13)
    assert np.allclose(gamma.digamma(x + 1), gamma.digamma(x) + 1 / x, rtol=1e-12)


def test_lower_gamma_closed_forms():
    x = np.array([0.1, 1.0, 3.0, 20.0])
    assert np.allclose(gamma.lower_gamma(np.ones(4), x), 1 - np.exp(-x), atol=1e-14)
    assert np.allclose(gamma.lower_gamma(np.full(4, 0.5), x), [math.erf(math.sqrt(v)) for v in x], atol=1e-14)
    assert np.allclose(gamma.lower_gamma(np.full(4, 2.0), x), 1 - np.exp(-x) * (1 + x), atol=1e-13)
    assert gamma.lower_gamma(np.array([2.0]), np.array([-1.0]))[0] == 0


@pytest.mark.parametrize("p", [0.025, 0.25, 0.5, 0.75, 0.975])
def test_quantile_inverts_the_law(p):
    shape = np.array([0.3, 1.0, 7.0, 250.0, 9000.0])
    assert np.allclose(gamma.lower_gamma(shape, gamma.quantile(shape, np.full(5, p))), p, atol=1e-11)
    assert np.isnan(gamma.quantile(np.array([-1.0]), np.array([p])))[0]


def test_ml_shape_solves_its_equation():
    k = np.array([0.2, 1.0, 5.0, 400.0])
    assert np.allclose(gamma.shape_from_moments_of_log(np.log(k) - gamma.digamma(k)), k, rtol=1e-8)
    assert np.isnan(gamma.shape_from_moments_of_log(np.array([0.0])))[0]


def test_gamma_columns_keep_nulls(frame):
    df = frame([(2.0, 3.0), (None, 3.0), (2.0, None)], "a double, x double")
    cdf = gamma.gamma_cdf(F.col("x"), F.col("a"), F.lit(1.0), F.lit(2.0))
    got = [r.c for r in one(df, c=cdf)]
    assert math.isclose(got[0], 1 - math.exp(-1) * 2) and got[1:] == [None, None]
