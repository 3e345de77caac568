from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators import long_series
from freshet.operators.windows import (
    SeriesWindow, append_future_rows, latest_rows, training_sequences,
)

W = SeriesWindow()
START = date(2020, 1, 1)


def series(frame, values, name="a", gaps=1):
    rows = [(name, START + timedelta(days=i * gaps), v) for i, v in enumerate(values)]
    return frame(rows, "series_id string, date_day date, x double")


def values(df, column):
    return [r[0] for r in df.select("date_day", column).orderBy("date_day").select(column.alias("c")).collect()] \
        if not isinstance(column, str) else [r[column] for r in df.orderBy("date_day").collect()]


def run(df, **features):
    return df.select("series_id", "date_day", *[c.alias(n) for n, c in features.items()]).orderBy("date_day").toPandas()


@pytest.fixture
def random_series(frame):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 100, 120).astype(float)
    nulls = rng.random(120) < 0.1
    return series(frame, [None if n else float(v) for v, n in zip(x, nulls)]), pd.Series(np.where(nulls, np.nan, x))


@pytest.mark.parametrize("n", [1, 3, 7, 30])
def test_rolling_frames_match_pandas(random_series, n):
    df, x = random_series
    out = run(
        df, s=W.rolling_sum("x", n), m=W.rolling_mean("x", n), hi=W.rolling_max("x", n),
        ps=W.prior_sum("x", n), pm=W.prior_mean("x", n),
    )
    near = lambda got, want: pd.testing.assert_series_equal(got.astype(float), want, check_names=False)
    near(out.s, x.rolling(n, min_periods=1).sum())
    near(out.m, x.rolling(n, min_periods=1).mean())
    near(out.hi, x.rolling(n, min_periods=1).max())
    near(out.ps, x.shift(1).rolling(n, min_periods=1).sum())
    near(out.pm, x.shift(1).rolling(n, min_periods=1).mean())


def test_targets_match_pandas(random_series):
    df, x = random_series
    x = x.fillna(0)
    df = df.na.fill(0.0)
    out = run(df, t=W.forward_sum("x", 30), late=W.forward_sum("x", 30, warmup=False), s=W.shifted_sum("x", -28, 1))
    pd.testing.assert_series_equal(out.t, x.shift(-30).rolling(30, min_periods=30).sum(), check_names=False)
    pd.testing.assert_series_equal(out.s, x.shift(-1).rolling(30, min_periods=30).sum(), check_names=False)
    assert out.late.notna().sum() == 90 and out.late[0] == x[1:31].sum()


def test_frames_count_rows_unless_told_to_count_days(frame):
    df = series(frame, [1.0, 2.0, 4.0, 8.0], gaps=3)
    out = run(df, rows=W.rolling_sum("x", 3), days=W.rolling_sum("x", 4, calendar=True))
    assert list(out.rows) == [1, 3, 7, 14]
    assert list(out.days) == [1, 3, 6, 12]


def test_lags_leads_and_differences(frame):
    df = series(frame, [1.0, None, 4.0])
    out = run(df, d=W.difference("x"), n=W.lead("x"), l2=W.lag("x", 2))
    assert out.d.isna().all() and out.l2[2] == 1 and out.n[1] == 4
    assert len(W.lags_of(["a", "b"], range(1, 7))) == 12


def test_strict_sum_needs_every_term(frame):
    df = series(frame, [1.0, 2.0, None, 4.0, 8.0, 16.0])
    out = run(df, s=W.strict_sum("x", 3))
    assert list(out.s.isna()) == [True] * 5 + [False] and out.s[5] == 28


def test_series_do_not_mix(frame):
    df = series(frame, [1.0, 2.0]).unionAll(series(frame, [10.0, 20.0], "b"))
    got = {(r.series_id, r.date_day): r.s for r in df.select("*", W.rolling_sum("x", 5).alias("s")).collect()}
    assert got[("b", START + timedelta(days=1))] == 30 and got[("a", START + timedelta(days=1))] == 3


def test_sequences(frame):
    df = series(frame, [1.0, 2.0, None, 3.0, 4.0])
    got = training_sequences(df, "x", 2, W).orderBy("date_day").collect()
    assert [(r.inputs, r.target) for r in got] == [([1, 2], 3), ([2, 3], 4)]


def test_latest_and_future_rows(frame):
    df = series(frame, [1.0, 2.0, 3.0])
    assert sorted(r.x for r in latest_rows(df, W, 2).collect()) == [2, 3]
    clim = frame([("a", m, float(m)) for m in range(1, 13)], "series_id string, month int, rain double")
    longer = append_future_rows(clim, 3, "month", ["series_id"], ["rain"])
    w = SeriesWindow(order=["month"])
    rows = longer.select("month", "rain", w.lag("rain", 3).alias("l")).orderBy("month").collect()
    assert [(r.month, r.rain, r.l) for r in rows[-3:]] == [(13, None, 10), (14, None, 11), (15, None, 12)]


@pytest.mark.parametrize("chunk", [45, 64, 1000])
def test_chunked_windows_equal_plain_ones(spark, chunk):
    # one series holds most rows, and a series ends inside a chunk
    rng = np.random.default_rng(5)
    sizes = {"hot": 700, "warm": 90, "tiny": 1}
    rows = [(s, int(i), float(rng.integers(0, 50))) for s, n in sizes.items() for i in rng.permutation(n)]
    df = spark.createDataFrame(rows, "series_id string, t int, x double").repartition(5)
    features = lambda w: [
        w.rolling_sum("x", 45).alias("s"), w.lag("x", 30).alias("l"), w.prior_mean("x", 7).alias("m"),
        w.forward_sum("x", 30).alias("t30"),
    ]
    got = long_series.chunked_windows(df, features, ["series_id"], ["t"], back=44, ahead=30, chunk_rows=chunk)
    plain = SeriesWindow(["series_id"], ["t"])
    want = df.select("*", plain.position().cast("long").alias("position"), *features(plain))
    columns = want.columns
    assert sorted(got.select(columns).collect(), key=repr) == sorted(want.collect(), key=repr)


def test_row_numbers_past_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(long_series, "_BROADCAST_ROWS", 0)
    df = spark.range(1000).select(F.concat(F.lit("s"), F.col("id") % 3).alias("series_id"), F.col("id").alias("t"))
    got = long_series.number_rows(df, ["series_id"], ["t"]).collect()
    assert all(r.position == r.t // 3 + 1 for r in got) and len(got) == 1000
