from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import bands, evaluation as ev, quantiles


def test_year_split_is_inclusive_and_can_exclude(frame):
    df = frame([(y,) for y in (2017, 2018, 2019, 2021, 2022)], "y int")
    got = [r[0] for r in df.select(ev.split_by_year(F.col("y"), 2018, 2021)).collect()]
    assert got == ["train", "train", "val", "val", "test"]
    got = [r[0] for r in df.select(ev.split_by_year(F.col("y"), 2018, 2021, [2017])).collect()]
    assert got == [None, "train", "val", "val", "test"]


def test_hash_split_share_and_repeatability(spark):
    df = spark.range(10_000)
    split = lambda d, seed=42: {r.id: r.s for r in d.select("id", ev.hash_split(F.col("id"), seed).alias("s")).collect()}
    first = split(df)
    assert first == split(df.repartition(13)) and first != split(df, 7)
    assert 0.78 < sum(v == "train" for v in first.values()) / 10_000 < 0.82


def test_ordered_split(frame):
    df = frame([("a", i) for i in range(7)], "series_id string, t int")
    assert [r.split for r in ev.ordered_split(df, "t").orderBy("t").collect()] == ["train"] * 5 + ["test"] * 2


PRED = "series_id string, name string, split string, y_true double, y_pred double, flood double, event double"


def test_scores_by_hand(frame):
    y, p = np.array([1.0, 2, 3, 10]), np.array([2.0, 2, 5, 6])
    df = frame([("a", "m", "val", float(a), float(b), 9.0, 3.0) for a, b in zip(y, p)], PRED)
    r = ev.score(df, ["series_id", "name", "split"], flood="flood", event="event").first()
    e = y - p
    assert r.mae == np.abs(e).mean() and r.rmse == pytest.approx(np.sqrt((e**2).mean()))
    assert r.r2 == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum()) == pytest.approx(r.nse)
    assert (r.flood_n, r.flood_mae, r.flood_rmse, r.flood_threshold) == (1, 4, 4, 9)
    assert (r.event_n, r.event_recall, r.event_precision) == (2, 1, 1)


def test_scores_without_spread_floods_or_events(frame):
    df = frame([("a", "m", "val", 5.0, 4.0, 9.0, 9.0)] * 2 + [("a", "m", "val", None, 4.0, 9.0, 9.0)], PRED)
    r = ev.score(df, ["name"], flood="flood", event="event").first()
    assert r.n == 2 and r.nse is None and r.r2 == 0 and r.flood_n == 0
    assert r.flood_mae is None and r.event_recall is None and r.event_precision is None
    exact = ev.score(frame([("a", "m", "val", 5.0, 5.0, 9.0, 9.0)], PRED), ["name"]).first()
    assert exact.r2 == 1 and exact.nse is None


SCORES = "series_id string, name string, split string, mae double, rmse double, flood_mae double"


def test_best_model_rules(frame):
    rows = [("a", "x", "val", 1.0, 1.0, 9.0), ("a", "y", "val", 2.0, 2.0, 3.0), ("a", "z", "train", 0.0, 0.0, 0.0)]
    best = lambda rs, **k: ev.best_model(frame(rs, SCORES), **k).first().name
    assert best(rows) == "y"
    assert best([(*r[:5], None) for r in rows]) == "x"
    assert best([(*r[:5], None) if r[1] == "x" else r for r in rows]) == "y"
    assert best(rows, force="x") == "x"
    with pytest.raises(Exception, match="was not trained"):
        best(rows, force="q")


def test_cadence_groups_share_rows(frame):
    days = [date(2020, 1, 31) + timedelta(days=i) for i in range(3)]
    df = frame([("a", d, 1.0, 2.0) for d in days], "series_id string, date_day date, y_true double, y_pred double")
    got = {r.cadence: r.n for r in ev.cadence_scores(df, 1).collect()}
    assert got == {"daily_all": 3, "monthly_day1": 1}
    assert ev.issue_day_rows(df, 1).count() == 1


def test_stack_and_widen(frame):
    df = frame([("a", 1, 5.0, 6.0, 7.0)], "series_id string, t int, y_true double, p double, q double")
    long = ev.stack_predictions(df, {"m1": "p", "m2": "q"}, ["series_id", "t", "y_true"])
    wide = ev.widen_predictions(long, {"m1": "y_m1", "m2": "y_m2"}, ["series_id", "t"]).first()
    assert (wide.y_true, wide.y_m1, wide.y_m2) == (5, 6, 7)


def test_thresholds_weights_outliers_trend(frame):
    rows = [("a", "train", float(i), float(2 * i + 1)) for i in range(11)] + [("a", "test", 99.0, 500.0)]
    df = frame(rows, "series_id string, split string, y double, p double")
    df = quantiles.train_quantiles(df, "y", {"flood": 0.9, "event": 0.75})
    weighted = df.withColumn("w", ev.tail_weight(F.col("y"), F.col("event"), F.col("flood")))
    got = {r.y: r.w for r in weighted.collect()}
    assert df.first().flood == 9 and df.first().event == 7.5
    assert (got[7.0], got[8.0], got[9.0], got[99.0]) == (1, 1.8, 3, 3)
    flags = {r.y: r.outlier for r in ev.outlier_flags(df, "y", "p").collect()}
    assert flags[99.0] and not flags[10.0]
    line = ev.trend_line(df.where("split = 'train'"), "y", "p").first()
    assert (line.slope, line.intercept) == (pytest.approx(2), pytest.approx(1))


# residual bands


def expected_bands(residuals):
    """The same bands in numpy from {month: residuals}."""
    season = lambda m: {12: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 2, 7: 2, 8: 2}.get(m, 3)
    every = np.concatenate([np.asarray(v, float) for v in residuals.values()])
    lo, hi = np.quantile(every, [0.01, 0.99])
    clip = {m: np.clip(v, lo, hi) for m, v in residuals.items()}
    out = {}
    for m, v in clip.items():
        mates = np.concatenate([clip[k] for k in clip if season(k) == season(m)])
        wm = min(1, len(v) / 30) if len(v) >= 10 else 0
        ws = 1 - wm if len(mates) >= 20 else 0
        row = []
        for q in (0.05, 0.95, 0.25, 0.75):
            if wm + ws > 0:
                row.append((wm * np.quantile(v, q) + ws * np.quantile(mates, q)) / (wm + ws))
            else:
                row.append(np.quantile(np.concatenate(list(clip.values())), q))
        out[m] = row
    return out, [np.quantile(np.concatenate(list(clip.values())), q) for q in (0.05, 0.95, 0.25, 0.75)]


def test_bands_follow_every_sample_size_rule(frame):
    rng = np.random.default_rng(2)
    # spring: a full month, a part month, a tiny one; summer: one part month without season support; autumn: too few
    sizes = {3: 40, 4: 15, 5: 4, 7: 12, 10: 5}
    residuals = {m: rng.normal(m, 5, n) for m, n in sizes.items()}
    df = frame([("a", m, float(v)) for m, vs in residuals.items() for v in vs], "series_id string, month int, r double")
    table = bands.residual_bands(df, "r")
    months, overall = expected_bands(residuals)
    got = {r.month: [r.lo90, r.hi90, r.lo50, r.hi50] for r in table.collect()}
    assert set(got) == set(sizes) | {None}
    for m, want in months.items():
        assert got[m] == pytest.approx(want), m
    assert got[None] == pytest.approx(overall)
    for lo90, hi90, lo50, hi50 in got.values():
        assert lo90 <= lo50 <= hi50 <= hi90

    predictions = frame([("a", 3, 100.0), ("a", 1, 100.0)], "series_id string, month int, y_pred double")
    rows = {r.month: r for r in bands.with_intervals(predictions, table).collect()}
    assert rows[3].y_lo90 == pytest.approx(100 + months[3][0])
    assert rows[1].y_hi50 == pytest.approx(100 + overall[3])  # a month without residuals


def test_bands_are_kept_per_series(frame):
    rows = [("a", 1, float(i)) for i in range(40)] + [("b", 1, float(1000 + i)) for i in range(40)]
    got = {(r.series_id, r.month): r for r in bands.residual_bands(frame(rows, "series_id string, month int, r double"), "r").collect()}
    assert got[("a", 1)].hi90 < 41 and got[("b", None)].lo90 > 1000
