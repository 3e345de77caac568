import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.functions import gamma
from freshet.operators import distributions as dist, quantiles, ranks

BY = ["series_id", "month"]


@pytest.fixture
def sample(frame):
    rng = np.random.default_rng(11)
    x = {1: rng.gamma(2.0, 3.0, 80), 2: rng.normal(50, 4, 200), 3: np.full(6, 7.0), 4: np.array([1.0, 2.0])}
    rows = [("a", m, float(v)) for m, values in x.items() for v in values] + [("a", 1, None)]
    return frame(rows, "series_id string, month int, x double"), x


def by_month(df):
    return {r.month: r for r in df.collect()}


def test_normal_bounds(sample):
    df, x = sample
    got = by_month(dist.normal_bounds(df, "x"))
    assert set(got) == {1, 2, 3}
    assert got[1].lower == pytest.approx(x[1].mean() - 2 * x[1].std(ddof=1))
    assert got[3].upper == 7


def test_normal_grid_spans_the_data(sample):
    df, x = sample
    rows = [r for r in dist.normal_grid(dist.normal_fit(df, "x"), points=300).collect() if r.month == 2]
    rows.sort(key=lambda r: r.i)
    assert len(rows) == 300 and rows[0].x == x[2].min() and rows[-1].x == pytest.approx(x[2].max())
    area = sum(r.density for r in rows) * (rows[1].x - rows[0].x)
    assert 0.9 < area < 1.01


def test_gamma_ml_fit_has_no_better_neighbour(sample):
    df, x = sample
    fit = by_month(dist.gamma_fit(df, "x"))
    r, v = fit[1], x[1]

    def loglik(k):
        t = v.mean() / k
        return np.sum((k - 1) * np.log(v) - v / t) - len(v) * (math.lgamma(k) + k * math.log(t))

    assert r.shape * r.scale == pytest.approx(v.mean())
    assert loglik(r.shape) > max(loglik(r.shape * 1.001), loglik(r.shape * 0.999))
    assert fit[3].shape is None  # equal values have no finite shape
    wide = by_month(dist.with_gamma_interval(dist.gamma_fit(df, "x"), 0.95, "_95"))[1]
    held = gamma.lower_gamma(np.array([r.shape] * 2), np.array([wide.lower_95, wide.upper_95]) / r.scale)
    assert held == pytest.approx([0.025, 0.975])


def test_gamma_moment_fit_keeps_the_moments(sample):
    df, x = sample
    r, v = by_month(dist.gamma_moment_fit(df, "x"))[1], x[1]
    skew = ((v - v.mean()) ** 3).mean() / v.std() ** 3
    assert r.loc + r.shape * r.scale == pytest.approx(v.mean())
    assert r.scale * math.sqrt(r.shape) == pytest.approx(v.std(ddof=1))
    assert 2 / math.sqrt(r.shape) == pytest.approx(skew)
    grid = [g for g in dist.gamma_grid(dist.gamma_moment_fit(df, "x"), points=2000).collect() if g.month == 1]
    grid.sort(key=lambda g: g.i)
    assert sum(g.density for g in grid) * (grid[1].x - grid[0].x) == pytest.approx(1, abs=0.05)


def test_kolmogorov_smirnov_against_brute_force(sample):
    df, x = sample
    fit = dist.gamma_fit(df, "x")
    r, params, v = by_month(dist.gamma_ks(df, fit, "x"))[1], by_month(fit)[1], np.sort(x[1])
    f = gamma.lower_gamma(np.full(len(v), params.shape), v / params.scale)
    i = np.arange(1, len(v) + 1)
    d = max(np.max(i / len(v) - f), np.max(f - (i - 1) / len(v)))
    t = math.sqrt(len(v)) * d
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))
    assert r.d == pytest.approx(d) and r.p_value == pytest.approx(p)


def test_jarque_bera(sample):
    df, x = sample
    got, v = by_month(dist.jarque_bera(df, "x")), x[2]
    z = (v - v.mean()) / v.std()
    jb = len(v) / 6 * ((z**3).mean() ** 2 + ((z**4).mean() - 3) ** 2 / 4)
    assert got[2].statistic == pytest.approx(jb) and got[2].p_value == pytest.approx(math.exp(-jb / 2))
    assert got[1].p_value < 0.01 < got[2].p_value


@pytest.mark.parametrize("bins", [15, "sqrt"])
def test_histogram_matches_numpy(sample, bins):
    df, x = sample
    rows = dist.histogram(df, "x", bins=bins).collect()
    for month, v in x.items():
        k = bins if bins == 15 else min(15, max(12, int(math.sqrt(len(v)))))
        counts, edges = np.histogram(v, bins=k)
        mine = sorted((r for r in rows if r.month == month), key=lambda r: r.bin)
        assert [r["count"] for r in mine] == counts.tolist()
        assert [r.center for r in mine] == pytest.approx((edges[:-1] + edges[1:]) / 2)
        assert sum(r.density * r.width for r in mine) == pytest.approx(1)


def test_quantiles_and_winsorizing(sample):
    df, x = sample
    table = quantiles.quantile_table(df, "x", [0.05, 0.975], [BY, ["series_id"]], BY)
    rows = {r.month: r for r in table.collect()}
    everything = np.concatenate(list(x.values()))
    assert rows[2].q05 == pytest.approx(np.quantile(x[2], 0.05))
    assert rows[None].q975 == pytest.approx(np.quantile(everything, 0.975))
    assert rows[None].n == len(everything) + 1  # sizes count rows with a null too
    clipped = [r.c for r in quantiles.winsorized(df, "x", 0.1, "c").collect() if r.c is not None]
    assert min(clipped) == pytest.approx(np.quantile(everything, 0.1))
    assert max(clipped) == pytest.approx(np.quantile(everything, 0.9))


def test_regression_residual(frame):
    df = frame([("a", 1.0, 3.0), ("a", 2.0, 5.0), ("a", 3.0, 9.0), ("a", None, 1.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0)],
               "series_id string, x double, y double")
    got = dist.regression_residual(df, "y", "x", "r").collect()
    slope, base = np.polyfit([1, 2, 3], [3, 5, 9], 1)
    assert {(r.series_id, r.x): r.r for r in got if r.r is not None} == {
        ("a", x): pytest.approx(y - base - slope * x) for x, y in ((1, 3), (2, 5), (3, 9))
    }  # b has too few pairs
    through = dist.regression_residual(df, "y", "x", "r", intercept=False).where("series_id = 'a' AND x = 1").first()
    assert through.r == pytest.approx(3 - (3 + 10 + 27) / 14)


def test_correlation_skips_pairs_with_a_null(frame):
    df = frame([("a", 1.0, 2.0, None), ("a", 2.0, 4.0, 1.0), ("a", 3.0, 6.0, 0.0), ("a", None, 100.0, 5.0)],
               "series_id string, x double, y double, z double")
    r = dist.correlation(df, {"xy": ("x", "y"), "xz": ("x", "z")}).first()
    assert r.xy == pytest.approx(1) and r.xz == pytest.approx(-1)


@pytest.mark.parametrize("broadcast_bytes", ["-1", "10m"])
def test_pooled_quantiles_are_exact(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(quantiles, "ACCURACY", 200)
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, broadcast_bytes)
    rng = np.random.default_rng(4)
    x = {
        "smooth": rng.normal(size=30_000),
        "tied": np.where(rng.random(20_000) < 0.6, 0.0, rng.integers(0, 5, 20_000).astype(float)),
        "outlier": np.append(rng.random(9_000), 1e12),
        "small": rng.random(7),
        None: np.array([3.0]),
    }
    rows = [(k, float(v)) for k, values in x.items() for v in values] + [("small", None), ("small", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(16)
    levels = [0.05, 0.5, 0.75, 0.975]
    got = {r.g: r for r in quantiles.pooled_quantiles(df, "x", levels, ["g"]).collect()}
    for k, values in x.items():
        assert got[k].n == len(values)
        mine = [got[k][quantiles.quantile_name(p)] for p in levels]
        assert mine == pytest.approx(np.quantile(values, levels).tolist()), k
    spark.conf.unset(key)


@pytest.mark.parametrize("shift", [-1.0, 0.5, 40.0])
def test_a_bracket_that_misses_is_widened(spark, shift):
    """Proposals that lie beside every wanted rank, in all but the last reach or in all of them."""
    values = np.random.default_rng(9).normal(size=5_000)
    df = spark.createDataFrame([("a", float(v)) for v in values], "g string, x double").repartition(8)
    levels = [0.25, 0.9]
    right = [float(np.quantile(values, min(max(p + s * 0.05, 0), 1))) for p in levels for s in (-1, 1)]
    wrong = [e + shift for e in right]
    for ends in (wrong + right, wrong * 2):
        proposals = spark.createDataFrame([("a", 5_000, 5_000, ends)], "g string, rows long, n long, ends array<double>")
        chosen = quantiles.proved_brackets(df, levels, ["g"], proposals).first().brackets
        for p, b in zip(levels, chosen):
            inside = int(((values >= b.low) & (values <= b.high)).sum())
            assert b.below == int((values < b.low).sum()) <= math.floor(p * 4_999) < b.below + inside
        got = quantiles.exact_quantiles(df, "x", levels, ["g"], proposals).first()
        assert got.q == pytest.approx(np.quantile(values, levels).tolist(), abs=1e-15)


def test_quantiles_of_odd_groups(frame):
    inf, nan = float("inf"), float("nan")
    rows = [("none", None), ("none", nan), ("ends", -inf), ("ends", inf), ("ends", 1.0), ("zero", 0.0), ("zero", -0.0), (None, 4.0)]
    got = {r.g: r for r in quantiles.exact_quantiles(frame(rows, "g string, x double"), "x", [0.0, 0.5, 1.0], ["g"]).collect()}
    assert (got["none"].rows, got["none"].n, got["none"].q) == (2, 0, None)
    assert got["ends"].q == [-inf, 1.0, inf] and got["zero"].q == [0.0, 0.0, 0.0] and got[None].q == [4.0, 4.0, 4.0]
    assert quantiles.exact_quantiles(frame([], "g string, x double"), "x", [0.5], ["g"]).collect() == []


def test_one_group_is_ranked_in_many_tasks(spark):
    """A group that holds nearly all rows, with ties, spread over the parts of a range exchange."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # this table is small, a large one is not coalesced
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        df = spark.range(200_000).selectExpr(
            "if(id % 1000 = 0, 'few', 'many') AS g", "cast(pmod(hash(id), 50000) as double) AS x"
        )
        ranked = ranks.cumulated(ranks.value_counts(df, "x", ["g"]), ["g"])
        assert ranked.where("g = 'many'").select("part").distinct().count() >= 4
        got = {(r.g, r.x): (r.before, r.c) for r in ranked.collect()}
        plain = df.toPandas()
        for g, own in plain.groupby("g"):
            values, counts = np.unique(own["x"], return_counts=True)
            before_each = np.cumsum(counts) - counts
            assert [got[g, v] for v in values] == list(zip(before_each.tolist(), counts.tolist()))
        tiled = ranks.tiles(df.withColumn("i", F.monotonically_increasing_id()), 7, ["x", "i"], ["g"])
        sizes = {(r.g, r.tile): r.n for r in tiled.groupBy("g", "tile").agg(F.count("*").alias("n")).collect()}
        n = len(plain[plain.g == "many"])
        assert [sizes["many", t] for t in range(1, 8)] == [n // 7 + (t <= n % 7) for t in range(1, 8)]
    finally:
        spark.conf.set(key, before)


def test_ks_with_ties_equals_its_definition_row_by_row(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.gamma(2.0, 3.0, 3_000), 1) + 0.1
    df = spark.createDataFrame([("a", 1, float(v)) for v in x], "series_id string, month int, x double")
    fit = dist.gamma_fit(df, "x")
    got = dist.gamma_ks(df, fit, "x").first()
    shape, scale = (float(v) for v in fit.select("shape", "scale").first())
    rows = np.sort(x)
    steps = spark.createDataFrame([(float(v), shape, 0.0, scale) for v in rows], "x double, shape double, loc double, scale double")
    cdf = np.array([r.f for r in steps.select(gamma.gamma_cdf(F.col("x"), F.col("shape"), F.col("loc"), F.col("scale")).alias("f")).collect()])
    i = np.arange(1, len(rows) + 1)
    assert got.n == len(x) and got.d == pytest.approx(max((i / len(rows) - cdf).max(), (cdf - (i - 1) / len(rows)).max()), abs=1e-12)


def test_no_group_vanishes_without_a_free_location(frame):
    """A left-skewed month, one of three values, one of one value and a skewed one all keep a row."""
    months = {1: [9.0, 9.5, 10.0, 10.2, 10.3, 4.0], 2: [3.0, 4.0, 5.0], 3: [2.0], 4: [1.0, 1.2, 1.4, 2.0, 6.0]}
    df = frame([("a", m, x) for m, v in months.items() for x in v], "series_id string, month int, x double")
    fit = dist.gamma_moment_fit(df, "x")
    rows = by_month(fit)
    assert [rows[m].fit for m in months] == ["location_0", "location_0", "none", "moments"]
    assert rows[1]["loc"] == 0 and rows[1].shape * rows[1].scale == pytest.approx(np.mean(months[1]))
    ks = by_month(dist.gamma_ks(df, fit, "x"))
    assert [ks[m].n for m in months] == [6, 3, 1, 5] and ks[3].d is None and 0 < ks[2].d < 1
    ends = by_month(dist.with_gamma_interval(fit, 0.95, "", min_rows=5))
    assert ends[1].lower < ends[1].upper and ends[2].lower is None and ends[3].upper is None
    assert {g.month for g in dist.gamma_grid(fit, points=10).collect()} == set(months)
