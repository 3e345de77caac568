"""Distribution fits, bounds, tests and histograms per series and group (usually the calendar month).

Values are one per series and month or day, so a group is bounded by the calendar; fits read only counts and
moments, which combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions import gamma as G
from freshet.functions.numeric import grid_point, normal_density
from freshet.operators.groups import join_groups, with_facts
from freshet.operators.ranks import cumulated, value_counts
from freshet.session import durable

BY_MONTH = ["series_id", "month"]


def normal_fit(df: DataFrame, value: str, by: list[str] = BY_MONTH) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sigma"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    )


def normal_bounds(df: DataFrame, value: str, by: list[str] = BY_MONTH, sigmas: float = 2, min_rows: int = 5):
    """Mean +- sigmas x standard deviation of every group with enough rows."""
    fit = normal_fit(df, value, by).where(F.col("n") >= min_rows)
    reach = F.lit(float(sigmas)) * F.col("sigma")
    return fit.select(
        *by, "n", "mean", "sigma", (F.col("mean") - reach).alias("lower"), (F.col("mean") + reach).alias("upper")
    )


def normal_grid(fit: DataFrame, by: list[str] = BY_MONTH, points: int = 100) -> DataFrame:
    """Fitted normal density at evenly spaced values between the group's extremes."""
    steps = fit.select(*by, "mean", "sigma", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = steps.withColumn("x", grid_point(F.col("low"), F.col("high"), F.col("i"), points))
    return x.select(*by, "i", "x", normal_density(F.col("x"), F.col("mean"), F.col("sigma")).alias("density"))


def gamma_fit(df: DataFrame, value: str, by: list[str] = BY_MONTH) -> DataFrame:
    """Maximum-likelihood gamma fit at location 0 on the positive values: shape, scale, mean."""
    positive = F.when(F.col(value) > 0, F.col(value))
    sums = df.groupBy(*by).agg(
        F.count(positive).alias("n"), F.avg(positive).alias("mean"), F.avg(F.log(positive)).alias("_mean_log")
    )
    shaped = sums.select(*by, "n", "mean", G.gamma_ml_shape(F.col("mean"), F.col("_mean_log")).alias("shape"))
    return shaped.select(
        *by, "n", "shape", F.lit(0.0).alias("loc"), F.try_divide(F.col("mean"), F.col("shape")).alias("scale"), "mean"
    )


def gamma_moment_fit(df: DataFrame, value: str, by: list[str] = BY_MONTH, min_skew: float = 0.01) -> DataFrame:
    """Three-parameter gamma fit from mean, standard deviation and skewness, one row for every group with values.

    It stands in for the maximum-likelihood fit with free location. A group whose skewness does not exceed
    ``min_skew`` has no such gamma and is fitted at location 0 from its mean and deviation; column ``fit`` names the
    kind: moments, location_0, or none for a group without spread or with a mean of 0 or less.
    """
    m = df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("_sigma"),
        F.skewness(value).alias("_skew"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    ).where(F.col("n") > 0)
    spread = F.coalesce(F.col("_sigma") > 0, F.lit(False))
    kind = (
        F.when(spread & F.coalesce(F.col("_skew") > min_skew, F.lit(False)), "moments")
        .when(spread & (F.col("mean") > 0), "location_0").otherwise("none")
    )
    free = F.col("fit") == "moments"
    ratio = F.col("mean") / F.col("_sigma")
    shape = F.when(free, 4 / (F.col("_skew") * F.col("_skew"))).when(F.col("fit") == "location_0", ratio * ratio)
    fit = m.withColumn("fit", kind).withColumn("shape", shape).withColumn("scale", F.col("_sigma") / F.sqrt("shape"))
    loc = F.when(free, F.col("mean") - F.col("shape") * F.col("scale")).when(F.col("fit") == "location_0", F.lit(0.0))
    return fit.select(
        *by, "n", "fit", "shape", loc.alias("loc"), "scale", "mean", F.col("_sigma").alias("sigma"), "low", "high"
    )


def with_gamma_interval(fit: DataFrame, level: float, name: str, min_rows: int = 0) -> DataFrame:
    """Add the central interval that holds ``level`` of the fitted distribution, null below ``min_rows`` rows."""
    tail = (1 - level) / 2
    enough = (F.col("n") >= min_rows) & F.col("shape").isNotNull()
    q = lambda p: F.when(enough, G.gamma_quantile(F.lit(p), F.col("shape"), F.col("loc"), F.col("scale")))
    return fit.withColumns({f"lower{name}": q(tail), f"upper{name}": q(1 - tail)})


def gamma_grid(fit: DataFrame, by: list[str] = BY_MONTH, points: int = 200, pad: bool = True) -> DataFrame:
    """Fitted gamma density at evenly spaced values, by default one sigma beyond the extremes but not below 0.

    A group without a fit has its values and null densities.
    """
    sigma = F.coalesce("sigma", F.lit(0.0))
    low = F.greatest(F.col("low") - sigma, F.lit(0.0)) if pad else F.col("low")
    high = F.col("high") + sigma if pad else F.col("high")
    fitted = fit.withColumn("_lg", F.when(F.col("shape").isNotNull(), G.gamma_log(F.col("shape"))))
    steps = fitted.select(
        *by, "shape", "loc", "scale", "_lg", low.alias("_low"), high.alias("_high"),
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"),
    )
    x = steps.withColumn("x", grid_point(F.col("_low"), F.col("_high"), F.col("i"), points))
    density = G.gamma_density(F.col("x"), F.col("shape"), F.col("loc"), F.col("scale"), F.col("_lg"))
    return x.select(*by, "i", "x", F.when(F.col("shape").isNotNull(), density).alias("density"))


def gamma_ks(df: DataFrame, fit: DataFrame, value: str, by: list[str] = BY_MONTH) -> DataFrame:
    """Kolmogorov-Smirnov distance of the values from their fitted gamma, with the asymptotic p-value.

    A group without a fit has its size and nulls. Values are ranked by a range exchange, so one group spreads over as
    many tasks as it needs; equal values are one row.
    """
    counts = cumulated(value_counts(df, value, by), by)
    sizes = durable(counts.groupBy(*by).agg(F.sum("c").alias("n")))
    scored = join_groups(join_groups(counts, sizes, by), durable(fit.select(*by, "shape", "loc", "scale")), by).withColumn(
        "_f", F.when(F.col("shape").isNotNull(), G.gamma_cdf(F.col("x"), F.col("shape"), F.col("loc"), F.col("scale")))
    )
    # of equal values, the last is highest above the fit and the first lowest below it
    gap = F.greatest((F.col("before") + F.col("c")) / F.col("n") - F.col("_f"), F.col("_f") - F.col("before") / F.col("n"))
    ks = scored.groupBy(*by).agg(F.max("n").alias("n"), F.max(gap).alias("d"))
    return ks.select(*by, "n", "d", kolmogorov_p(F.sqrt("n") * F.col("d")).alias("p_value"))


def kolmogorov_p(t: Column, terms: int = 100) -> Column:
    """Survival function of the Kolmogorov distribution; 1 below 0.2, where it differs from 1 by less than 1e-12."""
    k = F.sequence(F.lit(1), F.lit(terms))
    term = lambda i: F.when(i % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * i * i * t * t)
    total = F.aggregate(k, F.lit(0.0), lambda acc, i: acc + term(i))
    return F.when(t < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def jarque_bera(df: DataFrame, value: str, by: list[str] = BY_MONTH) -> DataFrame:
    """Normality test from skewness and excess kurtosis; p from the chi-squared law with two degrees of freedom."""
    m = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("excess_kurtosis")
    )
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("excess_kurtosis") * F.col("excess_kurtosis") / 4)
    return m.withColumn("statistic", jb).withColumn("p_value", F.exp(-F.col("statistic") / 2))


def histogram(df: DataFrame, value: str, by: list[str] = BY_MONTH, bins: int | str = 15) -> DataFrame:
    """Density histogram of every group over equal bins between its extremes, empty bins included.

    ``bins="sqrt"`` takes the root of the group size, kept between 12 and 15. A group of one repeated value gets the
    unit interval around it.
    """
    x = F.col(value)
    pad = F.when(F.min(x) == F.max(x), 0.5).otherwise(0.0)
    facts = [F.count(x).alias("n"), (F.min(x) - pad).alias("_low"), (F.max(x) + pad).alias("_high")]
    root = F.least(F.lit(15), F.greatest(F.lit(12), F.floor(F.sqrt("n")).cast("int")))
    k = root if bins == "sqrt" else F.lit(int(bins))
    known = df.where(x.isNotNull()).select(*by, value)
    placed = with_facts(known, facts, by).withColumnRenamed(value, "_x").withColumn("_k", k)
    span = F.col("_high") - F.col("_low")
    slot = F.least(F.floor((F.col("_x") - F.col("_low")) / span * F.col("_k")), F.col("_k") - 1).cast("int")
    head = [*by, "n", "_k", "_low", "_high"]
    counts = placed.groupBy(*head, slot.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
    filled = counts.groupBy(*head).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_c"))).alias("_counts"))
    per_bin = filled.select("*", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("bin"))
    width = (F.col("_high") - F.col("_low")) / F.col("_k")
    count = F.coalesce(F.try_element_at("_counts", F.col("bin")), F.lit(0))
    return per_bin.select(
        *by,
        "bin",
        (F.col("_low") + width * (F.col("bin") + 0.5)).alias("center"),
        width.alias("width"),
        count.cast("long").alias("count"),
        (count / (F.col("n") * width)).alias("density"),
    )


def regression_residual(
    df: DataFrame,
    y: str,
    x: str,
    name: str,
    series: list[str] = ("series_id",),
    fit: Column | None = None,
    intercept: bool = True,
    min_pairs: int = 3,
) -> DataFrame:
    """Add the residual of y regressed on x within the series, null where fewer than three pairs exist.

    ``fit`` restricts the rows that the line is fitted on, for instance to the training years.
    """
    used = F.col(x).isNotNull() & F.col(y).isNotNull()
    if fit is not None:
        used = used & fit
    yy, xx = F.when(used, F.col(y)), F.when(used, F.col(x))
    if intercept:
        slope, base = F.regr_slope(yy, xx), F.regr_intercept(yy, xx)
    else:
        slope, base = F.try_divide(F.sum(yy * xx), F.sum(xx * xx)), F.min(F.lit(0.0))
    fitted = with_facts(df, [slope.alias("_slope"), base.alias("_base"), F.count(yy).alias("_pairs")], list(series))
    residual = F.when(F.col("_pairs") >= min_pairs, F.col(y) - (F.col("_base") + F.col("_slope") * F.col(x)))
    return fitted.withColumn(name, residual).drop("_slope", "_base", "_pairs")


def correlation(df: DataFrame, pairs: dict[str, tuple[str, str]], by: list[str] = ("series_id",)) -> DataFrame:
    """Pearson correlation of column pairs; a row with a null in a pair does not count for that pair."""
    return df.groupBy(*by).agg(*[F.corr(a, b).alias(name) for name, (a, b) in pairs.items()])
