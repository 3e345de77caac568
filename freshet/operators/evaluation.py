"""Splits, thresholds, scores and model choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.operators.groups import with_facts
from freshet.operators.long_series import number_rows


def split_by_year(year: Column, train_end: int, val_end: int, exclude: list[int] = ()) -> Column:
    """train / val / test by year, ends inclusive; excluded years are left out of train (null)."""
    train = F.when(year.isin(list(exclude)), F.lit(None)).otherwise("train") if exclude else F.lit("train")
    return F.when(year <= train_end, train).when(year <= val_end, "val").when(year > val_end, "test")


def hash_split(key: Column, seed: int = 42, train_percent: int = 80) -> Column:
    """Repeatable random split: a row's side depends on its key and the seed only, not on row order."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < train_percent, "train").otherwise("test")


def ordered_split(df: DataFrame, order: str, share: float = 0.8, series: list[str] = ("series_id",)) -> DataFrame:
    """First ``share`` of every series by order is train, the rest test. Rows are numbered by a range exchange."""
    numbered = with_facts(number_rows(df, list(series), [order]), [F.count(F.lit(1)).alias("_n")], list(series))
    split = F.when(F.col("position") <= F.floor(F.col("_n") * F.lit(share)), "train").otherwise("test")
    return numbered.select(*df.columns, split.alias("split"))


def tail_weight(value: Column, event: Column, flood: Column, event_weight: float = 1.8, flood_weight: float = 3.0):
    return F.when(value >= flood, flood_weight).when(value >= event, event_weight).otherwise(1.0)


def accuracy(y: str, yhat: str) -> list[Column]:
    """MAE, RMSE, R2 and NSE. NSE is null and R2 is 1 or 0 when the actual values do not vary."""
    err = F.col(y) - F.col(yhat)
    sse = F.sum(err * err)
    spread = F.var_pop(y) * F.count(y)
    ratio = 1 - sse / spread
    return [
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.when(spread > 0, ratio).when(sse == 0, 1.0).otherwise(0.0).alias("r2"),
        F.when(spread > 0, ratio).alias("nse"),
    ]


def flood_scores(y: str, yhat: str, flood: str) -> list[Column]:
    """Errors on the rows whose actual value reaches the flood threshold; null when there are none."""
    err = F.when(F.col(y) >= F.col(flood), F.col(y) - F.col(yhat))
    return [
        F.max(flood).alias("flood_threshold"),
        F.count(err).alias("flood_n"),
        F.avg(F.abs(err)).alias("flood_mae"),
        F.sqrt(F.avg(err * err)).alias("flood_rmse"),
    ]


def event_scores(y: str, yhat: str, event: str) -> list[Column]:
    """Recall and precision of exceeding the event threshold; null on a zero denominator."""
    actual, predicted = F.col(y) >= F.col(event), F.col(yhat) >= F.col(event)
    hit = F.count_if(actual & predicted)
    return [
        F.max(event).alias("event_threshold"),
        F.count_if(actual).alias("event_n"),
        F.try_divide(hit, F.count_if(actual)).alias("event_recall"),
        F.try_divide(hit, F.count_if(predicted)).alias("event_precision"),
    ]


def score(
    predictions: DataFrame,
    by: list[str],
    y: str = "y_true",
    yhat: str = "y_pred",
    flood: str | None = None,
    event: str | None = None,
    mse: bool = False,
) -> DataFrame:
    """All scores per group in one aggregation; rows lacking either value do not count."""
    measures = accuracy(y, yhat)
    if mse:
        err = F.col(y) - F.col(yhat)
        measures.append(F.avg(err * err).alias("mse"))
    if flood:
        measures += flood_scores(y, yhat, flood)
    if event:
        measures += event_scores(y, yhat, event)
    return predictions.na.drop(subset=[y, yhat]).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *measures)


def coverage(df: DataFrame, by: list[str], y: str = "y_true", names: tuple[str, ...] = ("90", "50"), prefix: str = "y_") -> DataFrame:
    """How many rows of a group lie in their intervals: n and the share ``covered_90`` with y_lo90 <= y <= y_hi90.

    Rows lacking the value or an end do not count.
    """
    ends = [f"{prefix}{side}{n}" for n in names for side in ("lo", "hi")]
    inside = lambda n: F.col(y).between(F.col(f"{prefix}lo{n}"), F.col(f"{prefix}hi{n}")).cast("double")
    known = df.na.drop(subset=[y, *ends])
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(inside(n)).alias(f"covered_{n}") for n in names])


def stack_predictions(df: DataFrame, models: dict[str, str], keep: list[str]) -> DataFrame:
    """Prediction columns side by side -> one row per model, in one pass over the table."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("y_pred")) for n, c in models.items()])
    return df.select(*keep, F.explode(pairs).alias("m")).select(*keep, "m.name", "m.y_pred")


def widen_predictions(df: DataFrame, names: dict[str, str], by: list[str], y: str = "y_true") -> DataFrame:
    """One row per date with a column for every model."""
    cells = [F.max(F.when(F.col("name") == n, F.col("y_pred"))).alias(c) for n, c in names.items()]
    return df.groupBy(*by).agg(F.max(y).alias(y), *cells)


def best_model(scores: DataFrame, metric: str = "flood_mae", split: str = "val", force: str | None = None) -> DataFrame:
    """Name of the best model per series on the validation rows.

    Ranked by the metric, then MAE and RMSE; MAE decides where no model has the metric. ``force`` names the winner
    instead and fails when it was not trained.
    """
    rows = scores.where(F.col("split") == split)
    if force is not None:
        found = rows.groupBy("series_id").agg(F.max(F.when(F.col("name") == force, F.col("name"))).alias("name"))
        wrong = F.raise_error(F.lit(f"model {force} was not trained")).cast("string")
        return found.select("series_id", F.coalesce("name", wrong).alias("name"))
    rank = Window.partitionBy("series_id").orderBy(
        F.col(metric).asc_nulls_last(), F.col("mae").asc_nulls_last(), F.col("rmse").asc_nulls_last(), "name"
    )
    return rows.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").select("series_id", "name")


def cadence_scores(predictions: DataFrame, issue_day: int, date: str = "date_day", **score_args) -> DataFrame:
    """Scores of all days next to those of one issue day per month."""
    monthly = f"monthly_day{issue_day}"
    label = F.when(F.dayofmonth(date) == issue_day, F.array(F.lit("daily_all"), F.lit(monthly)))
    tagged = predictions.withColumn("cadence", F.explode(F.coalesce(label, F.array(F.lit("daily_all")))))
    return score(tagged, ["series_id", "cadence"], **score_args)


def issue_day_rows(df: DataFrame, issue_day: int = 1, date: str = "date_day") -> DataFrame:
    return df.where(F.dayofmonth(date) == issue_day)


def outlier_flags(df: DataFrame, y: str, yhat: str, by: list[str] = ("series_id",), sigmas: float = 2.0) -> DataFrame:
    """Mark rows whose residual exceeds ``sigmas`` population standard deviations of the group's residuals."""
    resid = F.col(y) - F.col(yhat)
    spread = with_facts(df, [F.stddev_pop(resid).alias("_spread")], list(by))
    return spread.withColumn("outlier", F.abs(resid) > F.lit(sigmas) * F.col("_spread")).drop("_spread")


def trend_line(df: DataFrame, y: str, yhat: str, by: list[str] = ("series_id",)) -> DataFrame:
    """Line of predicted on actual values."""
    return df.groupBy(*by).agg(
        F.regr_slope(yhat, y).alias("slope"), F.regr_intercept(yhat, y).alias("intercept")
    )
