"""Rolling as-of evaluation without snapshot copies.

A training snapshot is a prefix of a series. Counts and moments of every snapshot are running window
sums, so no row is copied once per as-of month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hindcast.constants import DEFAULT_PERIODS, SHOCK_PERIOD
from hindcast.functions.calendar import month_number, month_sequence, months_apart, shift_months
from hindcast.functions.ids import json_string_list, run_id
from hindcast.functions.scalar import absolute_percentage_error
from hindcast.operators.panel import series_frame, series_window


def evaluation_frame(
    features: DataFrame, keys: list[str], target_column: str, horizon: int,
    start: str, end: str | None = None, step: int = 1, seasonal_periods: int = 12,
) -> DataFrame:
    """As-of months that can be scored: target and seasonal baseline known, every ``step`` months."""
    if step < 1:
        raise ValueError("the as-of step must be at least one month")
    w = series_window(keys)
    out = features.withColumns(
        {
            "target_date": shift_months("date", horizon),
            "seasonal_naive_proxy": F.lag(target_column, seasonal_periods).over(w),
        }
    )
    first = F.lit(start).cast("date")
    keep = (F.col("date") >= first) & F.col(target_column).isNotNull() & F.col("seasonal_naive_proxy").isNotNull()
    if end is not None:
        keep &= F.col("date") <= F.lit(end).cast("date")
    if step > 1:
        keep &= F.pmod(months_apart(first, "date"), F.lit(step)) == 0
    return out.where(keep)


def period_label(date: str | Column, periods: list[tuple] | None = None) -> Column:
    """Name of the period a target month falls in; months outside all ranges get the first name (P10)."""
    periods = periods or DEFAULT_PERIODS
    c = F.col(date) if isinstance(date, str) else date
    label = F.lit(periods[0][0])
    for name, start, end in reversed(periods[1:]):
        inside = F.lit(True)
        if start is not None:
            inside &= c >= F.lit(start).cast("date")
        if end is not None:
            inside &= c <= F.lit(end).cast("date")
        label = F.when(inside, F.lit(name)).otherwise(label)
    return label


def is_shock(date: str | Column, periods: list[tuple] | None = None) -> Column:
    return period_label(date, periods) == SHOCK_PERIOD


def prefix_window(keys: list[str], embargo: int) -> object:
    """Months strictly before the as-of month, less the label embargo; by value, so gaps do not matter."""
    by_month = (W.partitionBy(*keys) if keys else W.partitionBy()).orderBy(month_number("date"))
    return by_month.rangeBetween(W.unboundedPreceding, -1 - embargo)


def training_rows(df: DataFrame, keys: list[str], required: list[str], embargo: int) -> DataFrame:
    """Usable training rows before each month (B5): ``n_train``.

    ``embargo`` drops the newest rows whose label lies in the future at the as-of month: 0 trusts every
    earlier row, horizon-1 treats the as-of month as known, horizon is strict.
    """
    usable = F.lit(True)
    for c in required:
        usable &= F.col(c).isNotNull()
    count = F.sum(usable.cast("int")).over(prefix_window(keys, embargo))
    return df.withColumn("n_train", F.coalesce(count, F.lit(0)))


def fit_date(as_of: Column, first: Column, refit_months: int, step: int) -> Column:
    """Month whose fit serves ``as_of`` (B6), for evenly spaced as-of months.

    A loop that refits once ``refit_months`` have passed can only act on evaluation months, so the
    effective spacing is the next multiple of ``step``.
    """
    spacing = -(-refit_months // step) * step
    return F.add_months(first, F.floor(F.try_divide(months_apart(first, as_of), F.lit(spacing))).cast("int") * spacing)


def refit_schedule(evaluated: DataFrame, keys: list[str], refit_months: int, step: int) -> DataFrame:
    first = F.min("date").over(series_frame(keys))
    fitted = fit_date(F.col("date"), first, refit_months, step)
    return evaluated.withColumns({"fit_date": fitted, "model_refit": fitted == F.col("date")})


def forward_months(evaluated: DataFrame, rows: DataFrame, keys: list[str], embargo: int, horizon: int) -> DataFrame:
    """Rows after the last training month up to the target month (J12), complete slices only.

    Each as-of month asks for a fixed number of months by date, so the range is an equality join.
    """
    wanted = evaluated.select(*keys, F.col("date").alias("as_of_date"), F.explode(
        month_sequence(shift_months("date", -embargo), shift_months("date", horizon))
    ).alias("date"))
    joined = wanted.join(rows, [*keys, "date"], "inner")
    whole = W.partitionBy(*keys, "as_of_date")
    return joined.withColumn("steps", F.count(F.lit(1)).over(whole)).where(F.col("steps") == embargo + horizon + 1)


def holdout(df: DataFrame, keys: list[str], last_rows: int) -> DataFrame:
    """Mark the last rows of each series as validation."""
    newest = (W.partitionBy(*keys) if keys else W.partitionBy()).orderBy(F.col("date").desc())
    return df.withColumn("split", F.when(F.row_number().over(newest) <= last_rows, "valid").otherwise("train"))


def date_split(date: str, test_start: str, valid_start: str | None = None) -> Column:
    """Train/valid/test label by date with an optional inner validation start."""
    c = F.col(date)
    inner = F.when(c >= F.lit(valid_start).cast("date"), "valid").otherwise("train") if valid_start else F.lit("train")
    return F.when(c >= F.lit(test_start).cast("date"), F.lit("test")).otherwise(inner)


def with_mode(prediction: Column, baseline: Column, mode: Column) -> Column:
    """A residual model predicts the distance to the seasonal baseline; add the baseline back."""
    return F.when(mode == "residual", baseline + prediction).otherwise(prediction)


def training_target(target: Column, baseline: Column, mode: str) -> Column:
    return target - baseline if mode == "residual" else target


def score_predictions(df: DataFrame, periods: list[tuple] | None = None) -> DataFrame:
    """Complete prediction rows (B17) from (config_id, as_of_date, target_date, actual, prediction,
    seasonal_naive_prediction, ...)."""
    error = F.col("prediction") - F.col("actual")
    naive_error = F.col("seasonal_naive_prediction") - F.col("actual")
    identity = run_id("config_id", "as_of_date")
    return df.withColumns(
        {
            "model_config_id": F.col("config_id"),
            "model_run_id": identity,
            "prediction_id": identity,
            "baseline_prediction": F.col("seasonal_naive_prediction"),
            "error": error,
            "abs_error": F.abs(error),
            "squared_error": error * error,
            "ape": absolute_percentage_error("actual", "prediction"),
            "naive_error": naive_error,
            "naive_abs_error": F.abs(naive_error),
            "evaluation_period": period_label("target_date", periods),
            "shock_period_flag": is_shock("target_date", periods),
        }
    )


def model_runs(predictions: DataFrame, params_json: Column, selected: Column, dropped: Column, policy_params: Column, refit_months: int) -> DataFrame:
    """Run rows with JSON metadata (B18) at the grain of the predictions; lists are array<string>."""
    return predictions.withColumns(
        {
            "params": params_json,
            "hyperparameters_json": params_json,
            "selected_feature_names_json": json_string_list(selected),
            "selected_base_feature_names_json": json_string_list(selected),
            "dropped_feature_names_json": json_string_list(dropped),
            "feature_policy_params_json": policy_params,
            "representation_policy": F.when(F.col("feature_transform") == "identity", "tabular_raw").otherwise(
                F.concat(F.lit("tabular_"), "feature_transform")
            ),
            "prediction_head": F.lit("direct_horizon"),
            "validation_strategy": F.lit("rolling_as_of"),
            "refit_frequency_months": F.lit(refit_months),
            "status": F.lit("succeeded"),
        }
    )


def pending(tasks: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Tasks without a finished result."""
    return tasks.join(done.select(*on).distinct(), on, "left_anti")
