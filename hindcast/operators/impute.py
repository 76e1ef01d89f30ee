"""Gap filling of monthly series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hindcast.operators.panel import series_frame, series_window

INTERPOLATED = "linear_interpolation_between_observed_months"
PROJECTED = "five_month_recent_trend_projection"
HISTORY = 5

# Weights of the one-step-ahead least-squares line through the last n values, oldest first.
STEP_WEIGHTS = {
    1: [1.0],
    2: [-1.0, 2.0],
    3: [-2.0 / 3.0, 1.0 / 3.0, 4.0 / 3.0],
    4: [-0.5, 0.0, 0.5, 1.0],
    5: [-0.4, -0.1, 0.2, 0.5, 0.8],
}


def interpolate_inside(value: str, keys: list[str], position: str) -> Column:
    """Straight line by row position between the neighbouring observed values; ends stay NULL."""
    w = series_window(keys)
    spot = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("at"), F.col(value).alias("v")))
    left = F.last(spot, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    right = F.first(spot, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    share = F.try_divide(F.col(position) - left["at"], right["at"] - left["at"])
    return F.coalesce(F.col(value), left["v"] + (right["v"] - left["v"]) * share)


def _next_value(history: Column) -> Column:
    """One step of the trend through the history, which holds at most five values."""

    def weighted(weights: list[float]) -> Column:
        w = F.array(*[F.lit(x) for x in weights])
        products = F.zip_with(history, w, lambda h, x: h * x)
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    step = F.lit(None).cast("double")
    for n, weights in STEP_WEIGHTS.items():
        step = F.when(F.size(history) == n, weighted(weights)).otherwise(step)
    return step


def project(history: Column, steps: Column) -> Column:
    """``steps`` recursive projections: each projected value enters the next fit."""

    def extend(values: Column, _: Column) -> Column:
        recent = F.slice(values, F.greatest(F.size(values) - HISTORY + 1, F.lit(1)), HISTORY)
        return F.concat(values, F.array(_next_value(recent)))

    grown = F.aggregate(F.sequence(F.lit(1), steps), history, extend)
    return F.when(steps > 0, F.slice(grown, F.size(history) + 1, F.greatest(steps, F.lit(1))))


def impute(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Interpolate interior gaps, project trailing ones, and flag what was filled.

    A gap at the start of a series is never filled, and it also blocks the trailing projection:
    filling stops at the first missing position that is followed by an observed value.
    """
    w, whole = series_window(keys), series_frame(keys)
    out = df.withColumn("_position", F.row_number().over(w))
    out = out.withColumns({f"_in_{c}": interpolate_inside(c, keys, "_position") for c in columns})
    ends: dict[str, Column] = {"_rows": F.count(F.lit(1)).over(whole)}
    for c in columns:
        filled = F.when(F.col(f"_in_{c}").isNotNull(), F.col("_position"))
        ends[f"_first_{c}"] = F.min(filled).over(whole)
        ends[f"_last_{c}"] = F.max(filled).over(whole)
    out = out.withColumns(ends)
    # Interpolated values have no holes, so the history is the last five positions up to the end.
    back = range(HISTORY - 1, -1, -1)
    tails = {
        f"_tail_{c}": F.array_compact(
            F.array(
                *[
                    F.max(F.when(F.col("_position") == F.col(f"_last_{c}") - k, F.col(f"_in_{c}"))).over(whole)
                    for k in back
                ]
            )
        )
        for c in columns
    }
    out = out.withColumns(tails)
    filled, flags = {}, {}
    for c in columns:
        history = F.col(f"_tail_{c}")
        gap = (F.col("_rows") - F.col(f"_last_{c}")).cast("int")
        trend = project(history, F.when(F.col(f"_first_{c}") == 1, gap).otherwise(F.lit(0)))
        offset = (F.col("_position") - F.col(f"_last_{c}")).cast("int")
        projected = F.when(offset > 0, F.get(trend, offset - 1))
        filled[f"_out_{c}"] = F.coalesce(F.col(f"_in_{c}"), projected)
        missing = F.col(c).isNull()
        flags[f"{c}_was_imputed"] = (missing & F.col(f"_out_{c}").isNotNull()).cast("int")
        flags[f"{c}_imputed_interpolated"] = (missing & F.col(f"_in_{c}").isNotNull()).cast("int")
        flags[f"{c}_imputed_trailing_trend"] = (
            missing & F.col(f"_in_{c}").isNull() & F.col(f"_out_{c}").isNotNull()
        ).cast("int")
    out = out.withColumns(filled).withColumns(flags)
    keep = [F.col(f"_out_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    return out.select(*keep, *flags)


def imputation_log(imputed: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per filled cell: (keys, date, column, method, imputed_value)."""
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(c).alias("imputed_value"),
                F.col(f"{c}_was_imputed").alias("was"),
                F.col(f"{c}_imputed_trailing_trend").alias("trend"),
            )
            for c in columns
        ]
    )
    method = F.when(F.col("cell.trend") == 1, F.lit(PROJECTED)).otherwise(F.lit(INTERPOLATED))
    return (
        imputed.select(*keys, "date", F.explode(cells).alias("cell")).where("cell.was = 1")
        .select(*keys, "date", "cell.column", method.alias("method"), "cell.imputed_value")
    )
