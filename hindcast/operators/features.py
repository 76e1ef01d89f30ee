"""Lag, rolling, seasonal, regime and horizon features.

Every function returns column expressions or adds them in one projection, so all windows of a series
share one exchange and one sort.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hindcast.functions.calendar import (
    cycle_cos,
    cycle_sin,
    month_number,
    month_sequence,
    months_apart,
    shift_months,
)
from hindcast.functions.scalar import finite_or_zero, signed_log1p
from hindcast.operators.panel import series_frame, series_window


@dataclass(frozen=True)
class LagSpec:
    """Which history columns to derive for a group of measures."""

    columns: list[str]
    lags: list[int] = field(default_factory=list)
    rolling: list[int] = field(default_factory=list)
    diffs: list[int] = field(default_factory=list)
    yoy_diff: bool = True
    yoy_pct: bool = False
    rolling_std: bool = True


# Default recipes by role of the measure.
TARGET_LAGS = {"lags": [*range(1, 13), 18, 24], "rolling": [3, 6], "diffs": [1, 2, 3]}
SERVICE_LAGS = {"lags": [1, 3, 6, 12], "rolling": [3, 6], "diffs": [1, 3], "rolling_std": False}
EXOGENOUS_LAGS = {"lags": [1, 2, 3, 6, 12], "rolling": [3], "diffs": [1, 3], "rolling_std": False}


def past_rolling(measure: str, w: WindowSpec, size: int, how: str) -> Column:
    """Statistic of the ``size`` rows before this one; NULL unless all of them have a value."""
    frame = w.rowsBetween(-size, -1)
    statistic = {"mean": F.avg, "std": F.stddev_samp}[how](measure)
    return F.when(F.count(measure).over(frame) == size, statistic.over(frame))


def lag_columns(spec: LagSpec, w: WindowSpec) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for c in spec.columns:
        def past(k: int, c: str = c) -> Column:
            return F.lag(c, k).over(w)

        out |= {f"{c}_lag{k}": past(k) for k in spec.lags}
        out |= {f"{c}_diff_lag{k}": past(k) - past(k + 1) for k in spec.diffs}
        for size in spec.rolling:
            out[f"{c}_rollmean_{size}"] = past_rolling(c, w, size, "mean")
            if spec.rolling_std:
                out[f"{c}_rollstd_{size}"] = past_rolling(c, w, size, "std")
        if spec.yoy_diff:
            out[f"{c}_yoy_diff"] = past(1) - past(13)
        if spec.yoy_pct:
            out[f"{c}_yoy_pct"] = F.try_divide(past(1) - past(13), past(13))
    return out


def change_columns(measures: list[str], w: WindowSpec) -> dict[str, Column]:
    """Month-over-month and year-over-year differences and fractions (W18); 0 in the base gives NULL."""
    out = {}
    for c in measures:
        for name, k in (("mom", 1), ("yoy", 12)):
            before = F.lag(c, k).over(w)
            out[f"{c}_{name}_diff"] = F.col(c) - before
            out[f"{c}_{name}_pct"] = F.try_divide(F.col(c) - before, before)
    return out


def index_to_first(measure: str, keys: list[str]) -> Column:
    """Series scaled so that its first observed value is 100."""
    frame = series_window(keys).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return F.try_divide(F.col(measure), F.first(measure, ignorenulls=True).over(frame)) * 100


def horizon_columns(target: str, horizon: int, w: WindowSpec) -> dict[str, Column]:
    """Target ``horizon`` months ahead with its date and cyclical month."""
    date = shift_months("date", horizon)
    month = F.month(date)
    return {
        f"{target}_target_h{horizon}": F.lead(target, horizon).over(w),
        f"target_date_h{horizon}": date,
        f"target_month_num_h{horizon}": month,
        f"target_month_sin_h{horizon}": cycle_sin(month),
        f"target_month_cos_h{horizon}": cycle_cos(month),
    }


def calendar_columns(w: WindowSpec) -> dict[str, Column]:
    month = F.month("date")
    return {
        "time_index_months": F.row_number().over(w) - 1,
        "month_num": month,
        "month_sin": cycle_sin(month),
        "month_cos": cycle_cos(month),
    }


def regime_columns(start: str, post_start: str, names: tuple[str, str, str, str]) -> dict[str, Column]:
    """Event flags (W10): (observed, active, post, months since), for an event known from ``start``."""
    begin, after = F.lit(start).cast("date"), F.lit(post_start).cast("date")
    observed, active, post, since = names
    seen = F.col("date") >= begin
    return {
        observed: seen.cast("int"),
        active: (seen & (F.col("date") < after)).cast("int"),
        post: (F.col("date") >= after).cast("int"),
        since: F.when(seen, months_apart(begin, "date")).otherwise(0),
    }


DEFAULT_REGIME = {
    "start": "2020-03-01",
    "post_start": "2021-03-01",
    "names": (
        "pandemic_observed", "pandemic_disruption_active", "post_pandemic_observed", "months_since_pandemic_observed",
    ),
}
# Older names of three of the regime columns.
REGIME_ALIASES = {
    "is_covid_disruption": "pandemic_disruption_active",
    "is_post_covid": "post_pandemic_observed",
    "months_since_covid_impact": "months_since_pandemic_observed",
}


def interaction_columns(available: list[str], bases: list[str], flags: list[str]) -> dict[str, Column]:
    """Product of each base feature with each flag, where both exist."""
    present = set(available)
    return {
        f"{b}_x_{f}": F.col(b) * F.col(f) for b in bases if b in present for f in flags if f in present
    }


def product_columns(available: list[str], products: dict[str, tuple[str, str]]) -> dict[str, Column]:
    """Named products of two columns, where both exist."""
    present = set(available)
    return {n: F.col(a) * F.col(b) for n, (a, b) in products.items() if {a, b} <= present}


def ratio_columns(available: list[str], ratios: dict[str, tuple[str, str]]) -> dict[str, Column]:
    present = set(available)
    return {n: F.try_divide(F.col(a), F.col(b)) for n, (a, b) in ratios.items() if {a, b} <= present}


def seasonal_naive(target_column: str, w: WindowSpec, periods: int = 12) -> Column:
    """The target column one season earlier."""
    return F.lag(target_column, periods).over(w)


def build_features(
    panel: DataFrame,
    keys: list[str],
    target: str,
    horizon: int = 3,
    service: list[str] | None = None,
    exogenous: list[str] | None = None,
    regime: dict | None = None,
    interaction_bases: list[str] | None = None,
    products: dict[str, tuple[str, str]] | None = None,
    ratios: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """The wide feature table: calendar and regime, lags, interactions, then the target.

    Order matters: interactions need the lags, and trimming and imputation come before this call.
    """
    w = series_window(keys)
    regime = DEFAULT_REGIME if regime is None else regime
    specs = [LagSpec([target], **TARGET_LAGS)]
    if service:
        specs.append(LagSpec(service, **SERVICE_LAGS))
    if exogenous:
        specs.append(LagSpec(exogenous, **EXOGENOUS_LAGS))
    base = {**calendar_columns(w), **regime_columns(**regime)}
    for spec in specs:
        base |= lag_columns(spec, w)
    out = panel.withColumns(base | horizon_columns(target, horizon, w))
    if regime is DEFAULT_REGIME:
        out = out.withColumns({alias: F.col(source) for alias, source in REGIME_ALIASES.items()})
    flags = list(regime["names"][1:3])
    layer = interaction_columns(out.columns, interaction_bases or [], flags)
    layer |= product_columns(out.columns, products or {})
    layer |= ratio_columns(out.columns, ratios or {})
    return out.withColumns(layer) if layer else out


# --- transforms (X12) ------------------------------------------------------------------------------

TRANSFORM_PARTS = {
    "identity": [],
    "log_signed": ["log_signed"],
    "quadratic": ["pow2"],
    "cubic": ["pow2", "pow3"],
    "log_signed_quadratic_cubic": ["log_signed", "pow2", "pow3"],
}


def transformed_names(columns: list[str], transform: str) -> list[str]:
    if transform not in TRANSFORM_PARTS:
        raise ValueError(f"unsupported feature transform: {transform}")
    return [*columns, *[f"{c}__{part}" for part in TRANSFORM_PARTS[transform] for c in columns]]


def transform_features(df: DataFrame, columns: list[str], transform: str) -> DataFrame:
    """Append signed-log and power columns; non-finite and missing values become 0."""
    names = transformed_names(columns, transform)
    make = {
        "log_signed": signed_log1p,
        "pow2": lambda c: F.pow(F.col(c), F.lit(2.0)),
        "pow3": lambda c: F.pow(F.col(c), F.lit(3.0)),
    }
    raw = {c: F.col(c).cast("double") for c in columns}
    for part in TRANSFORM_PARTS[transform]:
        raw |= {f"{c}__{part}": make[part](c) for c in columns}
    return df.withColumns({n: finite_or_zero(raw[n]) for n in names})


# --- annual context (W23, W24) ---------------------------------------------------------------------


def project_annual(annual: DataFrame, keys: list[str], value: str, last_year: int) -> DataFrame:
    """Extend an annual series to ``last_year`` by the mean of its last five yearly steps."""
    newest_first = (W.partitionBy(*keys) if keys else W.partitionBy()).orderBy(F.col("year").desc())
    by_year = (W.partitionBy(*keys) if keys else W.partitionBy()).orderBy("year")
    steps = annual.withColumns(
        {"_step": F.col(value) - F.lag(value).over(by_year), "_recency": F.row_number().over(newest_first)}
    )
    ends = steps.groupBy(*keys).agg(
        F.avg(F.when(F.col("_recency") <= 5, F.col("_step"))).alias("_step"),
        F.max("year").alias("_last"),
        F.max_by(value, "year").alias("_value"),
    )
    ahead = ends.where(F.col("_last") < last_year).select(
        *keys, "_step", "_last", "_value", F.explode(F.sequence(F.col("_last") + 1, F.lit(last_year))).alias("year")
    )
    projected = ahead.select(
        *keys,
        "year",
        (F.col("_value") + F.col("_step") * (F.col("year") - F.col("_last"))).alias(value),
        F.lit("projected_5yr_dollar_trend").alias("reference_method"),
    )
    observed = annual.select(*keys, "year", value, F.lit("observed").alias("reference_method"))
    return observed.unionByName(projected)


def prior_year_context(annual: DataFrame, keys: list[str], value: str, start: str, end: str) -> DataFrame:
    """Monthly rows carrying the previous year's level, twelfth and one- and two-year change."""
    w = (W.partitionBy(*keys) if keys else W.partitionBy()).orderBy("year")
    one, two = F.lag(value).over(w), F.lag(value, 2).over(w)
    level = F.col(value)
    yearly = annual.withColumns(
        {"_yoy": F.try_divide(level - one, one), "_two": F.try_divide(level - two, two)}
    )
    months = month_sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    # Each annual row serves the twelve months of the following year.
    served = F.filter(months, lambda m: F.year(m) == F.col("year") + 1)
    return yearly.select(*keys, "year", value, "reference_method", "_yoy", "_two", F.explode(served).alias("date")).select(
        *keys,
        "date",
        F.col("year").alias("reference_year"),
        "reference_method",
        F.col(value).alias(f"{value}_prior_year"),
        (F.col(value) / 12).alias(f"monthly_{value}_prior_year"),
        F.col("_yoy").alias(f"{value}_yoy_pct_prior_year"),
        F.col("_two").alias(f"{value}_2yr_pct_prior_year"),
    )


# --- sequences (W25) -------------------------------------------------------------------------------


def sequence_samples(df: DataFrame, keys: list[str], columns: list[str], length: int) -> DataFrame:
    """The last ``length`` months as an array, for rows whose window has no missing month."""
    w = series_window(keys)
    item = F.struct("date", F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))
    frame = w.rowsBetween(-(length - 1), 0)
    span = month_number("date") - month_number(F.lag("date", length - 1).over(w))
    return (
        df.withColumns({"sequence": F.collect_list(item).over(frame), "_span": span})
        .where(F.col("_span") == length - 1).drop("_span")
    )
