"""Grain changes, unpivots, projections and source alignment."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.constants import (
    BUILD_LABELS,
    ENSEMBLE_METHODS,
    FAMILY_PREFIX_LABELS,
    FRAMEWORKS,
    MODEL_TYPES_BY_FAMILY,
    TRANSFORM_LABELS,
)
from hindcast.functions.calendar import available_at, month_floor, period_end, shift_months
from hindcast.functions.scalar import finite_or_null, row_max, title_label, to_number

MONTH_HEADER = r"\d{1,2}/\d{4}"


def require_columns(df: DataFrame, required: list[str], name: str = "input") -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{name} is missing required columns: {missing}")
    return df


def weekly_to_monthly(weekly: DataFrame, keys: list[str], value: str, prefix: str) -> DataFrame:
    """Mean, sample deviation (0 for a single observation) and size per month (A1)."""
    return (
        weekly.withColumn("date", month_floor("date")).groupBy(*keys, "date")
        .agg(
            F.avg(value).alias(f"{prefix}_avg"),
            F.when(F.count(F.lit(1)) > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0))).alias(f"{prefix}_std"),
            F.count(F.lit(1)).alias("weekly_obs_count"),
        )
    )


def month_headers(df: DataFrame) -> list[str]:
    """Columns whose header is a month such as 7/2004."""
    return [c for c in df.columns if re.fullmatch(MONTH_HEADER, c)]


def wide_to_long(df: DataFrame, ids: list[str], value: str) -> DataFrame:
    """Month-header columns to rows (P5); the header becomes the month, the cell a number."""
    headers = month_headers(df)
    if not headers:
        raise ValueError("no month columns found")
    cells = df.select(*ids, *[F.col(f"`{h}`").cast("string").alias(h) for h in headers])
    long = cells.unpivot(ids, [f"`{h}`" for h in headers], "month", "_cell")
    first_day = F.to_date(F.concat(F.lit("1/"), "month"), "d/M/yyyy")
    return long.select(*ids, first_day.alias("date"), to_number("_cell").alias(value))


def filter_trimmed_equal(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows whose text columns equal the wanted values once trimmed."""
    require_columns(df, list(wanted))
    return df.where(reduce(lambda a, b: a & b, [F.trim(F.col(c).cast("string")) == v for c, v in wanted.items()]))


def exactly_one(df: DataFrame) -> DataFrame:
    """Fail unless the frame has exactly one row; reads at most two rows."""
    found = len(df.take(2))
    if found != 1:
        raise ValueError(f"expected exactly one row, found {'none' if not found else 'several'}")
    return df


def promote_header(df: DataFrame, index: str, date_code: str, series_code: str, value: str) -> DataFrame:
    """Row 0 carries series codes and data starts at row 2 (P6); ``index`` is the sheet row number."""
    columns = [c for c in df.columns if c != index]
    header = df.where(F.col(index) == 0).select(*columns).first()
    if header is None:
        raise ValueError("the sheet has no code row")
    by_code = {str(header[c]): c for c in columns}
    missing = [code for code in (date_code, series_code) if code not in by_code]
    if missing:
        raise ValueError(f"series codes not found: {missing}")
    return df.where(F.col(index) >= 2).select(
        F.col(by_code[date_code]).try_cast("date").alias("date"), to_number(by_code[series_code]).alias(value)
    )


def keep_present(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add missing columns with a default; a (value, type) pair fixes the type."""
    missing = {}
    for name, default in defaults.items():
        if name not in df.columns:
            value, kind = default if isinstance(default, tuple) else (default, None)
            missing[name] = F.lit(value) if kind is None else F.lit(value).cast(kind)
    return df.withColumns(missing) if missing else df


def stamp_source(df: DataFrame, series_id: str, source_name: str, days: int = 7) -> DataFrame:
    """Period end, availability date and source labels."""
    return df.withColumns(
        {
            "period_end": period_end("date"),
            "available_at": available_at("date", days),
            "series_id": F.lit(series_id),
            "source_name": F.lit(source_name),
        }
    )


def prefix_source_columns(df: DataFrame, source: str) -> DataFrame:
    """Rename the per-source bookkeeping columns so that joined sources do not collide."""
    shared = ["available_at", "series_id", "source_name"]
    return df.withColumnsRenamed({c: f"{source}_{c}" for c in shared if c in df.columns})


def integrate(base: DataFrame, sources: dict[str, DataFrame], on: list[str], base_name: str) -> DataFrame:
    """Left-join monthly sources onto the base months; ``data_available_at`` is the latest of all.

    Sources are monthly and small next to raw data, but no size is assumed: the join strategy is left
    to the optimizer and its measured sizes.
    """
    joined = prefix_source_columns(base, base_name)
    for name, source in sources.items():
        side = prefix_source_columns(source, name)
        joined = joined.join(side.drop("period_end"), on, "left")
    stamps = [f"{n}_available_at" for n in [base_name, *sources] if f"{n}_available_at" in joined.columns]
    return joined.withColumn("data_available_at", row_max(stamps))


def align_inner(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Months that every metric has."""
    return reduce(lambda left, right: left.join(right, on, "inner"), frames)


def align_outer(long: DataFrame, on: list[str], series: str, value: str, names: list[str]) -> DataFrame:
    """Full outer alignment of named series (J3) as one aggregation over the long form."""
    return long.groupBy(*on).pivot(series, names).agg(F.first(value, ignorenulls=True))


def target_by_date(df: DataFrame, keys: list[str], target: str, horizon: int) -> DataFrame:
    """Target ``horizon`` months ahead by date lookup; safe when months are missing."""
    ahead = df.select(*keys, shift_months("date", -horizon).alias("date"), F.col(target).alias(f"{target}_target_h{horizon}"))
    return df.join(ahead, [*keys, "date"], "left")


def drop_incomplete(df: DataFrame, required: list[str]) -> DataFrame:
    return df.dropna(subset=required)


def clean_infinities(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite_or_null(c) for c in columns})


def rows_with_gaps(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where any of the columns is NULL."""
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def month_dummies(month: Column, prefix: str = "month") -> dict[str, Column]:
    """Indicator columns for months 2..12; January is the reference level (V5)."""
    return {f"{prefix}_{m}": (month == m).cast("double") for m in range(2, 13)}


def pivot_years(df: DataFrame, ids: list[str], year: str, years: list[int], value: str) -> DataFrame:
    """Chosen years side by side with difference and percent change of the last against the first (V3)."""
    wide = df.groupBy(*ids).pivot(year, years).agg(F.first(value, ignorenulls=True))
    first, last = F.col(f"`{years[0]}`"), F.col(f"`{years[-1]}`")
    return wide.select(
        *ids,
        *[F.col(f"`{y}`").alias(f"year_{y}") for y in years],
        (last - first).alias("difference"),
        (F.try_divide(last - first, first) * 100).alias("pct_change"),
    )


# --- taxonomy (P16) --------------------------------------------------------------------------------


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair]), key)


def model_family(model_type: str = "model_type") -> Column:
    families = {t: family for family, types in MODEL_TYPES_BY_FAMILY.items() for t in types}
    return F.coalesce(_lookup(families, F.col(model_type)), F.lit("other"))


def model_build(model_type: str = "model_type") -> Column:
    return F.when(F.col(model_type) == "naive", F.lit("seasonal_naive")).otherwise(F.col(model_type))


def ensemble_method(model_type: str = "model_type") -> Column:
    return F.coalesce(_lookup(ENSEMBLE_METHODS, F.col(model_type)), F.lit(""))


def framework(model_type: str = "model_type") -> Column:
    names = {t: name for name, types in FRAMEWORKS.items() for t in types}
    return F.coalesce(_lookup(names, F.col(model_type)), F.lit(""))


def build_label(family: str = "model_family", build: str = "model_build") -> Column:
    prefix = F.coalesce(_lookup(FAMILY_PREFIX_LABELS, F.col(family)), title_label(family))
    name = F.coalesce(_lookup(BUILD_LABELS, F.col(build)), title_label(build))
    return F.concat(prefix, F.lit(": "), name)


def with_taxonomy(df: DataFrame) -> DataFrame:
    """Fill the model taxonomy and its labels; columns that exist already are kept."""
    derived = {"model_family": model_family(), "model_build": model_build(), "ensemble_method": ensemble_method()}
    out = df.withColumns({n: c for n, c in derived.items() if n not in df.columns})
    if "model_config_id" not in out.columns and "config_id" in out.columns:
        out = out.withColumn("model_config_id", F.col("config_id"))
    known = F.col("feature_transform") if "feature_transform" in out.columns else F.lit(None).cast("string")
    return out.withColumn("feature_transform", F.coalesce(known, F.lit("identity"))).withColumns(
        {
            "feature_transform_label": F.coalesce(
                _lookup(TRANSFORM_LABELS, F.col("feature_transform")), title_label("feature_transform")
            ),
            "model_build_label": build_label(),
        }
    )
