"""Exploratory tables.

Series-level statistics run on monthly panels, where a series is bounded by the calendar, so plain
aggregates and windows are safe. Column profiles of raw tables use distributed exact quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hindcast.functions.calendar import month_floor
from hindcast.functions.scalar import correlation
from hindcast.operators.distribution import exact_quantiles, unpivot_numbers
from hindcast.operators.panel import series_window


def source_series(df: DataFrame, options: dict[str, str]) -> DataFrame:
    """The chosen source series with their labels, long by month."""
    present = {c: label for c, label in options.items() if c in df.columns}
    long = unpivot_numbers(df.withColumn("date", month_floor("date")).where(F.col("date").isNotNull()), ["date"], list(present))
    labels = F.create_map(*[F.lit(v) for pair in present.items() for v in pair])
    return long.withColumn("label", F.try_element_at(labels, F.col("variable")))


# --- coverage and profiles (A21-A23, A26, A27, A34) ------------------------------------------------


def column_coverage(df: DataFrame) -> DataFrame:
    """Type, non-null, missing and distinct counts per column (A21), in one pass plus a distinct count."""
    names = df.columns
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    long = text.unpivot([], names, "column_name", "v")
    counted = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    kinds = F.create_map(*[F.lit(v) for pair in types.items() for v in pair])
    present = F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0))
    return counted.groupBy("column_name").agg(
        present.alias("non_null"),
        (F.sum("n") - present).alias("nulls"),
        ((F.sum("n") - present) / F.sum("n") * 100).alias("null_pct"),
        F.count("v").alias("distinct_values"),
    ).withColumn("dtype", F.try_element_at(kinds, F.col("column_name")))


def sample_skew(value: str) -> Column:
    """Bias-corrected skewness; needs three values."""
    n = F.count(value).cast("double")
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


PROFILE_POINTS = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moments, missing share, skew and exact percentiles per column of a table of any size."""
    long = unpivot_numbers(df, [], columns)
    moments = long.groupBy("variable").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.max(F.abs("value")).alias("abs_max"),
        (F.avg(F.col("value").isNull().cast("double")) * 100).alias("missing_pct"),
        sample_skew("value").alias("skew"),
    )
    points = exact_quantiles(long, ["variable"], "value", list(PROFILE_POINTS.values()))
    wide = points.groupBy("variable").agg(
        *[F.max(F.when(F.abs(F.col("p") - p) < 1e-12, F.col("quantile"))).alias(name) for name, p in PROFILE_POINTS.items()]
    )
    return moments.join(wide, "variable", "left").withColumn("iqr", F.col("p75") - F.col("p25"))


def availability(df: DataFrame, columns: list[str]) -> DataFrame:
    """First and last observed month, observed and missing counts per series column."""
    long = unpivot_numbers(df, ["date"], columns)
    seen = F.col("value").isNotNull()
    return long.groupBy("variable").agg(
        F.min(F.when(seen, F.col("date"))).alias("first_available"),
        F.max(F.when(seen, F.col("date"))).alias("last_available"),
        F.count("value").alias("observed_months"),
        (F.count(F.lit(1)) - F.count("value")).alias("missing_months"),
        (F.avg((~seen).cast("double")) * 100).alias("missing_pct"),
    )


def imputation_activity(df: DataFrame, flags: list[str]) -> DataFrame:
    """Active rows and share per imputation flag."""
    return unpivot_numbers(df, [], flags).groupBy("variable").agg(
        F.sum(F.coalesce("value", F.lit(0.0))).cast("bigint").alias("active_rows"),
        (F.avg(F.coalesce("value", F.lit(0.0))) * 100).alias("active_pct"),
    )


def flag_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sum of binary flags, mean of other regime columns, with range."""
    long = unpivot_numbers(df, [], columns)
    binary = F.min(F.coalesce(F.col("value").isin(0.0, 1.0), F.lit(True)).cast("int")) == 1
    return long.groupBy("variable").agg(
        F.when(binary, F.sum("value")).otherwise(F.avg("value")).alias("active_rows_or_mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def artifact_summary(name: str, df: DataFrame, target: str | None = None) -> DataFrame:
    """Rows, columns, date bounds and missing targets of one table."""
    missing = F.sum(F.col(target).isNull().cast("bigint")) if target else F.lit(None).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), missing.alias("target_nulls")
    ).select(F.lit(name).alias("artifact"), "rows", F.lit(len(df.columns)).alias("columns"), "first_date", "last_date", "target_nulls")


# --- month-over-month by calendar month (A24, A25) -------------------------------------------------


def monthly_changes(df: DataFrame, keys: list[str], columns: list[str], until: str | None = None) -> DataFrame:
    """Percent change to the previous month, long by series; a zero base gives NULL."""
    w = series_window(keys)
    base = df if until is None else df.where(F.col("date") <= F.lit(until).cast("date"))
    changes = base.select(
        *keys, "date", *[(F.try_divide(F.col(c) - F.lag(c).over(w), F.lag(c).over(w)) * 100).alias(c) for c in columns]
    )
    return unpivot_numbers(changes, [*keys, "date"], columns)


def change_by_month(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, median and their difference per series and calendar month.

    Values per (series, month of year) are bounded by the number of years.
    """
    return changes.groupBy(*keys, "variable", F.month("date").alias("month_num")).agg(
        F.avg("value").alias("avg_mom_pct"),
        F.percentile("value", F.lit(0.5)).alias("median_mom_pct"),
        (F.avg("value") - F.percentile("value", F.lit(0.5))).alias("mean_minus_median"),
    )


def change_callouts(by_month: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Calendar months whose average change exceeds the threshold."""
    month = F.date_format(F.make_date(F.lit(2000), F.col("month_num"), F.lit(1)), "MMMM")
    return by_month.where(F.abs("avg_mom_pct") > threshold).withColumn("month", month)


def change_diagnostics(df: DataFrame, keys: list[str], columns: list[str], until: str) -> DataFrame:
    """Size of the base values and of the changes per series."""
    base = df.where(F.col("date") <= F.lit(until).cast("date"))
    prior = unpivot_numbers(
        base.select(*keys, "date", *[F.abs(F.lag(c).over(series_window(keys))).alias(c) for c in columns]), [*keys, "date"], columns
    ).withColumnRenamed("value", "prior")
    joined = prior.join(monthly_changes(base, keys, columns), [*keys, "date", "variable"])
    return joined.groupBy(*keys, "variable").agg(
        F.percentile("prior", F.lit(0.05)).alias("prior_abs_p05"),
        F.max(F.abs("value")).alias("max_abs_mom_pct"),
        F.avg(F.abs("value")).alias("mean_abs_mom_pct"),
        F.percentile(F.abs("value"), F.lit(0.5)).alias("median_abs_mom_pct"),
    )


def event_delta(df: DataFrame, keys: list[str], columns: list[str], until: str) -> DataFrame:
    """Average change per calendar month before an event against the full series."""
    full = change_by_month(monthly_changes(df, keys, columns), keys)
    before = change_by_month(monthly_changes(df, keys, columns, until), keys)
    on = [*keys, "variable", "month_num"]
    return before.select(*on, F.col("avg_mom_pct").alias("pre_event_avg")).join(
        full.select(*on, F.col("avg_mom_pct").alias("full_avg")), on
    ).withColumn("full_minus_pre", F.col("full_avg") - F.col("pre_event_avg"))


# --- correlations (E1-E4, E6, E7, J15) -------------------------------------------------------------


def _pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def pearson_pairs(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Pairwise-complete correlations above the diagonal as one aggregation.

    The number of pairs depends on the declared columns only; rows are combined map-side.
    """
    stats = df.groupBy(*keys).agg(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("a"),
                    F.lit(b).alias("b"),
                    correlation(a, b).alias("r"),
                    F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n"),
                )
                for a, b in _pairs(columns)
            ]
        ).alias("_pairs")
    )
    return stats.select(*keys, F.explode("_pairs").alias("p")).select(*keys, "p.a", "p.b", F.col("p.r").alias("pearson"), "p.n")


def average_rank(value: Column, partition: list[Column]) -> Column:
    """Rank with ties sharing their mean position."""
    ordered = W.partitionBy(*partition).orderBy(value)
    tied = W.partitionBy(*partition, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(tied) - 1) / 2


def spearman_pairs(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rank correlations on the rows complete for each pair (E2); series are bounded by the calendar."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")
            )
            for a, b in _pairs(columns)
        ]
    )
    long = df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*").where("x IS NOT NULL AND y IS NOT NULL")
    group = [F.col(c) for c in [*keys, "a", "b"]]
    ranks = long.withColumns({"rx": average_rank(F.col("x"), group), "ry": average_rank(F.col("y"), group)})
    return ranks.groupBy(*keys, "a", "b").agg(correlation("rx", "ry").alias("spearman"))


def correlation_comparison(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Pearson and Spearman side by side."""
    joined = pearson_pairs(df, keys, columns).join(spearman_pairs(df, keys, columns), [*keys, "a", "b"])
    return joined.withColumn("delta", F.col("spearman") - F.col("pearson"))


def transformed_series(df: DataFrame, keys: list[str], columns: list[str]) -> dict[str, DataFrame]:
    """Levels, differences and percent changes of the same columns."""
    w = series_window(keys)

    def change(k: int, percent: bool) -> DataFrame:
        out = {}
        for c in columns:
            step = F.col(c) - F.lag(c, k).over(w)
            out[c] = F.try_divide(step, F.lag(c, k).over(w)) if percent else step
        return df.select(*keys, "date", *[e.alias(c) for c, e in out.items()])

    return {
        "levels": df.select(*keys, "date", *columns),
        "first_difference": change(1, False),
        "mom_pct": change(1, True),
        "yoy_pct": change(12, True),
        "annual_difference": change(12, False),
        "residuals": residuals(df, keys, columns),
    }


def transform_comparison(df: DataFrame, keys: list[str], columns: list[str], target: str) -> DataFrame:
    """Strongest correlation with the target over all transforms, per other column."""
    ordered = [target, *[c for c in columns if c != target]]
    parts = [
        pearson_pairs(frame, keys, ordered).where(F.col("a") == target).withColumn("method", F.lit(name))
        for name, frame in transformed_series(df, keys, ordered).items()
    ]
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    return long.groupBy(*keys, "b").agg(
        F.max(F.abs("pearson")).alias("max_abs_r"), F.max_by("method", F.abs("pearson")).alias("best_method")
    )


def lagged_correlations(df: DataFrame, keys: list[str], target: str, predictors: list[str], max_lag: int = 12, min_rows: int = 20) -> DataFrame:
    """Correlation of the target with each predictor 0..max_lag months earlier; needs more than min_rows."""
    w = series_window(keys)
    lags = range(max_lag + 1)
    frame = df.select(*keys, target, *[F.lag(p, k).over(w).alias(f"{p}_{k}") for p in predictors for k in lags])
    stats = frame.groupBy(*keys).agg(
        F.array(
            *[
                F.struct(
                    F.lit(p).alias("predictor"),
                    F.lit(k).alias("lag_months"),
                    correlation(target, f"{p}_{k}").alias("correlation"),
                    F.count(F.when(F.col(target).isNotNull() & F.col(f"{p}_{k}").isNotNull(), 1)).alias("n"),
                )
                for p in predictors
                for k in lags
            ]
        ).alias("_s")
    )
    return stats.select(*keys, F.explode("_s").alias("s")).select(*keys, "s.*").where(F.col("n") > min_rows)


def residuals(df: DataFrame, keys: list[str], columns: list[str], min_values: int = 24) -> DataFrame:
    """Residuals of a linear trend plus calendar-month effects (E5).

    Removing month means from the value and from the time index leaves a one-variable regression.
    """
    w = series_window(keys)
    frame = df.select(*keys, "date", *columns, (F.row_number().over(w) - 1).cast("double").alias("_t"))
    whole = W.partitionBy(*keys) if keys else W.partitionBy()
    monthly = W.partitionBy(*keys, F.month("date"))
    centred = {}
    for c in columns:
        value = F.col(c).cast("double")
        centred[f"_y_{c}"] = value - F.avg(value).over(monthly)
        time = F.when(value.isNotNull(), F.col("_t"))
        centred[f"_x_{c}"] = time - F.avg(time).over(monthly)
    frame = frame.withColumns(centred)
    out = {}
    for c in columns:
        slope = F.try_divide(
            F.sum(F.col(f"_x_{c}") * F.col(f"_y_{c}")).over(whole), F.sum(F.col(f"_x_{c}") * F.col(f"_x_{c}")).over(whole)
        )
        enough = F.count(c).over(whole) >= min_values
        out[c] = F.when(enough, F.col(f"_y_{c}") - F.coalesce(slope, F.lit(0.0)) * F.col(f"_x_{c}"))
    return frame.select(*keys, "date", *[e.alias(c) for c, e in out.items()])


def target_correlations(df: DataFrame, features: list[str], target: str, categories: Column | None = None, min_rows: int = 30) -> DataFrame:
    """Screen of features against the target: r, |r| and n, varied features only."""
    usable = [c for c in features if c != target]
    stats = df.where(F.col(target).isNotNull()).agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    correlation(c, target).alias("corr_with_target"),
                    F.count(c).alias("n"),
                    (F.max(c) > F.min(c)).alias("varied"),
                )
                for c in usable
            ]
        ).alias("_s")
    )
    rows = stats.select(F.explode("_s").alias("s")).select("s.*").where((F.col("n") >= min_rows) & F.col("varied")).drop("varied")
    out = rows.withColumn("abs_corr", F.abs("corr_with_target"))
    return out if categories is None else out.withColumn("category", categories)


def category_rollup(screen: DataFrame) -> DataFrame:
    """Feature count, strongest and median |r| per category (A29); one row per feature goes in."""
    return screen.groupBy("category").agg(
        F.count(F.lit(1)).alias("features"),
        F.max("abs_corr").alias("max_abs_corr"),
        F.percentile("abs_corr", F.lit(0.5)).alias("median_abs_corr"),
    )


def collinear_pairs(df: DataFrame, features: list[str], target: str, top: int = 60, threshold: float = 0.95) -> DataFrame:
    """Highly correlated pairs among the features most related to the target.

    The screen has one row per feature, so the chosen names are a bounded list.
    """
    screen = target_correlations(df, features, target).orderBy(F.col("abs_corr").desc(), "feature").limit(top)
    names = [r["feature"] for r in screen.select("feature").collect()]
    ordered = [c for c in features if c in set(names)]
    modelable = df.where(F.col(target).isNotNull())
    return pearson_pairs(modelable, [], ordered).withColumn("abs_corr", F.abs("pearson")).where(F.col("abs_corr") >= threshold)


def observation_summary(raw: DataFrame, series: str, observations: str) -> DataFrame:
    """Observation count and date range of nested responses."""
    dates = F.transform(F.col(observations), lambda o: o["date"])
    return raw.select(
        series, F.size(observations).alias("observations"), F.array_min(dates).alias("first_date"), F.array_max(dates).alias("last_date")
    )
