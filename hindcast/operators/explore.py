"""Leaderboard exploration: ranking, top-k, paths, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hindcast.constants import BASELINE_BUILDS, BASELINE_FAMILIES, BUILD_ORDER, EVALUATION_PERIODS, FAMILY_ORDER, RANK_METRICS
from hindcast.functions.calendar import months_apart
from hindcast.functions.scalar import params_display, params_map, params_short, row_max, row_mean, row_min, safe_ratio, shown_value, to_number
from hindcast.operators.distribution import exact_quantiles, join_null_safe, quantile_columns, ranked, unpivot_numbers
from hindcast.session import materialize

METRIC_BY_LABEL = {label: (column, lower) for label, column, lower in RANK_METRICS}
BUILD_KEYS = ["model_family", "model_build", "model_build_label"]


# --- filters (P11-P13) -----------------------------------------------------------------------------


def filter_values(df: DataFrame, choices: dict[str, str | list[str] | None]) -> DataFrame:
    """Keep rows matching every choice; "All", None, an empty list or an absent column filters nothing."""
    for column, choice in choices.items():
        if column not in df.columns or choice in ("All", None) or choice == []:
            continue
        values = choice if isinstance(choice, list) else [choice]
        df = df.where(F.col(column).cast("string").isin([str(v) for v in values]))
    return df


def date_window(df: DataFrame, column: str, start: str | Column, end: str | Column) -> DataFrame:
    def bound(value: str | Column) -> Column:
        return F.lit(value).cast("date") if isinstance(value, str) else value

    return df.where(F.col(column).between(bound(start), bound(end)))


def date_bounds(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("first_date"), F.max(column).alias("last_date"))


def default_window(bounds: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """A metric's own period cut to the available dates; all dates if they do not overlap."""
    low = F.greatest("first_date", F.lit(start).cast("date")) if start else F.col("first_date")
    high = F.least("last_date", F.lit(end).cast("date")) if end else F.col("last_date")
    return bounds.select(
        F.when(low > high, F.col("first_date")).otherwise(low).alias("start_date"),
        F.when(low > high, F.col("last_date")).otherwise(high).alias("end_date"),
    )


def without_baselines(df: DataFrame) -> DataFrame:
    """Candidates only: the seasonal baseline is a reference line, not a choice."""
    for column, values in (("model_family", BASELINE_FAMILIES), ("model_build", BASELINE_BUILDS)):
        if column in df.columns:
            df = df.where(~F.coalesce(F.col(column).isin(values), F.lit(False)))
    return df


# --- ranking (T1-T4, T6, T8, T10, T13) -------------------------------------------------------------


def rank_by(df: DataFrame, label: str) -> DataFrame:
    """Complete ranking by a labelled metric in its own direction; rows without it are dropped."""
    column, ascending = METRIC_BY_LABEL[label]
    table = materialize(df)
    return ranked(table, [], column, ascending, "model_config_id")


def _order(metric: str, ascending: bool, tie: str) -> list[Column]:
    return [F.col(metric).asc() if ascending else F.col(metric).desc(), F.col(tie).asc()]


def top_rows(df: DataFrame, metric: str, ascending: bool, n: int, tie: str = "model_config_id") -> DataFrame:
    """Best ``n`` rows with their rank (T2, T8). The heap of ``n`` rows per task precedes the merge, so
    the ranking window only sees ``n`` rows."""
    best = df.where(F.col(metric).isNotNull()).orderBy(*_order(metric, ascending, tie)).limit(n)
    w = W.partitionBy().orderBy(*_order(metric, ascending, tie))
    return best.withColumn("rank", F.row_number().over(w).cast("bigint"))


def top_per_group(df: DataFrame, group: list[str], metric: str, ascending: bool, n: int, tie: str = "model_config_id") -> DataFrame:
    """Best ``n`` rows per group (T3). The rank filter is applied before the exchange as well, so a group
    sends at most ``n`` rows per task however large it is."""
    w = W.partitionBy(*group).orderBy(*_order(metric, ascending, tie))
    return (
        df.where(F.col(metric).isNotNull()).withColumn("group_rank", F.row_number().over(w))
        .where(F.col("group_rank") <= n).withColumn("group_rank", F.col("group_rank").cast("bigint"))
    )


def top_fraction(df: DataFrame, metric: str, ascending: bool, fraction: float, tie: str = "model_config_id") -> DataFrame:
    """The best share of rows: ceil(n * fraction), at least one (T4)."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must be above 0 and at most 1")
    frame = materialize(df.where(F.col(metric).isNotNull()))
    keep = frame.agg(F.greatest(F.ceil(F.count(F.lit(1)) * F.lit(fraction)), F.lit(1)).alias("k")).scalar()
    return ranked(frame, [], metric, ascending, tie).where(F.col("rank") <= keep)


def best_per_key(df: DataFrame, key: str, metric: str) -> DataFrame:
    """One row per key, the one with the lowest metric; of equal ones the least in its other columns."""
    rest = [F.col(f.name) for f in df.schema.fields if f.name not in (key, metric) and f.dataType.typeName() != "map"]
    w = W.partitionBy(key).orderBy(F.col(metric).asc_nulls_last(), *rest)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def seeds(leaderboard: DataFrame, choices: dict[str, str | list[str] | None], score: str, fraction: float = 0.10, top_n: int | None = None) -> DataFrame:
    """Configurations of a prior experiment worth running again (B2)."""
    work = best_per_key(filter_values(leaderboard, choices), "model_config_id", score)
    picked = top_rows(work, score, True, max(1, top_n)) if top_n else top_fraction(work, score, True, fraction)
    return picked.withColumnRenamed("model_config_id", "source_model_config_id")


def order_position(column: str, order: list[str]) -> Column:
    """Place in a domain order; values outside it come last."""
    spot = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return F.when(spot > 0, spot - 1).otherwise(F.lit(len(order)))


def taxonomy_order(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"family_order": order_position("model_family", FAMILY_ORDER), "build_order": order_position("model_build", BUILD_ORDER)}
    )


def curated_rows(ranked_rows: DataFrame, wanted: list[tuple[str, str | None]]) -> DataFrame:
    """First ranked row for each listed (family, mode or any) pair."""
    options = F.array(
        *[F.struct(F.lit(i).alias("entry"), F.lit(f).alias("f"), F.lit(m).cast("string").alias("m")) for i, (f, m) in enumerate(wanted)]
    )
    matching = F.filter(options, lambda o: (o["f"] == F.col("feature_family_name")) & (o["m"].isNull() | (o["m"] == F.col("mode"))))
    w = W.partitionBy("entry").orderBy("rank")
    return (
        ranked_rows.withColumn("_o", F.explode(matching)).withColumn("entry", F.col("_o.entry")).drop("_o")
        .withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    )


def middle_row(paths: DataFrame, key: str, order: str) -> DataFrame:
    """The row at position count // 2 of each path (T10); a path is bounded by the as-of months."""
    by_date = W.partitionBy(key).orderBy(order)
    spot = F.floor(F.count(F.lit(1)).over(W.partitionBy(key)) / 2)
    return (
        paths.withColumns({"_n": F.row_number().over(by_date) - 1, "_middle": spot})
        .where(F.col("_n") == F.col("_middle")).drop("_n", "_middle")
    )


def month_interval(df: DataFrame, column: str) -> DataFrame:
    """Most common month distance between the distinct dates, as a label."""
    # Distinct months are bounded by the calendar.
    gaps = df.where(F.col(column).isNotNull()).select(F.col(column).alias("d")).distinct().withColumn(
        "gap", months_apart(F.lag("d").over(W.partitionBy().orderBy("d")), "d")
    )
    common = F.mode("gap", True)
    label = F.when(common == 1, "1 month").otherwise(F.concat(common.cast("string"), F.lit(" months")))
    return gaps.agg(F.coalesce(label, F.lit("-")).alias("interval"))


# --- labels and tables (P22, T11) ------------------------------------------------------------------

TABLE_COLUMNS = {
    "overview": [
        "rank", "model_build_label", "feature_family_name", "feature_transform_label", "mode", "feature_policy",
        "hyperparameters", "mae", "rmse", "r2", "r2_adjusted", "diracc", "selection_score_balanced",
        *[f"{p}_{m}" for p in EVALUATION_PERIODS for m in ("mae", "rmse")],
        "shock_penalty", "rmse_shock_penalty", "recovery_ratio", "rmse_recovery_ratio", "recent_recovery_ratio",
        "rmse_recent_recovery_ratio",
    ],
    "ranked": [
        "rank", "model_build_label", "mode", "feature_family_name", "feature_transform_label", "feature_policy",
        "hyperparameters", "mae", "rmse", "r2", "r2_adjusted", "diracc", "selection_score_balanced",
        *[f"{p}_{m}" for p in EVALUATION_PERIODS for m in ("mae", "rmse")],
    ],
}


def metric_table(df: DataFrame, kind: str) -> DataFrame:
    shown = params_display("hyperparameters_json") if "hyperparameters_json" in df.columns else F.lit("N/A")
    out = df.withColumn("hyperparameters", shown)
    return out.select(*[c for c in TABLE_COLUMNS[kind] if c in out.columns])


def format_metric(column: str) -> Column:
    value = F.col(column)
    digits = 4 if column in ("r2", "r2_adjusted", "diracc") else 3 if column.endswith(("_ratio", "_penalty")) else 0
    return F.coalesce(F.format_number(value, digits), F.lit("N/A"))


def model_label(label: str) -> Column:
    """One-line description of a ranked configuration."""
    column, _ = METRIC_BY_LABEL[label]
    return F.concat_ws(
        " | ",
        F.concat(F.lit("#"), F.col("rank").cast("string")),
        F.col("model_build_label"),
        F.col("mode"),
        F.col("feature_family_name"),
        F.col("feature_transform_label"),
        F.concat(F.lit(label.lower() + " "), format_metric(column)),
        F.concat(F.lit("MAE "), format_metric("mae")),
        F.concat(F.lit("RMSE "), format_metric("rmse")),
        params_short("hyperparameters_json"),
    )


# --- paths (A11, A12, A33, T7, T12) ----------------------------------------------------------------


def path_signature(paths: DataFrame, digits: int = 3) -> DataFrame:
    """One digest per configuration over its dated, rounded predictions; a path is bounded by its months."""
    steps = F.array_sort(F.collect_list(F.struct("target_date", F.round("prediction", digits).alias("p"))))
    return paths.groupBy("model_config_id").agg(F.sha2(F.to_json(F.transform(steps, lambda s: s["p"])), 256).alias("signature"))


def distinct_paths(ranked_models: DataFrame, paths: DataFrame, limit: int) -> DataFrame:
    """Best-ranked model of each distinct prediction path, at most ``limit``.

    ``duplicate_count`` tells how many better-ranked models before the cut repeat a path. The join side
    is one digest per configuration.
    """
    signed = ranked_models.join(path_signature(paths), "model_config_id")
    first = signed.groupBy("signature").agg(F.min("rank").alias("_first"))
    leaders = first.orderBy("_first").limit(limit).withColumn(
        "path_rank", F.row_number().over(W.partitionBy().orderBy("_first")).cast("bigint")
    )
    last = leaders.agg(F.max("_first").alias("m"), F.count(F.lit(1)).alias("n"))
    considered = signed.where(F.col("rank") <= last.select("m").scalar()).agg(F.count(F.lit(1)).alias("n"))
    chosen = signed.join(leaders, (signed["rank"] == leaders["_first"]) & (signed["signature"] == leaders["signature"])).select(
        signed["*"], "path_rank"
    )
    return chosen.withColumn("duplicate_count", considered.scalar() - last.select("n").scalar())


def average_paths(paths: DataFrame, models: DataFrame) -> DataFrame:
    """Mean path per build and target month."""
    lookup = models.select("model_config_id", *BUILD_KEYS).distinct()
    clash = [c for c in BUILD_KEYS if c in paths.columns]
    joined = paths.drop(*clash).join(lookup, "model_config_id")
    means = [c for c in ("prediction", "baseline_prediction", "seasonal_naive_prediction") if c in paths.columns]
    grouped = joined.groupBy(*BUILD_KEYS, "target_date").agg(
        F.min_by("actual", F.when(F.col("actual").isNotNull(), F.struct("model_config_id", "as_of_date"))).alias("actual"),
        *[F.avg(c).alias(c) for c in means],
    )
    return grouped.withColumns(
        {
            "model_config_id": F.concat(F.lit("avg::"), "model_build"),
            "feature_family_name": F.lit("Average of selected configs"),
            "mode": F.lit("average"),
        }
    )


def average_performance(performance: DataFrame, models: DataFrame, column: str = "rolling_6mo_mae") -> DataFrame:
    """Mean rolling error per build and as-of month."""
    lookup = models.select("config_id", *BUILD_KEYS).distinct()
    clash = [c for c in BUILD_KEYS if c in performance.columns]
    return (
        performance.drop(*clash).join(lookup, "config_id").groupBy(*BUILD_KEYS, "as_of_date")
        .agg(F.avg(column).alias(column)).withColumn("config_id", F.concat(F.lit("avg::"), "model_build"))
    )


def largest_errors(paths: DataFrame, config_id: Column, n: int) -> DataFrame:
    """Largest absolute errors of one configuration."""
    return top_rows(paths.where(F.col("config_id") == config_id), "abs_error", False, n, tie="as_of_date")


def explore(
    leaderboard: DataFrame, paths: DataFrame, choices: dict, label: str, per_build: int | None, total: int | None,
    start: str, end: str,
) -> tuple[DataFrame, DataFrame]:
    """Filter, rank, cut per build and in total, then load the matching paths in a date window.

    The configuration set joins the facts as a semi join; partitions of unselected builds are pruned at
    run time when the facts are stored by build.
    """
    column, ascending = METRIC_BY_LABEL[label]
    picked = filter_values(without_baselines(leaderboard), choices).where(F.col(column).isNotNull())
    if per_build is not None:
        picked = top_per_group(picked, ["model_build"], column, ascending, per_build).drop("group_rank")
    models = top_rows(picked, column, ascending, total) if total is not None else rank_by(picked, label)
    ids = models.select("model_config_id", "model_build")
    chosen = paths.join(ids, ["model_config_id", "model_build"], "left_semi")
    return models, date_window(chosen, "target_date", start, end)


# --- summaries (A13-A20, A35) ----------------------------------------------------------------------


def metric_mapping(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of the chosen metrics and configuration count per build."""
    return frame.groupBy(*BUILD_KEYS).agg(
        *[F.avg(c).alias(c) for c in columns if c in frame.columns], F.count(F.lit(1)).alias("configurations")
    )


def group_summary(frame: DataFrame, group: list[str], score: str = "selection_score_balanced") -> DataFrame:
    """Best and median results per group (A14); medians are exact at any size."""
    frame = materialize(frame.select(*group, "config_id", *{score: 0, "mae": 0, "rmse": 0, "r2": 0}))
    best = frame.groupBy(*group).agg(
        F.count_distinct("config_id").alias("configurations"),
        F.min(score).alias("best_balanced_score"),
        F.min("mae").alias("best_mae"),
        F.min("rmse").alias("best_rmse"),
        F.max("r2").alias("best_r2"),
    )
    medians = quantile_columns(frame, group, [score, "mae"], {"median": 0.5}).withColumnsRenamed(
        {f"median_{score}": "median_balanced_score"}
    )
    return join_null_safe(best, medians, group)


def scope_counts(frame: DataFrame, group: list[str]) -> DataFrame:
    return frame.groupBy(*group).agg(F.count_distinct("config_id").alias("configurations"))


def period_difficulty(leaderboard: DataFrame) -> DataFrame:
    """Best, median and their gap per evaluation period."""
    columns = [f"{p}_{m}" for p in EVALUATION_PERIODS for m in ("mae", "rmse")]
    table = materialize(leaderboard.select(*columns))
    long = unpivot_numbers(table, [], columns)
    best = long.groupBy("variable").agg(F.min("value").alias("best"))
    median = exact_quantiles(long, ["variable"], "value", [0.5]).select("variable", F.col("quantile").alias("median"))
    joined = best.join(median, "variable", "left")
    period, metric = F.regexp_extract("variable", "^(.*)_(mae|rmse)$", 1), F.regexp_extract("variable", "^(.*)_(mae|rmse)$", 2)
    wide = joined.groupBy(period.alias("period")).agg(
        *[
            F.max(F.when(metric == m, F.col(s))).alias(f"{s}_{m}")
            for m in ("mae", "rmse")
            for s in ("best", "median")
        ]
    )
    return wide.withColumn(
        "best_vs_median_improvement", safe_ratio(F.col("median_mae") - F.col("best_mae"), F.col("median_mae"))
    )


def robustness(leaderboard: DataFrame, score: str = "selection_score_balanced") -> DataFrame:
    """Worst period, spread and mean, blended 0.5/0.3/0.2 with the score."""
    columns = [c for c in (f"{p}_mae" for p in EVALUATION_PERIODS) if c in leaderboard.columns]
    out = leaderboard.withColumns(
        {
            "worst_period_mae": row_max(columns),
            "period_mae_spread": row_max(columns) - row_min(columns),
            "period_mae_mean": row_mean(columns),
        }
    )
    blend = F.col(score) * 0.50 + F.col("worst_period_mae") * 0.30 + F.col("period_mae_spread") * 0.20
    return out.withColumn("robustness_rank_score", blend)


def operational_footprint(profile: DataFrame) -> DataFrame:
    """Configuration count, total and median training time and scores per build."""
    medians = {
        "total_train_seconds": "median_config_train_seconds",
        "avg_train_seconds": "median_refit_train_seconds",
        "refit_count": "refit_count",
        "avg_n_train": "avg_n_train",
        "compute_score": "compute_score",
        "complexity_score": "complexity_score",
    }
    present = {c: n for c, n in medians.items() if c in profile.columns}
    profile = materialize(profile.select(*BUILD_KEYS, "config_id", *present))
    totals = profile.groupBy(*BUILD_KEYS).agg(
        F.count_distinct("config_id").alias("configurations"), F.sum("total_train_seconds").alias("total_train_seconds")
    )
    middle = quantile_columns(profile, BUILD_KEYS, list(present), {"median": 0.5}).withColumnsRenamed(
        {f"median_{c}": f"_{n}" for c, n in present.items()}
    ).withColumnsRenamed({f"_{n}": n for n in present.values()})
    return join_null_safe(totals, middle, BUILD_KEYS)


def sensitivity(frame: DataFrame, x: str, y: str, ascending: bool, bins: int = 6) -> DataFrame:
    """Results by equal-frequency bins of a numeric setting.

    Edges are exact quantiles; repeated edges collapse, so heavily tied settings give fewer bins. Bins
    are right-closed and the first one includes its lower edge.
    """
    source = materialize(frame.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL"))
    edges = exact_quantiles(source, [], "x", [i / bins for i in range(bins + 1)]).agg(
        F.array_sort(F.collect_set("quantile")).alias("e")
    )
    binned = source.withColumn("_e", edges.scalar()).withColumn(
        "bin", F.greatest(F.size(F.filter("_e", lambda e: e < F.col("x"))), F.lit(1)) - 1
    )
    best = F.min("y") if ascending else F.max("y")
    grouped = binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("configurations"),
        best.alias("best"),
        F.first(F.get("_e", F.col("bin"))).alias("bin_low"),
        F.first(F.try_element_at("_e", F.col("bin") + 2)).alias("bin_high"),
    )
    middle = exact_quantiles(binned, ["bin"], "y", [0.5]).select("bin", F.col("quantile").alias("median"))
    return grouped.join(middle, "bin", "left")


def sensitivity_by_value(frame: DataFrame, x: str, y: str, ascending: bool) -> DataFrame:
    """Results per raw value of a setting with few values."""
    source = materialize(
        frame.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
            F.col(x).cast("string").alias("setting"), F.col(y).cast("double").alias("y")
        )
    )
    best = F.min("y") if ascending else F.max("y")
    grouped = source.groupBy("setting").agg(F.count(F.lit(1)).alias("configurations"), best.alias("best"))
    middle = exact_quantiles(source, ["setting"], "y", [0.5]).select("setting", F.col("quantile").alias("median"))
    return grouped.join(middle, "setting", "left")


def column_variation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: distinct text values, varied, share of numeric values, mostly numeric."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = text.unpivot([], columns, "column_name", "v").where(F.col("v").isNotNull())
    stats = long.groupBy("column_name").agg(
        F.count_distinct("v").alias("distinct_values"), F.avg(to_number("v").isNotNull().cast("double")).alias("numeric_share")
    )
    return stats.withColumns(
        {"is_varied": F.col("distinct_values") > 1, "is_mostly_numeric": F.col("numeric_share") >= 0.9}
    )


def build_comparison(frame: DataFrame, label: str) -> DataFrame:
    """Best MAE, RMSE and chosen metric per build."""
    column, ascending = METRIC_BY_LABEL[label]
    best = F.min(column) if ascending else F.max(column)
    return frame.groupBy(*BUILD_KEYS).agg(
        F.min("mae").alias("best_mae"), F.min("rmse").alias("best_rmse"), best.alias("best_metric")
    )


def build_share(frame: DataFrame, metric: str, ascending: bool, n: int) -> DataFrame:
    """How the best ``n`` configurations split over builds."""
    top = top_rows(frame, metric, ascending, n)
    return top.groupBy("model_build").agg(
        F.count(F.lit(1)).alias("in_top"), (F.count(F.lit(1)) / F.lit(n)).alias("share")
    )


# --- hyper-parameter columns (X9) ------------------------------------------------------------------


def parameter_long(df: DataFrame, key: str = "model_config_id", column: str = "hyperparameters_json") -> DataFrame:
    """Parameters as rows (key, name, value, numeric value, list first/total/max/count)."""
    rows = df.select(key, F.explode(params_map(column)).alias("raw_name", "raw_value"))
    name = F.lower(F.btrim(F.regexp_replace("raw_name", "[^a-zA-Z0-9_]+", "_"), F.lit("_")))
    items = F.from_json("raw_value", "array<double>")
    numbers = F.when(F.col("raw_value").startswith("["), F.filter(items, lambda v: v.isNotNull()))
    return rows.select(
        key,
        F.concat(F.lit("hp_"), name).alias("name"),
        shown_value(F.col("raw_value")).alias("value"),
        to_number("raw_value").alias("number"),
        F.get(numbers, F.lit(0)).alias("first"),
        F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda t, v: t + v)).alias("total"),
        F.array_max(numbers).alias("largest"),
        F.when(F.size(numbers) > 0, F.size(numbers)).alias("items"),
    ).where(F.col("name") != "hp_")


def with_parameter_columns(df: DataFrame, names: list[str], column: str = "hyperparameters_json") -> DataFrame:
    """Add ``hp_*`` columns for known parameter names without a shuffle."""
    out = df.withColumn("_p", params_map(column))
    return out.withColumns({f"hp_{n}": F.try_element_at("_p", F.lit(n)) for n in names}).drop("_p")


def parameter_names(df: DataFrame, column: str = "hyperparameters_json") -> DataFrame:
    """Parameter names in use; distinct names, not rows, reach the driver if collected."""
    return df.select(F.explode(F.map_keys(params_map(column))).alias("name")).distinct()
