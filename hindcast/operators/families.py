"""Named feature families and what they carry.

A family is a driver-side ordered list of column names; families also exist as a
(family, position, feature) frame so that audits and flags are ordinary aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.constants import FEATURE_MARKS
from hindcast.functions.ids import feature_hash, feature_set_id, json_string_list
from hindcast.operators.features import EXOGENOUS_LAGS, SERVICE_LAGS, TARGET_LAGS


def interaction_names(bases: list[str], flags: list[str]) -> list[str]:
    return [f"{b}_x_{f}" for b in bases for f in flags]


def lag_names(columns: list[str], recipe: dict) -> list[str]:
    """Names that ``features.lag_columns`` gives these measures under a lag recipe, measure by measure."""
    out = []
    for column in columns:
        out += [f"{column}_lag{k}" for k in recipe["lags"]]
        out += [f"{column}_diff_lag{k}" for k in recipe["diffs"]]
        out += [f"{column}_rollmean_{size}" for size in recipe["rolling"]]
        out += [f"{column}_yoy_diff"]
    return out


def base_groups(
    target: str,
    horizon: int,
    price: list[str],
    index: list[str],
    service: list[str],
    income: list[str],
    pressure: list[str],
    regime: list[str],
    flags: list[str],
) -> dict[str, list[str]]:
    """Building blocks of the families, for any choice of measure names.

    Lags of the measures follow the recipes that build the feature table; of the target's lags a family
    takes those listed here.
    """
    exogenous = [f"{price[0]}_lag1", f"{price[0]}_yoy_diff"] if price else []
    if index:
        exogenous += [f"{index[0]}_lag1", f"{index[-1]}_yoy_diff"]
    history = [f"{target}_lag1", f"{target}_lag3", f"{target}_lag12", f"{target}_rollmean_3", f"{target}_yoy_diff"]
    return {
        "history_core": [f"{target}_lag{k}" for k in (1, 2, 3, 6, 12, 18, 24)],
        "history_recent_deltas": [f"{target}_diff_lag{k}" for k in TARGET_LAGS["diffs"]],
        "history_rolls": [f"{target}_{statistic}_{size}" for size in TARGET_LAGS["rolling"] for statistic in ("rollmean", "rollstd")],
        "history_yoy": [f"{target}_yoy_diff"],
        "seasonality": ["month_sin", "month_cos", f"target_month_sin_h{horizon}", f"target_month_cos_h{horizon}"],
        "regime": regime,
        "time_trend": ["time_index_months"],
        "gas": lag_names(price, EXOGENOUS_LAGS),
        "cpi": lag_names(index, EXOGENOUS_LAGS),
        "service": lag_names(service, SERVICE_LAGS),
        "income": income,
        "income_pressure_interactions": pressure,
        "history_regime_interactions": interaction_names(history, flags),
        "time_regime_interactions": interaction_names(["time_index_months", "month_sin", "month_cos"], flags),
        "exog_regime_interactions": interaction_names(exogenous, flags),
        "service_regime_interactions": interaction_names([f"{c}_lag1" for c in service], flags),
        "income_regime_interactions": interaction_names(income[2:4], flags),
    }


# The families and the building blocks each joins, in order.
FAMILY_BLOCKS = {
    "history_only": [
        "history_core",
        "seasonality",
    ],
    "history_recent": [
        "history_core",
        "history_recent_deltas",
        "seasonality",
    ],
    "history_rolls": [
        "history_core",
        "history_recent_deltas",
        "history_rolls",
        "seasonality",
    ],
    "history_full": [
        "history_core",
        "history_recent_deltas",
        "history_rolls",
        "history_yoy",
        "seasonality",
    ],
    "history_regime": [
        "history_core",
        "history_recent_deltas",
        "history_rolls",
        "history_yoy",
        "seasonality",
        "regime",
    ],
    "history_regime_time": [
        "history_core",
        "history_recent_deltas",
        "history_rolls",
        "history_yoy",
        "seasonality",
        "regime",
        "time_trend",
    ],
    "history_regime_gas": [
        "history_core",
        "history_recent_deltas",
        "history_rolls",
        "history_yoy",
        "seasonality",
        "regime",
        "gas",
    ],
    "history_regime_cpi": [
        "history_core",
        "history_recent_deltas",
        "history_rolls",
        "history_yoy",
        "seasonality",
        "regime",
        "cpi",
    ],
    "history_regime_service": [
        "history_core",
        "history_recent_deltas",
        "history_rolls",
        "history_yoy",
        "seasonality",
        "regime",
        "service",
    ],
    "history_regime_gas_cpi": [
        "history_core",
        "history_recent_deltas",
        "history_rolls",
        "history_yoy",
        "seasonality",
        "regime",
        "gas",
        "cpi",
    ],
    "history_regime_gas_service": [
        "history_core",
        "history_recent_deltas",
        "history_rolls",
        "history_yoy",
        "seasonality",
        "regime",
        "gas",
        "service",
    ],
    "history_regime_cpi_service": [
        "history_core",
        "history_recent_deltas",
        "history_rolls",
        "history_yoy",
        "seasonality",
        "regime",
        "cpi",
        "service",
    ],
    "history_regime_all_exog": [
        "history_core",
        "history_recent_deltas",
        "history_rolls",
        "history_yoy",
        "seasonality",
        "regime",
        "gas",
        "cpi",
        "service",
    ],
    "history_regime_time_all_exog": [
        "history_core",
        "history_recent_deltas",
        "history_rolls",
        "history_yoy",
        "seasonality",
        "regime",
        "time_trend",
        "gas",
        "cpi",
        "service",
    ],
    "history_regime_linear_interactions": [
        "history_core",
        "history_recent_deltas",
        "history_rolls",
        "history_yoy",
        "seasonality",
        "regime",
        "history_regime_interactions",
    ],
    "history_regime_time_linear_interactions": [
        "history_core",
        "history_recent_deltas",
        "history_rolls",
        "history_yoy",
        "seasonality",
        "regime",
        "time_trend",
        "history_regime_interactions",
        "time_regime_interactions",
    ],
    "history_regime_exog_linear_interactions": [
        "history_core",
        "history_recent_deltas",
        "history_rolls",
        "history_yoy",
        "seasonality",
        "regime",
        "gas",
        "cpi",
        "history_regime_interactions",
        "exog_regime_interactions",
    ],
    "history_regime_all_exog_linear_interactions": [
        "history_core",
        "history_recent_deltas",
        "history_rolls",
        "history_yoy",
        "seasonality",
        "regime",
        "time_trend",
        "gas",
        "cpi",
        "service",
        "history_regime_interactions",
        "time_regime_interactions",
        "exog_regime_interactions",
        "service_regime_interactions",
    ],
    "history_regime_income": [
        "history_core",
        "history_recent_deltas",
        "history_rolls",
        "history_yoy",
        "seasonality",
        "regime",
        "income",
    ],
    "history_regime_income_pressure": [
        "history_core",
        "history_recent_deltas",
        "history_rolls",
        "history_yoy",
        "seasonality",
        "regime",
        "gas",
        "cpi",
        "income",
        "income_pressure_interactions",
    ],
    "history_regime_income_linear_interactions": [
        "history_core",
        "history_recent_deltas",
        "history_rolls",
        "history_yoy",
        "seasonality",
        "regime",
        "income",
        "income_regime_interactions",
    ],
}


def compose_families(groups: dict[str, list[str]], families: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Join the building blocks of every family in order; a repeated column keeps its first place."""
    return {
        family: list(dict.fromkeys(column for block in blocks for column in groups[block]))
        for family, blocks in (families or FAMILY_BLOCKS).items()
    }


def prefix_families(columns: list[str], prefixes: dict[str, list[str]]) -> dict[str, list[str]]:
    """Families picked by column-name prefix."""
    return {name: [c for c in columns if c.startswith(tuple(p))] for name, p in prefixes.items()}


def available(families: dict[str, list[str]], family: str, columns: list[str]) -> list[str]:
    """Family columns the table really has, in family order."""
    if family not in families:
        raise KeyError(f"unknown feature family: {family}")
    present = set(columns)
    return [c for c in families[family] if c in present]


def families_frame(spark: SparkSession, families: dict[str, list[str]]) -> DataFrame:
    rows = [(name, i, column) for name, columns in families.items() for i, column in enumerate(columns)]
    return spark.createDataFrame(rows, "feature_family_name string, position int, feature string")


def family_audit(families: DataFrame, columns: list[str]) -> DataFrame:
    """Requested and available counts and the missing columns per family."""
    present = F.array(*[F.lit(c) for c in columns]).cast("array<string>")
    wanted = families.groupBy("feature_family_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "feature"))), lambda e: e["feature"]).alias("all")
    )
    missing = F.filter("all", lambda c: ~F.array_contains(present, c))
    return wanted.select(
        "feature_family_name",
        F.size("all").alias("requested_features"),
        (F.size("all") - F.size(missing)).alias("available_features"),
        missing.alias("missing_features"),
    )


# --- name classification (P20, P21) ----------------------------------------------------------------

# Fragments that mark a regime feature.
REGIME_FRAGMENTS = [
    "pandemic_observed", "pandemic_disruption_active", "post_pandemic_observed", "is_covid_disruption",
    "is_post_covid", "_x_pandemic_", "_x_is_covid", "_x_is_post_covid", "months_since_pandemic_observed",
    "months_since_covid_impact",
]
REGIME_POLICY = "pandemic_observed"
REGIME_EVENT = "covid_2020"
REGIME_START = "2020-03-01"


def name_has(feature: Column, fragments: list[str]) -> Column:
    name = F.lower(feature)
    return F.exists(F.array(*[F.lit(f) for f in fragments]), lambda f: F.contains(name, f))


def is_regime_feature(feature: Column, fragments: list[str] | None = None) -> Column:
    return name_has(feature, fragments or REGIME_FRAGMENTS)


def feature_category(feature: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """First matching (regular expression, category) rule on the lower-case name."""
    out = F.lit(default)
    for pattern, category in reversed(rules):
        out = F.when(F.lower(feature).rlike(pattern), F.lit(category)).otherwise(out)
    return out


def regime_metadata(features: Column, as_of: Column | None = None, fragments: list[str] | None = None, start: str = REGIME_START) -> dict[str, Column]:
    """What a feature list says about regimes, and whether that was known at the as-of month."""
    names = F.array_sort(F.filter(features, lambda c: is_regime_feature(c, fragments)))
    uses = F.size(names) > 0
    known = (as_of >= F.lit(start).cast("date")) if as_of is not None else F.lit(False)
    return {
        "regime_policy": F.when(uses, F.lit(REGIME_POLICY)).otherwise("none"),
        "regime_event_id": F.when(uses, F.lit(REGIME_EVENT)).otherwise(""),
        "regime_observed_start_date": F.when(uses, F.lit(start)).otherwise(""),
        "regime_features_available_as_of": uses & known,
        "uses_target_period_features": F.lit(False),
        "regime_feature_names_json": json_string_list(names),
    }


def feature_sets(
    families: DataFrame, modes: list[str], policies: list[str], transforms: list[str], experiment_id: str,
    fragments: list[str] | None = None,
) -> DataFrame:
    """Feature-set dimension: ids, digests and includes_* flags (B20) from (family, position, feature) rows."""

    def options(values: list[str]) -> Column:
        return F.explode(F.array(*[F.lit(v) for v in values]))

    lists = families.groupBy("feature_family_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "feature"))), lambda e: e["feature"]).alias("f")
    )
    grid = (
        lists.withColumn("mode", options(modes)).withColumn("feature_policy", options(policies))
        .withColumn("feature_transform", options(transforms))
    )

    def any_name(marks: list[str]) -> Column:
        return F.exists("f", lambda c: name_has(c, marks))

    flags = {flag: any_name(marks) for flag, marks in FEATURE_MARKS.items()}
    regime = regime_metadata(F.col("f"), fragments=fragments)
    regime.pop("regime_features_available_as_of")
    return grid.select(
        F.lit(experiment_id).alias("experiment_id"),
        feature_set_id("feature_family_name", "mode", F.col("f"), "feature_policy", "feature_transform").alias("feature_set_id"),
        "feature_family_name", "mode", "feature_policy", "feature_transform",
        F.size("f").alias("feature_count"),
        feature_hash(F.col("f")).alias("feature_hash"),
        json_string_list(F.col("f")).alias("feature_names_json"),
        *[c.alias(n) for n, c in flags.items()],
        (regime["regime_policy"] != "none").alias("includes_regime"),
        *[c.alias(n) for n, c in regime.items()],
    )
