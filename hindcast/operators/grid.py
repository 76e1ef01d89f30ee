"""Experiment grids, their size and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.constants import MODEL_TYPES_BY_FAMILY
from hindcast.functions.ids import config_id
from hindcast.operators.distribution import ordinal

LINEAR = MODEL_TYPES_BY_FAMILY["linear"]
TREE = MODEL_TYPES_BY_FAMILY["tree"]
BASELINE_FAMILY = "baseline_naive"


def effective_policy(model_type: Column, policy: Column) -> Column:
    """The policy a model type really uses: one that does not apply to it falls back to none."""
    linear, tree = model_type.isin(LINEAR), model_type.isin(TREE)
    off = (
        (policy.isin("corr_pruned", "lasso_selected") & ~linear)
        | (policy.startswith("tree_top_") & ~tree)
        | ((policy.startswith("mutual_info_top_") | (policy == "variance_pruned")) & ~(linear | tree))
    )
    return F.when(off, F.lit("none")).otherwise(policy)


def effective_transform(model_type: Column, transform: Column) -> Column:
    return F.when(model_type.isin(LINEAR), transform).otherwise(F.lit("identity"))


def _options(values: list[str]) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values]))


def expand_grid(
    families: DataFrame, models: list[tuple[str, dict]], modes: list[str], policies: list[str], transforms: list[str]
) -> DataFrame:
    """Every distinct configuration (B1, J13); the baseline appears once.

    ``families`` has one row per ``feature_family_name``. The other axes are declared lists, so the
    expansion is a chain of explodes on those rows, not a join of tables.
    """

    def typed(pairs: list[tuple[str, dict]]) -> Column:
        items = [
            F.struct(
                F.lit(t).alias("model_type"),
                F.create_map(*[F.lit(x) for k, v in p.items() for x in (k, str(v))]).cast("map<string,string>").alias("params"),
            )
            for t, p in pairs
        ]
        return F.explode(F.array(*items))

    columns = ["model_type", "params", "mode", "feature_family_name", "feature_policy", "feature_transform"]
    fitted = [m for m in models if m[0] != "naive"]
    grid = (
        families.select("feature_family_name").distinct().select("feature_family_name", typed(fitted).alias("m"))
        .select("feature_family_name", "m.*").withColumn("mode", _options(modes)).withColumn("feature_policy", _options(policies))
        .withColumn("feature_transform", _options(transforms))
        .withColumns(
            {
                "feature_policy": effective_policy(F.col("model_type"), F.col("feature_policy")),
                "feature_transform": effective_transform(F.col("model_type"), F.col("feature_transform")),
            }
        )
    ).select(*columns)
    baselines = [m for m in models if m[0] == "naive"]
    if baselines:
        once = families.sparkSession.range(1).select(typed(baselines).alias("m")).select("m.*").withColumns(
            {
                "mode": F.lit("raw"),
                "feature_family_name": F.lit(BASELINE_FAMILY),
                "feature_policy": F.lit("none"),
                "feature_transform": F.lit("identity"),
            }
        )
        grid = grid.unionByName(once.select(*columns))
    named = grid.withColumn(
        "config_id", config_id("model_type", "mode", "feature_family_name", F.col("params"), "feature_policy", "feature_transform")
    )
    return named.dropDuplicates(["config_id"])


def plan_counts(grid: DataFrame, as_of_count: int) -> DataFrame:
    """Configurations and estimated rows per model type."""
    return grid.groupBy("model_type").agg(
        F.count(F.lit(1)).alias("model_config_count"),
        F.count_distinct("feature_family_name").alias("feature_family_count"),
        F.count_distinct("mode").alias("mode_count"),
        F.count_distinct("feature_policy").alias("feature_policy_count"),
        (F.count(F.lit(1)) * as_of_count).alias("estimated_model_run_rows"),
    )


def valid_trend(d: Column, trend: Column) -> Column:
    """Grid rows ruled out: a constant or linear trend does not combine with differencing."""
    return ~(trend.isin("c", "t", "ct") & (d > 0))


def width_bounded(variants: DataFrame, width: str, low: str, high: str) -> DataFrame:
    """Variants that apply to the width of their family; an absent bound does not restrict."""
    c = F.col(width)
    return variants.where((F.col(low).isNull() | (c >= F.col(low))) & (F.col(high).isNull() | (c <= F.col(high))))


def shard(tasks: DataFrame, key: str, shards: int) -> DataFrame:
    """Even shard per task (B4): position in id order modulo the number of shards."""
    placed = ordinal(tasks, [], [key], "_position")
    return placed.withColumn("shard", F.pmod(F.col("_position") - 1, F.lit(shards)).cast("int")).drop("_position")


def policy_signatures(selections: DataFrame, group: list[str]) -> DataFrame:
    """Digest of the features chosen at every as-of month (A32); a history is bounded by the as-ofs."""
    history = F.array_sort(F.collect_list(F.struct("as_of_date", "features")))
    return selections.groupBy(*group).agg(F.sha2(F.to_json(history), 256).alias("signature"))


def distinct_policies(signatures: DataFrame, within: list[str], preference: str) -> DataFrame:
    """One policy per signature: equal selection histories need only one run."""
    return signatures.groupBy(*within, "signature").agg(F.min(preference).alias(preference))
