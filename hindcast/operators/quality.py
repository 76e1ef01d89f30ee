"""Data-quality checks that return violation rows, and tolerance-aware table differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.calendar import months_apart
from hindcast.operators.panel import missing_months


class QualityError(ValueError):
    """Raised when a check that must hold has violations."""


def must_be_empty(violations: DataFrame, message: str) -> None:
    """Fail with a few example rows; only those reach the driver."""
    examples = violations.take(5)
    if examples:
        raise QualityError(f"{message}: {[r.asDict() for r in examples]}")


def date_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """NULL and duplicate dates (Q1): (keys, date, violation, rows)."""
    return (
        df.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("date").isNull() | (F.col("rows") > 1))
        .withColumn("violation", F.when(F.col("date").isNull(), "null date").otherwise("duplicate date"))
    )


def continuity_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Missing months between first and last row (Q2)."""
    return missing_months(df.where(F.col("date").isNotNull()), keys).withColumn("violation", F.lit("missing month"))


def missing_month_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        (months_apart(F.min("date"), F.max("date")) + 1 - F.count_distinct("date")).alias("missing_months")
    )


def null_counts(df: DataFrame, columns: list[str], stage: str) -> DataFrame:
    """NULL count per column in one pass (Q3, Q4)."""
    counts = df.agg(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.sum(F.col(c).isNull().cast("bigint")).alias("nulls")) for c in columns]).alias("_c")
    )
    return counts.select(F.lit(stage).alias("stage"), F.explode("_c").alias("c")).select("stage", "c.*")


def null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    return null_counts(df, columns, "check").where(F.col("nulls") > 0).drop("stage")


def stage_nulls(stages: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """NULL counts before and after each preparation step (Q4)."""
    return reduce(lambda a, b: a.unionByName(b), [null_counts(df, columns, name) for name, df in stages.items()])


def artifact_violations(artifacts: dict[str, DataFrame], required: dict[str, list[str]]) -> list[str]:
    """Missing tables, missing columns and empty tables (Q5); reads at most one row per table."""
    problems = []
    for name, columns in required.items():
        if name not in artifacts:
            problems.append(f"{name}: missing")
            continue
        absent = sorted(set(columns) - set(artifacts[name].columns))
        if absent:
            problems.append(f"{name}: missing columns {absent}")
        if not artifacts[name].take(1):
            problems.append(f"{name}: empty")
    return problems


def manifest_violations(df: DataFrame, manifest: DataFrame, partition: str = "model_build", key: str = "model_config_id") -> DataFrame:
    """Partitions whose rows or configurations differ from the manifest (Q6)."""
    actual = df.groupBy(F.col(partition).alias("value")).agg(
        F.count(F.lit(1)).alias("actual_rows"), F.count_distinct(key).alias("actual_configs")
    )
    stated = manifest.select("value", F.col("rows").alias("stated_rows"), F.col("configs").alias("stated_configs"))
    joined = stated.join(actual, "value", "full")
    same = F.col("actual_rows").eqNullSafe(F.col("stated_rows")) & F.col("actual_configs").eqNullSafe(F.col("stated_configs"))
    return joined.where(~same)


def total_matches(manifest: DataFrame, df: DataFrame) -> DataFrame:
    """Whether partition rows add up to the dataset (Q6)."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return manifest.agg(F.sum("rows").alias("manifest_rows")).withColumn("dataset_rows", total).withColumn(
        "matches", F.col("manifest_rows") == F.col("dataset_rows")
    )


def feature_table_violations(df: DataFrame, keys: list[str], target: str, horizon: int) -> DataFrame:
    """Contract of a feature table: date and target columns exist (raises), dates are unique (Q7)."""
    column = f"{target}_target_h{horizon}"
    absent = sorted({"date", column} - set(df.columns))
    if absent:
        raise QualityError(f"the feature table is missing {absent}")
    return date_violations(df, keys)


def family_violations(families: dict[str, list[str]], wanted: list[str], columns: list[str]) -> list[str]:
    """Unknown families and unavailable columns (Q8, U4)."""
    problems = [f"unknown family {name}" for name in sorted(set(wanted) - set(families))]
    for name in wanted:
        absent = sorted(set(families.get(name, [])) - set(columns))
        if absent:
            problems.append(f"{name}: unavailable columns {absent}")
    return problems


def alignment_violations(df: DataFrame, date: str, target_date: str, horizon: int) -> DataFrame:
    """Rows whose target month is not ``horizon`` months ahead (Q9)."""
    return df.where(~months_apart(date, target_date).eqNullSafe(F.lit(horizon)))


def table_diff(left: DataFrame, right: DataFrame, key: list[str], atol: float = 1e-9, rtol: float = 1e-9) -> DataFrame:
    """Cells that differ beyond a tolerance, and rows present on one side only.

    Numbers compare as |a-b| > atol + rtol*|b|; other values must be equal, NULL equals NULL.
    """
    columns = [c for c in left.columns if c in set(right.columns) and c not in key]
    numeric = {f.name for f in left.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")}
    a = left.select(*key, F.struct(*columns).alias("_a"))
    b = right.select(*key, F.struct(*columns).alias("_b"))
    joined = a.join(b, key, "full")
    only = F.when(F.col("_a").isNull(), "right only").when(F.col("_b").isNull(), "left only")
    cells = []
    for c in columns:
        x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        if c in numeric:
            near = F.abs(x.cast("double") - y.cast("double")) <= F.lit(atol) + F.lit(rtol) * F.abs(y.cast("double"))
            same = F.coalesce(near, x.isNull() & y.isNull())
        else:
            same = x.eqNullSafe(y)
        cells.append(F.when(~same, F.struct(F.lit(c).alias("column_name"), x.cast("string").alias("left_value"), y.cast("string").alias("right_value"))))
    whole = F.array(F.struct(F.lit("*").alias("column_name"), F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value")))
    differing = F.when(only.isNotNull(), whole).otherwise(F.array_compact(F.array(*cells)))
    return joined.select(*key, only.alias("side"), F.explode(differing).alias("c")).select(
        *key, F.coalesce("side", F.lit("both")).alias("side"), "c.*"
    )
