"""Scans (S1, S3, S4, S9-S12, S20)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.functions.calendar import month_floor
from hindcast.functions.scalar import to_number
from hindcast.operators.reshape import require_columns

OBSERVATION_SCHEMA = (
    "source_name string, provider string, pulled_at_utc string, "
    "series map<string, struct<series_id string, response struct<observations array<struct<date string, value string>>>>>"
)


def read_monthly(spark: SparkSession, uri: str, required: list[str]) -> DataFrame:
    """Parquet with a month-floored ``date`` and checked columns."""
    df = require_columns(spark.read.parquet(uri), required, uri)
    return df.withColumn("date", month_floor("date"))


def read_csv(spark: SparkSession, uri: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header and a declared schema: no inference pass."""
    return spark.read.csv(uri, header=True, schema=schema)


def read_observations(spark: SparkSession, uri: str) -> DataFrame:
    """Nested observation JSON as rows (source_name, series, date, value) (S3)."""
    raw = spark.read.schema(OBSERVATION_SCHEMA).json(uri, multiLine=True)
    return explode_observations(raw)


def explode_observations(raw: DataFrame) -> DataFrame:
    """Map of series to observation arrays → long form; unreadable values become NULL."""
    per_series = raw.select("source_name", F.explode("series").alias("series", "body"))
    cells = per_series.select("source_name", "series", F.explode("body.response.observations").alias("o"))
    return cells.select("source_name", "series", F.col("o.date").try_cast("date").alias("date"), to_number("o.value").alias("value"))


def observations_wide(long: DataFrame, names: list[str]) -> DataFrame:
    """One column per series; a month with a missing value keeps its row."""
    return long.where(F.col("date").isNotNull()).groupBy("date").pivot("series", names).agg(F.first("value", ignorenulls=True))


def read_union(spark: SparkSession, uris: list[str]) -> DataFrame:
    """Union of the same table from several runs; columns missing in one are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(u) for u in uris])


def path_exists(spark: SparkSession, uri: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_or_empty(spark: SparkSession, uri: str, schema: str | T.StructType) -> DataFrame:
    """The table, or an empty one of the declared schema when the artifact is absent."""
    if path_exists(spark, uri):
        return spark.read.parquet(uri)
    return spark.createDataFrame([], schema)


def read_first(spark: SparkSession, uris: list[str]) -> DataFrame:
    """The first artifact that exists, e.g. the full table before the cut one."""
    for uri in uris:
        if path_exists(spark, uri):
            return spark.read.parquet(uri)
    raise FileNotFoundError(f"none of {uris} exists")


def read_partitions(spark: SparkSession, uri: str, column: str, values: list[str] | None, ids: DataFrame | None, key: str = "config_id") -> DataFrame:
    """Only the chosen partition folders and the wanted configurations.

    The partition filter prunes folders before any file is opened; the id list joins as a semi join
    whose strategy follows its measured size.
    """
    df = spark.read.option("mergeSchema", True).option("basePath", uri).parquet(uri)
    if values is not None:
        df = df.where(F.col(column).isin(values))
    return df if ids is None else df.join(ids.select(key).distinct(), key, "left_semi")


# Schema of a feature-importance table without rows.
IMPORTANCE_SCHEMA = (
    "feature_name string, importance_type string, importance double, importance_abs double, experiment_id string, "
    "pipeline_run_id string, model_run_id string, model_config_id string, prediction_id string, config_id string, "
    "as_of_date string, model_family string, model_build string, model_type string, mode string, "
    "feature_family_name string, feature_policy string, feature_set_id string, rank bigint"
)
