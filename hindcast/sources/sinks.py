"""Sinks and table layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.functions.scalar import path_safe
from hindcast.operators.bundle import partition_manifest
from hindcast.operators.explore import top_rows
from hindcast.operators.metrics import champion, family_summary, rolling_error


def write_parquet(df: DataFrame, uri: str, mode: str = "overwrite") -> int:
    """Write and return the row count observed during the write, without a second pass."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(uri)
    return seen.get["rows"]


def write_run(df: DataFrame, uri: str, run_id: str) -> int:
    """Append one run under ``run_id=<id>/``."""
    return write_parquet(df, f"{uri}/run_id={run_id}")


def write_by_build(df: DataFrame, uri: str, dataset: str, column: str = "model_build", key: str = "model_config_id") -> DataFrame:
    """Hive-partitioned dataset with path-safe folders, and its manifest.

    The rebalance hint groups rows by partition value for few files, and lets adaptive execution split a
    value that holds a large share of the rows over several tasks.
    """
    ids = {c: F.col(c).cast("string") for c in ("config_id", "model_config_id", "source_model_config_id") if c in df.columns}
    source = df.withColumns(ids)
    if column not in source.columns:
        source = source.withColumn(column, F.lit("unknown"))
    manifest = partition_manifest(source, dataset, column, key)
    safe = source.withColumn(column, path_safe(column))
    safe.hint("rebalance", F.col(column)).write.mode("overwrite").partitionBy(column).parquet(uri)
    return manifest


def only_row(df: DataFrame) -> DataFrame:
    """The row of a document; fails if there is a second one, and stays empty without any."""
    two = df.limit(2).coalesce(1)
    counted = two.withColumn("_rows", F.count("*").over(Window.partitionBy()))
    return counted.where(F.assert_true(F.col("_rows") == 1, F.lit("a document has one row")).isNull()).drop("_rows")


def write_document(df: DataFrame, uri: str) -> None:
    """A one-row document such as a manifest or champion as JSON."""
    only_row(df).write.mode("overwrite").json(uri)


def read_document(spark: SparkSession, uri: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(uri)


def document_rows(documents: dict[str, DataFrame]) -> DataFrame:
    """Documents as (artifact_name, payload_json) rows."""
    parts = [only_row(d).select(F.lit(n).alias("artifact_name"), F.to_json(F.struct("*")).alias("payload_json")) for n, d in documents.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


RUN_FIELDS = {
    "experiment_id": ["experiment", "batch", "champion"],
    "pipeline_run_id": ["experiment", "batch", "champion"],
    "target": ["experiment", "champion"],
    "horizon": ["experiment", "champion"],
    "as_of_start": ["experiment", "batch"],
    "as_of_end": ["experiment", "batch"],
    "model_count": ["batch"],
    "prediction_count": ["batch"],
}


def experiment_run(documents: dict[str, DataFrame]) -> DataFrame:
    """One row per experiment: each field from the first document that has it (S19). Documents have one row."""
    spark = next(iter(documents.values())).sparkSession
    row = spark.range(1)
    for name, document in documents.items():
        row = row.withColumn(f"_{name}", document.select(F.struct("*")).scalar())
    available = {n: set(d.columns) for n, d in documents.items()}

    def pick(field: str, sources: list[str], rename: str | None = None) -> Column:
        present = [F.col(f"_{s}.{field}").cast("string") for s in sources if field in available.get(s, set())]
        return F.coalesce(*present, F.lit(None).cast("string")).alias(rename or field)

    return row.select(
        *[pick(f, s) for f, s in RUN_FIELDS.items()],
        pick("model_config_id", ["champion"], "champion_model_config_id"),
        pick("selection_score", ["champion"], "champion_selection_score"),
        *[F.to_json(f"_{n}").alias(f"{n}_json") for n in documents],
    )


def merge_missing_counts(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Fill only the NULL or absent fields of one row from another."""
    names = [*primary.columns, *[c for c in fallback.columns if c not in primary.columns]]
    row = only_row(primary).select(F.struct("*").alias("_p")).withColumn("_f", fallback.select(F.struct("*")).scalar())

    def field(name: str) -> Column:
        sides = [F.col(f"{side}.{name}") for side, cols in (("_p", primary.columns), ("_f", fallback.columns)) if name in cols]
        return F.coalesce(*sides).alias(name)

    return row.select(*[field(n) for n in names])


def write_top_csv(leaderboard: DataFrame, uri: str, n: int = 25) -> None:
    """The best rows and nothing else as one CSV file (S21); the row count bounds the single file."""
    top_rows(leaderboard.drop("rank"), "selection_score", True, n).orderBy("rank").coalesce(1).write.mode("overwrite").csv(uri, header=True)


def write_summary_csv(summary: DataFrame, uri: str) -> None:
    summary.coalesce(1).write.mode("overwrite").csv(uri, header=True)


# --- mart (S13) ------------------------------------------------------------------------------------

MART_VIEWS = [
    "forecast_paths", "performance_over_time", "model_leaderboard", "champion_predictions", "overview_top_models",
    "overview_prediction_paths", "feature_family_summary_dashboard", "complexity_profile_dashboard",
]


def register_mart(spark: SparkSession, tables: dict[str, DataFrame]) -> list[str]:
    """Temporary views for tables, and derived views unless a ``source_dashboard_<name>`` overrides them.

    Ranks are explicit columns: no view relies on the order of its rows.
    """
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    predictions, metrics = tables["predictions"], tables["metrics"]
    overall = metrics.where(F.col("evaluation_scope") == "overall")
    top = top_rows(overall.drop("rank"), "selection_score", True, 5)
    derived = {
        "forecast_paths": predictions,
        "performance_over_time": rolling_error(predictions),
        "model_leaderboard": overall,
        "champion_predictions": predictions.where(
            F.col("model_config_id") == champion(metrics).select("model_config_id").scalar()
        ),
        "overview_top_models": top,
        "overview_prediction_paths": predictions.join(top.select("model_config_id"), "model_config_id", "left_semi"),
        "feature_family_summary_dashboard": family_summary(metrics),
    }
    if "complexity_profile" in tables:
        derived["complexity_profile_dashboard"] = tables["complexity_profile"]
    made = []
    for name, df in derived.items():
        override = f"source_dashboard_{name}"
        (spark.table(override) if spark.catalog.tableExists(override) else df).createOrReplaceTempView(name)
        made.append(name)
    return made


def export(spark: SparkSession, name: str, uri: str) -> int:
    """A registered table or view as Parquet, with its row count."""
    return write_parquet(spark.table(name), uri)
