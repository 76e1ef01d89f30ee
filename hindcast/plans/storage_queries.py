"""Artifacts written to the scratch folder and read back, and the checks that guard them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.operators import eda, families, quality
from hindcast.operators import metrics as mt
from hindcast.plans import fixtures as fx
from hindcast.plans.registry import query, r6, rounded, rounded6, with_ctes
from hindcast.plans.stats_queries import feature_panel
from hindcast.session import materialize, scratch_folder
from hindcast.sources import readers as rd
from hindcast.sources import sinks as sk


@query("run_layout", "S7 S11 S2", with_ctes("demand", """
SELECT run_id, series, count(y) AS n_values, count(*) AS n_rows FROM (SELECT 'r1' AS run_id, * FROM demand UNION ALL SELECT 'r2', * FROM demand WHERE y > 1000000) GROUP BY 1, 2
UNION ALL SELECT 'union', series, count(y), count(*) FROM (SELECT series, y FROM demand UNION ALL SELECT series, NULL FROM demand) GROUP BY 2"""))
def run_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs under one folder, found by partition; and a union of runs of which one lacks a column."""
    demand, where = materialize(fx.demand(spark, folder)), scratch_folder(spark)
    sk.write_run(demand, where, "r1")
    sk.write_run(demand.where("y > 1000000"), where, "r2")
    sk.write_run(demand.drop("y"), f"{where}-narrow", "r3")
    counts = (F.count("y").alias("n_values"), F.count("*").alias("n_rows"))
    union = rd.read_union(spark, [f"{where}/run_id=r1", f"{where}-narrow/run_id=r3"]).groupBy("series").agg(*counts)
    return spark.read.parquet(where).groupBy("run_id", "series").agg(*counts).unionByName(union.withColumn("run_id", F.lit("union")))


@query("artifact_fallback", "S20 S10", with_ctes("demand", "SELECT 'flat' AS artifact, count(*) AS n FROM demand UNION ALL SELECT 'full', count(*) FROM demand WHERE y IS NOT NULL UNION ALL SELECT 'absent', 0"))
def artifact_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """The full table where it exists, else the flat one, else a typed empty one."""
    demand, where = materialize(fx.demand(spark, folder)), scratch_folder(spark)
    sk.write_parquet(demand.where("y IS NOT NULL"), f"{where}/full")
    sk.write_parquet(demand, f"{where}/flat")
    found = {
        "full": rd.read_first(spark, [f"{where}/full", f"{where}/flat"]),
        "flat": rd.read_first(spark, [f"{where}/none", f"{where}/flat"]),
        "absent": rd.read_or_empty(spark, f"{where}/none", demand.schema),
    }
    one, two, three = (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("artifact"), "n") for name, df in found.items())
    return one.union(two).union(three)


@query("csv_roundtrip", "S12", with_ctes("demand", "SELECT series, date, CAST(n AS BIGINT) AS n FROM demand WHERE n IS NOT NULL"))
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    where = scratch_folder(spark)
    fx.demand(spark, folder).where("n IS NOT NULL").select("series", "date", "n").write.csv(where, header=True)
    return rd.read_csv(spark, where, "series string, date date, n bigint")


@query("top_csv", "S21 T2", with_ctes("metrics", f"""
SELECT rank, config_id, {r6('selection_score', 'selection_score')} FROM (SELECT *, row_number() OVER (ORDER BY selection_score, model_config_id) AS rank FROM metrics WHERE evaluation_scope = 'overall') WHERE rank <= 25"""))
def top_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The 25 best configurations as a CSV file, read back."""
    where = scratch_folder(spark)
    overall = mt.backtest_metrics(fx.predictions(spark, folder), in_order=True).where("evaluation_scope = 'overall'")
    sk.write_top_csv(overall.select("config_id", "model_config_id", "selection_score"), where)
    fields = {f.name: f.dataType.simpleString() for f in spark.read.csv(where, header=True).schema.fields}
    kinds = {"selection_score": "double", "rank": "bigint"}
    back = rd.read_csv(spark, where, ", ".join(f"{c} {kinds.get(c, t)}" for c, t in fields.items()))
    return rounded6(back.select("rank", "config_id", "selection_score"))


@query("document_roundtrip", "S5", with_ctes("champ", "SELECT model_config_id, 'champion' AS artifact FROM champ"))
def document_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The champion as a JSON document, read back."""
    where = scratch_folder(spark)
    best = mt.champion(materialize(mt.backtest_metrics(fx.predictions(spark, folder), in_order=True)))
    sk.write_document(best.select("model_config_id", F.lit("champion").alias("artifact")), where)
    return sk.read_document(spark, where, "model_config_id string, artifact string")


@query("exported_view", "S14", with_ctes("demand", "SELECT series, count(*) AS n, (SELECT count(*) FROM demand) AS exported FROM demand GROUP BY 1"))
def exported_view(spark: SparkSession, folder: str) -> DataFrame:
    """A view as Parquet with the row count observed while it was written."""
    where = scratch_folder(spark)
    fx.demand(spark, folder).createOrReplaceTempView("hindcast_exported")
    rows = sk.export(spark, "hindcast_exported", where)
    return spark.read.parquet(where).groupBy("series").agg(F.count("*").alias("n")).withColumn("exported", F.lit(rows).cast("bigint"))


@query("monthly_scan", "S1 P1", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS n, count(DISTINCT o_orderkey) AS n_orders FROM orders GROUP BY 1")
def monthly_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Daily rows stored as they are; the scan checks the columns and floors the dates."""
    where = scratch_folder(spark)
    spark.read.parquet(f"{folder}/orders.parquet").select(F.col("o_orderdate").alias("date"), "o_orderkey").write.parquet(where)
    return rd.read_monthly(spark, where, ["date", "o_orderkey"]).groupBy("date").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_orders"))


def _problems(spark: SparkSession, problems: list[str], df: DataFrame) -> DataFrame:
    """Found problems beside the size of the table they were found in."""
    rows = F.explode(F.array(*[F.lit(p) for p in problems]).cast("array<string>")).alias("problem")
    return df.agg(F.count("*").alias("table_rows")).select(rows, "table_rows")


@query("artifact_problems", "Q5", with_ctes("demand", "SELECT unnest(['metrics: missing', 'facts: missing columns [''prediction'']', 'none: empty']) AS problem, (SELECT count(*) FROM demand) AS table_rows"))
def artifact_problems(spark: SparkSession, folder: str) -> DataFrame:
    demand = materialize(fx.demand(spark, folder))
    found = quality.artifact_violations({"facts": demand, "none": demand.where("y < 0")}, {"metrics": ["mae"], "facts": ["series", "y", "prediction"], "none": ["y"]})
    return _problems(spark, found, demand)


@query("family_problems", "Q8 U4", with_ctes("fpanel", "SELECT unnest(['unknown family missing', 'wide: unavailable columns [''y_lag99'']']) AS problem, (SELECT count(*) FROM fpanel) AS table_rows"))
def family_problems(spark: SparkSession, folder: str) -> DataFrame:
    panel = feature_panel(spark, folder)
    found = quality.family_violations({"good": ["y_lag1"], "wide": ["y_lag1", "y_lag99"]}, ["good", "wide", "missing"], panel.columns)
    return _problems(spark, found, panel)


@query("feature_contract", "Q7 Q1", with_ctes("fpanel", "SELECT series, date, 'duplicate date' AS violation, CAST(2 AS BIGINT) AS rows FROM fpanel WHERE date < DATE '1996-01-01'"))
def feature_contract(spark: SparkSession, folder: str) -> DataFrame:
    """A feature table whose first year was appended twice breaks its contract there."""
    features = feature_panel(spark, folder).withColumnRenamed("target", "y_target_h3")
    twice = features.unionByName(features.where("date < DATE '1996-01-01'"))
    return rounded(quality.feature_table_violations(twice, ["series"], "y", 3))


@query("imputation_activity", "A27", with_ctes("demand", f"""
SELECT variable, sum(v) AS active_rows, {r6('avg(v) * 100', 'active_pct')} FROM (
  SELECT 'is_missing' AS variable, CAST(y IS NULL AS BIGINT) AS v FROM demand UNION ALL SELECT 'is_large', CAST(coalesce(y > 1000000, false) AS BIGINT) FROM demand) GROUP BY 1""".replace("sum(v)", "CAST(sum(v) AS BIGINT)")))
def imputation_activity(spark: SparkSession, folder: str) -> DataFrame:
    flags = fx.demand(spark, folder).select(F.col("y").isNull().cast("double").alias("is_missing"), F.coalesce(F.col("y") > 1000000, F.lit(False)).cast("double").alias("is_large"))
    return rounded6(eda.imputation_activity(flags, ["is_missing", "is_large"]))


@query("composed_families", "P18", with_ctes("fpanel", "\nUNION ALL ".join(
    f"SELECT '{family}' AS feature_family_name, {i}::BIGINT AS position, '{c}' AS feature, count({c}) AS n_values FROM fpanel"
    for family, cs in {"lags": ["y_lag1", "y_lag12"], "both": ["y_lag1", "y_lag12", "y_rollmean_3"]}.items() for i, c in enumerate(cs))))
def composed_families(spark: SparkSession, folder: str) -> DataFrame:
    """Families put together from groups of columns, a repeated column once, with the values the panel has."""
    made = families.compose_families({"near": ["y_lag1"], "far": ["y_lag12", "y_lag1"], "smooth": ["y_rollmean_3"]}, {"lags": ["near", "far"], "both": ["near", "far", "smooth"]})
    frame = families.families_frame(spark, made)
    counts = feature_panel(spark, folder).agg(*[F.count(c).alias(c) for c in ("y_lag1", "y_lag12", "y_rollmean_3")])
    long = counts.unpivot([], ["y_lag1", "y_lag12", "y_rollmean_3"], "feature", "n_values")
    return rounded(frame.join(long, "feature").select("feature_family_name", "position", "feature", "n_values"))
