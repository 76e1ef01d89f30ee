"""Grids, families, quality checks, change detection, mart and storage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions.ids import payload_digest
from hindcast.operators import bundle as bd
from hindcast.operators import eda
from hindcast.operators import families as fam
from hindcast.operators import grid as gr
from hindcast.operators import metrics as mt
from hindcast.operators import quality as qa
from hindcast.operators.features import horizon_columns
from hindcast.operators.panel import series_window, to_monthly
from hindcast.plans import fixtures as fx
from hindcast.plans.registry import cte, query, r4, rounded, table, with_ctes
from hindcast.session import materialize, scratch_folder
from hindcast.sources import changes as ch
from hindcast.sources import readers as rd
from hindcast.sources import sinks as sk

# --- grids -----------------------------------------------------------------------------------------

MODELS = [("naive", {}), ("ridge", {"alpha": 1.0}), ("lasso", {"alpha": 100.0, "max_iter": 5000}), ("random_forest", {"n_estimators": 100}), ("xgboost", {"max_depth": 3, "n_estimators": 100})]
POLICIES = ["none", "corr_pruned", "tree_top_20"]
TRANSFORMS = ["identity", "quadratic"]
cte("grid", "", """
  SELECT DISTINCT f.fam AS feature_family_name, m.t AS model_type, m.p AS params_text, mode,
         CASE WHEN pol = 'corr_pruned' AND m.t NOT IN ('ridge', 'lasso') THEN 'none' WHEN pol = 'tree_top_20' AND m.t NOT IN ('random_forest', 'xgboost') THEN 'none' ELSE pol END AS feature_policy,
         CASE WHEN m.t IN ('ridge', 'lasso') THEN tr ELSE 'identity' END AS feature_transform
  FROM (SELECT DISTINCT p_brand || '_' || p_type AS fam FROM part) f,
       (VALUES ('ridge', 'alpha-1.0'), ('lasso', 'alpha-100.0_max_iter-5000'), ('random_forest', 'n_estimators-100'), ('xgboost', 'max_depth-3_n_estimators-100')) m(t, p),
       (VALUES ('raw'), ('residual')) a(mode), (VALUES ('none'), ('corr_pruned'), ('tree_top_20')) b(pol), (VALUES ('identity'), ('quadratic')) c(tr)
  UNION ALL SELECT 'baseline_naive', 'naive', '', 'raw', 'none', 'identity'""")


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    families = table(spark, folder, "part").select(F.concat_ws("_", "p_brand", "p_type").alias("feature_family_name"))
    return gr.expand_grid(families, MODELS, ["raw", "residual"], POLICIES, TRANSFORMS)


@query("grid_expand", "B1 J13 X7 U2", with_ctes("grid", """
SELECT model_type, mode, feature_family_name, feature_policy, feature_transform,
       model_type || '__' || mode || '__' || feature_family_name || CASE WHEN feature_policy <> 'none' THEN '__policy-' || feature_policy ELSE '' END
       || CASE WHEN feature_transform <> 'identity' THEN '__transform-' || feature_transform ELSE '' END || CASE WHEN params_text <> '' THEN '__' || params_text ELSE '' END AS config_id
FROM grid"""))
def grid_expand(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder).drop("params")


@query("plan_counts", "B3 W28", with_ctes("grid", """
SELECT model_type, count(*) AS model_config_count, count(DISTINCT feature_family_name) AS feature_family_count, count(DISTINCT mode) AS mode_count,
       count(DISTINCT feature_policy) AS feature_policy_count, count(*) * 180 AS estimated_model_run_rows FROM grid GROUP BY 1"""))
def plan_counts(spark: SparkSession, folder: str) -> DataFrame:
    return gr.plan_counts(_grid(spark, folder), 180)


@query("task_shards", "B4 W22", with_ctes("pred", """
SELECT config_id, (row_number() OVER (ORDER BY config_id) - 1) % 7 AS shard FROM (SELECT DISTINCT config_id FROM pred)"""))
def task_shards(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(gr.shard(fx.predictions(spark, folder).select("config_id").distinct(), "config_id", 7))


@query("policy_signatures", "A32", with_ctes("pred", """
SELECT feature_policy, count(*) AS policies, min(config_id) AS config_id FROM (
  SELECT config_id, feature_policy, string_agg(strftime(as_of_date, '%Y-%m-%d') || mode || feature_policy, ',' ORDER BY as_of_date) AS sig FROM pred GROUP BY 1, 2) GROUP BY feature_policy, sig"""))
def policy_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Configurations with the same choice at every as-of month collapse to one."""
    chosen = fx.predictions(spark, folder).select("config_id", "feature_policy", "as_of_date", F.array("mode", "feature_policy").alias("features"))
    signed = gr.policy_signatures(chosen, ["config_id", "feature_policy"])
    return signed.groupBy("feature_policy", "signature").agg(F.count(F.lit(1)).alias("policies"), F.min("config_id").alias("config_id")).drop("signature")


# --- families --------------------------------------------------------------------------------------

cte("fams", "", """
  SELECT p_brand AS fam, CASE WHEN p_size % 5 = 0 THEN 'gas_' WHEN p_size % 7 = 0 THEN 'service_' ELSE 'y_' END || lower(p_type)
         || CASE WHEN p_size % 3 = 0 THEN '_lag' WHEN p_size % 3 = 1 THEN '_rollmean_' ELSE '_x_event_active_' END || (p_size % 12) AS feature,
         min(p_partkey) AS position FROM part GROUP BY 1, 2""")


def _families(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    start = F.when(size % 5 == 0, "gas_").when(size % 7 == 0, "service_").otherwise("y_")
    middle = F.when(size % 3 == 0, "_lag").when(size % 3 == 1, "_rollmean_").otherwise("_x_event_active_")
    name = F.concat(start, F.lower("p_type"), middle, (size % 12).cast("string"))
    return table(spark, folder, "part").groupBy(F.col("p_brand").alias("feature_family_name"), name.alias("feature")).agg(F.min("p_partkey").alias("position"))


_KNOWN = [f"y_{t}_lag{k}" for t in ("economy", "standard", "promo") for k in range(12)]


@query("family_audit", "B21 P19 U4", with_ctes("fams", f"""
SELECT fam AS feature_family_name, count(*) AS requested_features, count(*) FILTER (WHERE feature IN ({', '.join(f"'{k}'" for k in _KNOWN)})) AS available_features,
       string_agg(feature, ',' ORDER BY position, feature) FILTER (WHERE feature NOT IN ({', '.join(f"'{k}'" for k in _KNOWN)})) AS missing FROM fams GROUP BY 1"""))
def family_audit(spark: SparkSession, folder: str) -> DataFrame:
    audit = fam.family_audit(_families(spark, folder), _KNOWN)
    return rounded(audit.withColumn("missing", F.array_join("missing_features", ",")).drop("missing_features"))


def _mark(*tokens: str) -> str:
    return "bool_or(" + " OR ".join(f"contains(feature, '{t}')" for t in tokens) + ")"


cte("fam_lists", "fams", f"""
  SELECT fam, '[' || string_agg('"' || feature || '"', ', ' ORDER BY feature) || ']' AS js, count(*) AS n, {_mark('lag')} AS l, {_mark('roll')} AS r, {_mark('gas', 'cpi', 'inflation', 'income')} AS e,
         {_mark('service')} AS s, {_mark('interact', '_x_')} AS x, {_mark('event_active')} AS g FROM fams GROUP BY 1""")


@query("feature_sets", "B20 P20 P21 X6 X10", with_ctes("fam_lists", """
SELECT fam AS feature_family_name, mode, fam || '__' || mode || '__none__identity__' || substr(sha1('{"feature_family_name": "' || fam || '", "feature_names": ' || js
         || ', "feature_policy": "none", "feature_transform": "identity", "mode": "' || mode || '"}'), 1, 12) AS feature_set_id,
       n AS feature_count, sha1(js) AS feature_hash, l AS includes_lags, r AS includes_rolling, e AS includes_exogenous, s AS includes_service, x AS includes_interactions,
       g AS includes_regime, CASE WHEN g THEN 'pandemic_observed' ELSE 'none' END AS regime_policy
FROM fam_lists, (VALUES ('raw'), ('residual')) m(mode)"""))
def feature_sets(spark: SparkSession, folder: str) -> DataFrame:
    sets = fam.feature_sets(_families(spark, folder), ["raw", "residual"], ["none"], ["identity"], "exp", ["event_active"])
    return rounded(
        sets.select(
            "feature_family_name", "mode", "feature_set_id", "feature_count", "feature_hash", "includes_lags", "includes_rolling",
            "includes_exogenous", "includes_service", "includes_interactions", "includes_regime", "regime_policy",
        )
    )


# --- quality ---------------------------------------------------------------------------------------


@query("date_violations", "Q1 Q7", """
SELECT o_custkey AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS rows, 'duplicate date' AS violation FROM orders GROUP BY 1, 2 HAVING count(*) > 1""")
def date_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Raw orders seen as a monthly table per customer: months with several rows violate the grain."""
    from hindcast.functions.calendar import month_floor

    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("series"), month_floor("o_orderdate").alias("date"))
    return qa.date_violations(rows, ["series"])


cte("cust_months", "", "SELECT o_custkey AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1, 2")


def _customer_months(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "series")
    return to_monthly(orders, ["series"], "o_orderdate", {"n": F.count(F.lit(1))})


@query("missing_months", "Q2 J10", with_ctes("cust_months", """
SELECT series, CAST(d AS DATE) AS date, 'missing month' AS violation FROM (SELECT series, unnest(generate_series(min(date), max(date), INTERVAL 1 MONTH)) AS d FROM cust_months GROUP BY 1) s
WHERE NOT EXISTS (SELECT 1 FROM cust_months c WHERE c.series = s.series AND c.date = CAST(s.d AS DATE))"""))
def missing_months(spark: SparkSession, folder: str) -> DataFrame:
    return qa.continuity_violations(_customer_months(spark, folder), ["series"])


@query("missing_month_counts", "Q2", with_ctes("cust_months", """
SELECT series, (year(max(date)) - year(min(date))) * 12 + month(max(date)) - month(min(date)) + 1 - count(DISTINCT date) AS missing_months FROM cust_months GROUP BY 1"""))
def missing_month_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(qa.missing_month_counts(_customer_months(spark, folder), ["series"]))


@query("stage_nulls", "Q3 Q4 P24", with_ctes("demand", """
SELECT 'spine' AS stage, 'y' AS column_name, count(*) - count(y) AS nulls FROM demand UNION ALL SELECT 'spine', 'n', count(*) - count(n) FROM demand
UNION ALL SELECT 'trimmed', 'y', count(*) - count(y) FROM t UNION ALL SELECT 'trimmed', 'n', count(*) - count(n) FROM t""").replace("\nSELECT 'spine'", """, t AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS rn FROM demand) WHERE rn > 16)
SELECT 'spine'""", 1))
def stage_nulls(spark: SparkSession, folder: str) -> DataFrame:
    from hindcast.operators.panel import trim_leading

    demand = fx.demand(spark, folder)
    return qa.stage_nulls({"spine": demand, "trimmed": trim_leading(demand, ["series"], 16)}, ["y", "n"])


@query("rows_with_gaps", "P24", with_ctes("demand", "SELECT series, date FROM demand WHERE y IS NULL OR n IS NULL"))
def rows_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    from hindcast.operators.reshape import rows_with_gaps as gaps

    return gaps(fx.demand(spark, folder), ["y", "n"]).select("series", "date")


@query("manifest_check", "Q6 S8", with_ctes("pred", """
SELECT model_build AS value, count(*) AS actual_rows, count(DISTINCT model_config_id) AS actual_configs, count(*) + 1 AS stated_rows, count(DISTINCT model_config_id) AS stated_configs
FROM pred WHERE model_build = 'ridge' GROUP BY 1"""))
def manifest_check(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest with one wrong row count is caught for exactly that partition."""
    facts = fx.predictions(spark, folder)
    manifest = bd.partition_manifest(facts, "paths")
    wrong = manifest.withColumn("rows", F.col("rows") + F.when(F.col("value") == "ridge", 1).otherwise(0))
    return qa.manifest_violations(facts, wrong)


@query("manifest_total", "Q6", with_ctes("pred", "SELECT count(*) AS manifest_rows, count(*) AS dataset_rows, true AS matches FROM pred"))
def manifest_total(spark: SparkSession, folder: str) -> DataFrame:
    facts = fx.predictions(spark, folder)
    return qa.total_matches(bd.partition_manifest(facts, "paths"), facts)


@query("target_alignment", "Q9 W7", with_ctes("supply", """
SELECT series, date, CAST(date + INTERVAL 3 MONTH AS DATE) AS target_date_h3 FROM supply WHERE month(date) = 2"""))
def target_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Rows are checked against another horizon in February, so exactly those violate it."""
    w = series_window(["series"])
    rows = fx.supply(spark, folder).withColumn("target_date_h3", horizon_columns("y", 3, w)["target_date_h3"])
    february = qa.alignment_violations(rows.where(F.month("date") == 2), "date", "target_date_h3", 4)
    others = qa.alignment_violations(rows.where(F.month("date") != 2), "date", "target_date_h3", 3)
    return february.unionByName(others).select("series", "date", "target_date_h3")


@query("table_diff", "J14", with_ctes("supply", """
SELECT series, date, 'both' AS side, 'y' AS column_name FROM supply WHERE n % 5 = 4 AND date <> DATE '1999-01-01'
UNION ALL SELECT series, date, 'left only', '*' FROM supply WHERE date = DATE '1999-01-01'"""))
def table_diff(spark: SparkSession, folder: str) -> DataFrame:
    """A copy with changed cells and a missing month; changes below the tolerance do not count."""
    left = fx.supply(spark, folder)
    moved = F.col("y") + F.when(F.col("n") % 5 == 4, 1.0).otherwise(1e-12)
    right = left.withColumn("y", moved).where(F.col("date") != F.lit("1999-01-01").cast("date"))
    return qa.table_diff(left, right, ["series", "date"]).select("series", "date", "side", "column_name")


@query("month_difference", "U4", """
SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS date FROM lineitem EXCEPT SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) FROM orders""")
def month_difference(spark: SparkSession, folder: str) -> DataFrame:
    from hindcast.functions.calendar import month_floor

    lines = table(spark, folder, "lineitem").select(month_floor("l_shipdate").alias("date"))
    return lines.distinct().subtract(table(spark, folder, "orders").select(month_floor("o_orderdate").alias("date")))


@query("first_last_best", "U2", """
SELECT o_custkey, min(o_orderkey) AS orders_first, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY 1
""".replace("arg_min(o_orderkey, (o_totalprice, o_orderkey))", "first(o_orderkey ORDER BY o_totalprice, o_orderkey)"))
def first_last_best(spark: SparkSession, folder: str) -> DataFrame:
    """One row per key by aggregation: a hot key combines map-side instead of sorting in one task."""
    return table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.min("o_orderkey").alias("orders_first"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("cheapest")
    )


# --- change detection and runs ---------------------------------------------------------------------


@query("changed_payloads", "S15 J10 X6", """
SELECT source || '/' || doc_id AS source, sha256(text) AS sha256 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def changed_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts are hashed; stored digests exist for the documents labelled good."""
    current = table(spark, folder, "documents").select(
        "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("source"), payload_digest("text").alias("sha256")
    )
    stored = current.join(table(spark, folder, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return ch.changed(current.drop("doc_id"), stored)


@query("resume_pending", "S16 J10", """
SELECT DISTINCT 'user_' || user_id AS task_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60)""")
def resume_pending(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("task_id", F.concat(F.lit("user_"), F.col("user_id").cast("string")))
    return ch.pending_tasks(events.select("task_id").distinct(), events.where("event_type = 'purchase' AND value > 60"))


@query("checkpoint_log", "S16 U2", """
SELECT task_id, event_type, event_id FROM (SELECT 'user_' || user_id AS task_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def checkpoint_log(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "events").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("task_id"), "event_type", "event_id", F.struct("ts", "event_id").alias("completed_at")
    )
    return ch.latest_per_task(log).select("task_id", "event_type", "event_id")


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat(F.lit("runs/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"), F.lit(".parquet"))
    return table(spark, folder, "events").select(path.alias("path"), F.col("ts").alias("modificationTime"))


@query("complete_runs", "S18", """
SELECT 'runs/' || user_id AS run_dir, max(ts) AS newest FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id HAVING count(DISTINCT event_type) = 2""")
def complete_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Events stand for files written by runs: a run is complete once both kinds exist."""
    return ch.complete_runs(_listing(spark, folder), ["click.parquet", "purchase.parquet"])


@query("latest_file", "S6", """
SELECT 'runs/' || user_id || '/' || event_type || '.parquet' AS path FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, path DESC LIMIT 1""")
def latest_file(spark: SparkSession, folder: str) -> DataFrame:
    return ch.latest_file(_listing(spark, folder), "/purchase.parquet")


@query("step_manifest", "S17", with_ctes("demand_obs", "SELECT 'r1' AS run_id, count(*) AS step_count FROM (SELECT DISTINCT series FROM demand_obs)"))
def step_manifest(spark: SparkSession, folder: str) -> DataFrame:
    steps = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("step")).agg(F.count(F.lit(1)).alias("rows"))
    documents = steps.withColumns({"run_id": F.lit("r1"), "output_uri": F.concat(F.lit("out/"), "step")})
    return ch.step_manifest(documents).drop("steps_json")


# --- storage and mart ------------------------------------------------------------------------------


@query("partition_roundtrip", "S2 S8 S9 S14", with_ctes("pred", f"""
SELECT config_id, as_of_date, {r4('prediction', 'prediction')} FROM pred WHERE model_build IN ('ridge', 'lasso') AND series_key % 5 = 0"""))
def partition_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Paths are stored by build and read back for two builds and some configurations."""
    facts = fx.predictions(spark, folder)
    where = scratch_folder(spark)
    sk.write_by_build(facts, where, "paths")
    ids = facts.where(F.col("series_key") % 5 == 0).select("config_id")
    picked = rd.read_partitions(spark, where, "model_build", ["ridge", "lasso"], ids)
    return rounded(picked.select("config_id", "as_of_date", "prediction"))


@query("mart_views", "S13 J9 T2", with_ctes("metrics champ pred", """
SELECT 'forecast_paths' AS view, count(*) AS rows FROM pred UNION ALL SELECT 'model_leaderboard', count(*) FROM metrics WHERE evaluation_scope = 'overall'
UNION ALL SELECT 'champion_predictions', count(*) FROM pred WHERE config_id IN (SELECT model_config_id FROM champ)
UNION ALL SELECT 'overview_prediction_paths', count(*) FROM pred WHERE config_id IN (SELECT config_id FROM metrics WHERE evaluation_scope = 'overall' ORDER BY selection_score, model_config_id LIMIT 5)
UNION ALL SELECT 'feature_family_summary_dashboard', count(*) FROM (SELECT DISTINCT feature_family_name, mode FROM pred)"""))
def mart_views(spark: SparkSession, folder: str) -> DataFrame:
    facts = materialize(fx.predictions(spark, folder))
    sk.register_mart(spark, {"predictions": facts, "metrics": materialize(mt.backtest_metrics(facts, in_order=True))})
    names = ["forecast_paths", "model_leaderboard", "champion_predictions", "overview_prediction_paths", "feature_family_summary_dashboard"]
    return spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS view, count(*) AS rows FROM {n}" for n in names))


@query("experiment_run", "S19 S5", with_ctes("champ pred", """
SELECT 'exp' AS experiment_id, 'y' AS target, '3' AS horizon, CAST(count(DISTINCT config_id) AS VARCHAR) AS model_count, CAST(count(*) AS VARCHAR) AS prediction_count,
       (SELECT model_config_id FROM champ) AS champion_model_config_id FROM pred"""))
def experiment_run(spark: SparkSession, folder: str) -> DataFrame:
    facts = fx.predictions(spark, folder)
    experiment = facts.agg(F.min("experiment_id").alias("experiment_id"), F.min("target").alias("target"), F.min("horizon").alias("horizon"))
    batch = facts.agg(F.count_distinct("config_id").alias("model_count"), F.count(F.lit(1)).alias("prediction_count"))
    winner = mt.champion(materialize(mt.backtest_metrics(facts, in_order=True)))
    row = sk.experiment_run({"experiment": experiment, "batch": batch, "champion": winner})
    return row.select("experiment_id", "target", "horizon", "model_count", "prediction_count", "champion_model_config_id")


@query("source_series", "P23 P7 P12", with_ctes("demand", """
SELECT date, series, 'y' AS variable, 'Value' AS label, round(y, 2) + 0.0 AS value FROM demand UNION ALL SELECT date, series, 'n', 'Orders', CAST(n AS DOUBLE) FROM demand
""").replace("SELECT date, series, 'y'", "SELECT date, 'y'").replace("SELECT date, series, 'n'", "SELECT date, 'n'"))
def source_series(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(eda.source_series(fx.demand(spark, folder), {"y": "Value", "n": "Orders", "absent": "Absent"}), 2)
