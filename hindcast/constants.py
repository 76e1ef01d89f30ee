"""Names, weights and order lists that results must reproduce exactly."""

from __future__ import annotations

# Evaluation scopes and the default target-month periods behind them.
EVALUATION_SCOPES = ["overall", "pre_covid", "covid_shock", "recovery", "recent"]
EVALUATION_PERIODS = ["pre_covid", "covid_shock", "recovery", "recent"]
SHOCK_PERIOD = "covid_shock"
# (period, first month, last month); None is open. The first period is the fall-through.
DEFAULT_PERIODS = [
    ("pre_covid", None, "2020-02-01"),
    ("covid_shock", "2020-03-01", "2021-06-01"),
    ("recovery", "2021-07-01", "2022-12-01"),
    ("recent", "2023-01-01", None),
]

# (weight of MAE, weight of RMSE)
SCORE_RECIPES = {
    "typical": (0.90, 0.10),
    "balanced": (0.75, 0.25),
    "large_error": (0.50, 0.50),
}
SIMPLICITY_THRESHOLD = 0.02

# Simplicity order of model types; unknown types come last (99).
MODEL_ORDER = {
    "naive": 0,
    "ridge": 1,
    "lasso": 2,
    "elastic_net": 3,
    "random_forest": 4,
    "extra_trees": 5,
    "xgboost": 6,
    "arima": 7,
    "sarima": 8,
    "sarimax": 9,
}
MODEL_TYPES_BY_FAMILY = {
    "baseline": ["naive"],
    "linear": ["ridge", "lasso", "elastic_net"],
    "autoregressive": ["arima", "sarima", "sarimax"],
    "tree": ["random_forest", "extra_trees", "xgboost"],
    "neural_net": ["mlp", "rnn", "gru", "lstm"],
}
BASE_INTERPRETABILITY = {"baseline": 100.0, "linear": 86.0, "autoregressive": 76.0, "tree": 58.0}
DEFAULT_INTERPRETABILITY = 50.0

FAMILY_ORDER = ["baseline", "linear", "autoregressive", "tree", "neural_net", "neural"]
BUILD_ORDER = [
    "seasonal_naive", "ridge", "lasso", "elastic_net", "arima", "sarima", "sarimax", "random_forest",
    "extra_trees", "xgboost", "mlp", "cnn", "rnn", "gru", "lstm",
]
BASELINE_FAMILIES = ["baseline"]
BASELINE_BUILDS = ["seasonal_naive", "naive"]

FEATURE_POLICIES = [
    "none", "corr_pruned", "variance_pruned", "mutual_info_top_20", "mutual_info_top_30",
    "lasso_selected", "tree_top_20", "tree_top_30",
]
FEATURE_TRANSFORMS = ["identity", "log_signed", "quadratic", "cubic", "log_signed_quadratic_cubic"]
TRANSFORM_LABELS = {
    "identity": "No transform",
    "log_signed": "Signed log",
    "quadratic": "Quadratic",
    "cubic": "Cubic",
    "log_signed_quadratic_cubic": "Signed log + quadratic + cubic",
}
CORR_PRUNE_THRESHOLD = 0.95
VARIANCE_PRUNE_THRESHOLD = 1e-8
LASSO_SELECTOR_ALPHA = 10.0
TREE_SELECTOR = {"numTrees": 100, "maxDepth": 4, "seed": 42}

# Columns identifying one configuration in the prediction, metric and profile tables.
CONFIG_KEYS = [
    "config_id", "model_config_id", "model_family", "model_build", "model_type", "ensemble_method", "mode",
    "feature_family_name", "feature_policy", "feature_transform", "feature_set_id",
]
LEADERBOARD_METRICS = [
    "mae", "rmse", "r2", "r2_adjusted", "diracc", "selection_score", "selection_score_typical",
    "selection_score_balanced", "selection_score_large_error", "mae_improvement_vs_naive",
    "rmse_improvement_vs_naive", "n_predictions",
]

# (label, column, lower is better)
RANK_METRICS = [
    ("Balanced score", "selection_score_balanced", True),
    ("MAE", "mae", True),
    ("RMSE", "rmse", True),
    ("R-squared", "r2", False),
    ("Adjusted R-squared", "r2_adjusted", False),
    ("Directional accuracy", "diracc", False),
    ("Pre-COVID MAE", "pre_covid_mae", True),
    ("Pre-COVID RMSE", "pre_covid_rmse", True),
    ("COVID shock MAE", "covid_shock_mae", True),
    ("COVID shock RMSE", "covid_shock_rmse", True),
    ("Recovery MAE", "recovery_mae", True),
    ("Recovery RMSE", "recovery_rmse", True),
    ("Recent MAE", "recent_mae", True),
    ("Recent RMSE", "recent_rmse", True),
    ("Shock penalty", "shock_penalty", True),
    ("Recovery ratio", "recovery_ratio", True),
    ("Recent recovery ratio", "recent_recovery_ratio", True),
    ("RMSE shock penalty", "rmse_shock_penalty", True),
    ("RMSE recovery ratio", "rmse_recovery_ratio", True),
    ("RMSE recent recovery ratio", "rmse_recent_recovery_ratio", True),
]
PERIOD_SCORE_COLUMNS = ["mae", "rmse"] + [f"selection_score_{recipe}" for recipe in SCORE_RECIPES]
RATIO_PREFIXES = ["", "rmse_"] + [f"{recipe}_score_" for recipe in SCORE_RECIPES]
RATIO_KINDS = ["shock_penalty", "recovery_ratio", "recent_recovery_ratio"]

# Retention: 41 metrics where lower is better, 2 where higher is; secondary lists are optional.
RETENTION_LOWER = (
    ["selection_score"]
    + [f"selection_score_{recipe}" for recipe in SCORE_RECIPES]
    + ["mae", "rmse"]
    + [f"{period}_{column}" for period in EVALUATION_PERIODS for column in PERIOD_SCORE_COLUMNS]
    + [f"{prefix}{kind}" for kind in RATIO_KINDS for prefix in RATIO_PREFIXES]
)
RETENTION_HIGHER = ["r2", "r2_adjusted"]
RETENTION_SECONDARY_LOWER = ["complexity_score", "compute_score"]
RETENTION_SECONDARY_HIGHER = [
    "diracc", "pre_covid_diracc", "covid_shock_diracc", "recovery_diracc", "recent_diracc",
    "interpretability_score",
]

# Short names used in model labels, in display order.
PARAM_ALIASES = {
    "n_estimators": "n",
    "max_depth": "depth",
    "learning_rate": "lr",
    "min_child_weight": "mcw",
    "alpha": "alpha",
    "l1_ratio": "l1",
    "max_features": "max_feat",
    "min_samples_leaf": "leaf",
}
FAMILY_PREFIX_LABELS = {
    "baseline": "Baseline",
    "linear": "Linear",
    "autoregressive": "Autoregressive",
    "tree": "Tree",
    "neural_net": "Neural Net",
    "neural": "Neural Net",
}
BUILD_LABELS = {
    "seasonal_naive": "Seasonal naive",
    "elastic_net": "Elastic net",
    "random_forest": "Random forest",
    "extra_trees": "Extra trees",
    "xgboost": "XGBoost",
    "arima": "ARIMA",
    "sarima": "SARIMA",
    "sarimax": "SARIMAX",
    "gru": "GRU",
    "lstm": "LSTM",
    "mlp": "MLP",
    "cnn": "CNN",
    "rnn": "RNN",
}
ENSEMBLE_METHODS = {
    "random_forest": "bagging",
    "extra_trees": "randomized_bagging",
    "xgboost": "boosting",
}
FRAMEWORKS = {
    "sklearn": ["naive", "ridge", "lasso", "elastic_net", "random_forest", "extra_trees"],
    "xgboost": ["xgboost"],
    "statsmodels": ["arima", "sarima", "sarimax"],
    "pytorch": ["mlp", "rnn", "gru", "lstm"],
}

# Name fragments that mark what a feature carries.
FEATURE_MARKS = {
    "includes_lags": ["lag"],
    "includes_rolling": ["roll"],
    "includes_exogenous": ["gas", "cpi", "inflation", "income"],
    "includes_service": ["service"],
    "includes_interactions": ["interact", "_x_"],
}
