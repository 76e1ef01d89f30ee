"""hindcast: panel time-series features, rolling as-of backtests and experiment analytics on Spark."""

__version__ = "0.1.0"
