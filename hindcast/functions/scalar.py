"""Null-safe scalars, row-wise reductions and JSON parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hindcast.constants import PARAM_ALIASES, SCORE_RECIPES
from hindcast.functions.calendar import as_col


def to_number(value: Column | str) -> Column:
    """Numeric coercion: anything that is not a finite-or-infinite number becomes NULL."""
    number = as_col(value).try_cast("double")
    return F.when(~F.isnan(number), number)


def finite_or_null(value: Column | str) -> Column:
    c = as_col(value)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def finite_or_zero(value: Column | str) -> Column:
    return F.coalesce(finite_or_null(value), F.lit(0.0))


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """NULL when either side is NULL or the denominator is zero."""
    return F.try_divide(as_col(numerator), as_col(denominator))


def absolute_percentage_error(actual: Column | str, prediction: Column | str) -> Column:
    a, p = as_col(actual), as_col(prediction)
    return F.try_divide(F.abs(p - a), F.abs(a))


def signed_log1p(value: Column | str) -> Column:
    c = as_col(value)
    return F.signum(c) * F.log1p(F.abs(c))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pairwise-complete Pearson correlation as an aggregate; NULL, not an error, if a side is constant."""
    a, b = as_col(x).cast("double"), as_col(y).cast("double")
    left, right = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(left, right), F.stddev_pop(left) * F.stddev_pop(right))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        value = F.greatest(value, F.lit(low))
    return value if high is None else F.least(value, F.lit(high))


def weighted_score(mae: Column | str, rmse: Column | str, recipe: str) -> Column:
    mae_weight, rmse_weight = SCORE_RECIPES[recipe]
    return as_col(mae) * mae_weight + as_col(rmse) * rmse_weight


def row_max(columns: list[str]) -> Column:
    """Row-wise maximum, NULLs skipped; one column is its own maximum."""
    return F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])


def row_min(columns: list[str]) -> Column:
    return F.least(*columns) if len(columns) > 1 else F.col(columns[0])


def row_mean(columns: list[str]) -> Column:
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in columns])
    present = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])
    return F.try_divide(total, present)


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + F.coalesce(v, F.lit(0.0)))


def path_safe(value: Column | str) -> Column:
    """Partition folder text: everything outside [A-Za-z0-9_-] becomes '_', never empty."""
    text = F.coalesce(as_col(value).cast("string"), F.lit("unknown"))
    trimmed = F.btrim(F.regexp_replace(text, "[^A-Za-z0-9_-]", "_"), F.lit("_"))
    return F.when(trimmed == "", F.lit("unknown")).otherwise(trimmed)


def title_label(value: Column | str) -> Column:
    return F.initcap(F.regexp_replace(as_col(value), "_", " "))


# --- JSON parameters -------------------------------------------------------------------------------


def params_map(json_text: Column | str) -> Column:
    """JSON object as map<string,string>; malformed, empty or NULL text gives an empty map."""
    parsed = F.from_json(as_col(json_text), "map<string,string>")
    return F.coalesce(parsed, F.from_json(F.lit("{}"), "map<string,string>"))


def shown_value(value: Column) -> Column:
    """Parameter text as it is displayed: spaced lists, capitalised booleans, None for null."""
    text = F.when(value.startswith("["), F.regexp_replace(value, ",(?! )", ", ")).otherwise(value)
    return F.when(value.isin("true", "false"), F.initcap(value)).when(value.isNull(), "None").otherwise(text)


def number_param(params: Column, name: str, default: float) -> Column:
    return F.coalesce(to_number(F.try_element_at(params, F.lit(name))), F.lit(float(default)))


def list_param(params: Column, name: str) -> Column:
    """A numeric list parameter as array<double>; absent or scalar parameters give NULL."""
    return F.from_json(F.try_element_at(params, F.lit(name)), "array<double>")


def params_display(json_text: Column | str) -> Column:
    """``key=value`` pairs sorted by key; empty gives N/A and malformed text is shown as it is."""
    raw = as_col(json_text)
    parsed = F.from_json(raw, "map<string,string>")
    pairs = F.transform(
        F.array_sort(F.map_entries(parsed)), lambda e: F.concat(e["key"], F.lit("="), shown_value(e["value"]))
    )
    return (
        F.when(raw.isNull() | raw.isin("", "{}"), F.lit("N/A"))
        .when(parsed.isNull(), raw)
        .when(F.size(parsed) == 0, F.lit("N/A"))
        .otherwise(F.array_join(pairs, ", "))
    )


def params_short(json_text: Column | str, limit: int = 4) -> Column:
    """Abbreviated parameters: the known ones first in display order, then the rest by name."""
    params = params_map(json_text)
    order = F.array(*[F.lit(name) for name in PARAM_ALIASES])
    aliases = F.create_map(*[F.lit(v) for pair in PARAM_ALIASES.items() for v in pair])
    keys = F.map_keys(params)
    known = F.filter(order, lambda k: F.array_contains(keys, k))
    rest = F.array_sort(F.array_except(keys, order))
    ordered = F.concat(known, rest)
    shown = F.transform(
        F.slice(ordered, 1, limit),
        lambda k: F.concat(F.coalesce(F.try_element_at(aliases, k), k), F.lit("="), shown_value(F.try_element_at(params, k))),
    )
    shown = F.when(F.size(ordered) > limit, F.concat(shown, F.array(F.lit("...")))).otherwise(shown)
    return F.when(F.size(keys) == 0, F.lit("params: none")).otherwise(F.array_join(shown, ", "))


def steady(value: Column, digits: int = 12) -> Column:
    """A sum of doubles to ``digits`` significant digits: sums that differ only by the order of their terms become equal."""
    scale = F.pow(F.lit(10.0), F.least(F.lit(300.0), digits - 1 - F.floor(F.log10(F.abs(value)))))
    return F.when(F.abs(value) > 0, F.rint(value * scale) / scale).otherwise(value)
