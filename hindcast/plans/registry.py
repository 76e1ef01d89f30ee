"""Query registry and the SQL building blocks of the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
IDS: dict[str, str] = {}


def query(name: str, ids: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query with the operator ids it covers and, where SQL can express it, its check."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = function
        IDS[name] = ids
        if sql is not None:
            CHECKS[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Round doubles and widen integers so that both engines print the same values.

    ``special`` sets the digits of single columns; ratios get more, so that short decimals never end
    halfway between two rounded values.
    """
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        if kind == "double":
            c = F.round(c, special.get(field.name, digits)) + F.lit(0.0)
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)


def rounded6(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Six digits suit error metrics: averages of halves and twelfths never end halfway at that place."""
    return rounded(df, digits, **special)


_CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, uses: str, body: str) -> None:
    _CTES[name] = (uses.split(), body)


def with_ctes(names: str, select: str) -> str:
    """Prefix ``select`` with the named common table expressions and what they use."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for used in _CTES[name][0]:
            visit(used)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in ordered) + "\n" + select


def r4(expression: str, alias: str, digits: int = 4) -> str:
    """SQL column: NaN to NULL, rounded."""
    return f"round(CASE WHEN isnan({expression}) THEN NULL ELSE {expression} END, {digits}) + 0.0 AS {alias}"


def r6(expression: str, alias: str, digits: int = 6) -> str:
    return r4(expression, alias, digits)
