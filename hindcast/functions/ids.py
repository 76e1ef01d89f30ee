"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hindcast.functions.calendar import as_col


def json_string(value: Column) -> Column:
    """A JSON string literal with quotes and backslashes escaped."""
    escaped = F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"')
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def json_string_list(values: Column) -> Column:
    """JSON list text with ', ' between items."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, json_string), ", "), F.lit("]"))


def feature_hash(features: Column) -> Column:
    """SHA-1 over the sorted feature names: equal sets share one hash whatever their order."""
    return F.sha1(json_string_list(F.array_sort(features)))


def feature_set_id(
    family: Column | str, mode: Column | str, features: Column, policy: Column | str, transform: Column | str
) -> Column:
    family, mode, policy, transform = (as_col(c) for c in (family, mode, policy, transform))
    # Keys of the digest payload in alphabetical order.
    payload = F.concat(
        F.lit('{"feature_family_name": '), json_string(family),
        F.lit(', "feature_names": '), json_string_list(F.array_sort(features)),
        F.lit(', "feature_policy": '), json_string(policy),
        F.lit(', "feature_transform": '), json_string(transform),
        F.lit(', "mode": '), json_string(mode),
        F.lit("}"),
    )
    return F.concat_ws("__", family, mode, policy, transform, F.substring(F.sha1(payload), 1, 12))


def config_id(
    model_type: Column | str,
    mode: Column | str,
    family: Column | str,
    params: Column,
    policy: Column | str,
    transform: Column | str,
) -> Column:
    """``type__mode__family[__policy-p][__transform-t][__k-v_k-v]``; parameters sorted by name.

    ``params`` is a map<string,string>. ``concat_ws`` drops the parts that are NULL.
    """
    policy, transform = as_col(policy), as_col(transform)
    entries = F.array_sort(F.map_entries(params))
    rendered = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("-"), e["value"])), "_")
    return F.concat_ws(
        "__",
        as_col(model_type),
        as_col(mode),
        as_col(family),
        F.when(policy != "none", F.concat(F.lit("policy-"), policy)),
        F.when(transform != "identity", F.concat(F.lit("transform-"), transform)),
        F.when(F.size(params) > 0, rendered),
    )


def run_id(config: Column | str, as_of: Column | str) -> Column:
    return F.concat(as_col(config), F.lit("__as_of_"), F.date_format(as_col(as_of), "yyyy-MM-dd"))


def task_folder(task_id: Column | str) -> Column:
    """Folder name of a task: a readable prefix plus a digest that keeps it unique."""
    task = as_col(task_id)
    prefix = F.regexp_replace(F.substring(task, 1, 80), r"[^A-Za-z0-9_-]", "_")
    return F.concat_ws("__", prefix, F.substring(F.sha1(task), 1, 12))


def payload_digest(content: Column | str) -> Column:
    return F.sha2(as_col(content), 256)
