"""Projections decided from the schema alone (plan time, no Spark job)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import constants as C


def select_columns(df: DataFrame, names) -> DataFrame:
    """Project a list of names (an unknown name is an analysis error, as in the reference)."""
    return df.select(*list(names))


def drop_columns(df: DataFrame, names) -> DataFrame:
    """Drop names; unknown names are ignored."""
    return df.drop(*list(names))


def _type_matches(df: DataFrame, type_name: str) -> list[str]:
    seen: list[str] = []
    for f in df.schema.fields:
        if f.dataType.typeName() == type_name and f.name not in seen:
            seen.append(f.name)
    return seen


def filter_on_type_strict(df: DataFrame, type_name: str) -> DataFrame:
    """Keep the columns whose Spark type name (``integer``, ``double``, ``string`` ...) equals `type_name`."""
    return df.select(*_type_matches(df, type_name))


def filter_on_type(df: DataFrame, type_name: str, status_suffix: str = C.STATUS_SUFFIX,
                   legacy_prefix: bool = False, prefix_len: int = C.STATUS_PREFIX_LEN,
                   value_suffix: str = C.VALUE_SUFFIX) -> DataFrame:
    """Columns of a type, followed by the status column that belongs to each of them.

    The status of `<attr>_value` (or of a column `<attr>`) is `<attr>_status`. With `legacy_prefix` it is the
    first column (schema order) that starts with the first `prefix_len` characters of the name and ends with
    the status suffix, as the original looked it up; names that share a prefix then share one status.
    A status already selected is not selected twice.
    """
    kept = _type_matches(df, type_name)
    statuses: list[str] = []
    for name in kept:
        if not legacy_prefix:
            status = name.removesuffix(value_suffix) + status_suffix
            if status in df.columns and status not in kept and status not in statuses:
                statuses.append(status)
            continue
        prefix = name[:prefix_len]
        for f in df.schema.fields:
            if f.name.startswith(prefix) and f.name.endswith(status_suffix):
                if f.name not in kept and f.name not in statuses:
                    statuses.append(f.name)
                break
    return df.select(*(kept + statuses))
