"""Naming convention of observation tables and plan-time column discovery (schema only, no jobs)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import constants as C

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class ObsSchema:
    """Where the entity key, the event time and the attribute columns live."""

    id_col: str = C.ID_COL
    time_col: str = C.TIME_COL
    value_suffix: str = C.VALUE_SUFFIX
    status_suffix: str = C.STATUS_SUFFIX

    def value_col(self, attr: str) -> str:
        return attr + self.value_suffix

    def status_col(self, attr: str) -> str:
        return attr + self.status_suffix

    def value_columns(self, df: DataFrame) -> list[str]:
        return [f.name for f in df.schema.fields if f.name.endswith(self.value_suffix)]

    def status_columns(self, df: DataFrame) -> list[str]:
        return [f.name for f in df.schema.fields if f.name.endswith(self.status_suffix)]


DEFAULT_SCHEMA = ObsSchema()


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def require_columns(df: DataFrame, names, what: str = "column") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown {what}(s): {missing}; available: {df.columns}")


def spare_names(df: DataFrame, *wanted: str, also=()) -> list[str]:
    """Helper column names that no column of the frame, and none of `also`, has (in any case)."""
    taken = {c.lower() for c in (*df.columns, *also)}
    out = []
    for w in wanted:
        n, name = 0, f"_{w}"
        while name.lower() in taken:
            n += 1
            name = f"_{w}_{n}"
        taken.add(name.lower())
        out.append(name)
    return out
