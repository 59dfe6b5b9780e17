"""Scans of observation tables (any DataSource format), full or projected to one attribute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import DEFAULT_SCHEMA, ObsSchema, is_string


def scan_all(spark: SparkSession, path: str | None = None, fmt: str = "parquet", table: str | None = None,
             **options) -> DataFrame:
    """Full scan of a table: a catalog table by name, or a path read through any format with options.

    Lazy: Catalyst prunes columns and pushes filters of later steps into this scan.
    """
    if table is not None:
        return spark.table(table)
    reader = spark.read.format(fmt)
    if options:
        reader = reader.options(**{k: str(v) for k, v in options.items()})
    return reader.load(path) if path is not None else reader.load()


def scan_attribute(df_or_spark, attr_col: str, schema: ObsSchema = DEFAULT_SCHEMA, **scan_kw) -> DataFrame:
    """Scan projected to (entity, time, attribute column); the projection reaches the parquet ReadSchema."""
    df = df_or_spark if isinstance(df_or_spark, DataFrame) else scan_all(df_or_spark, **scan_kw)
    return df.select(schema.id_col, schema.time_col, attr_col)


def load_rows(df_or_spark, attr_col: str, single_column: bool, schema: ObsSchema = DEFAULT_SCHEMA,
              **scan_kw) -> DataFrame:
    """Pick the projected or the full scan; the projected scan refuses a string attribute."""
    if not single_column:
        return df_or_spark if isinstance(df_or_spark, DataFrame) else scan_all(df_or_spark, **scan_kw)
    df = scan_attribute(df_or_spark, attr_col, schema, **scan_kw)
    if is_string(df.schema[attr_col].dataType):
        raise ValueError(f"column '{attr_col}' holds strings: single-column mode has no numbers to regress; use the "
                         "full scan, which indexes them")
    return df
