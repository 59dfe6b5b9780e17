"""Observation-shaped views derived by Spark from the driver's tables (see FIXTURES.md).

`obs` and `market` are wide observation tables keyed by supplier (entity) and ship date (time);
`pred` is a frame of scored rows for the metric operators. All three are lazy projections of
`lineitem`, so their work grows with the table and Catalyst prunes what a query does not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import epoch_millis


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _keys(li: DataFrame) -> list[Column]:
    return [
        F.col("l_suppkey").cast("string").alias("ado_id"),
        epoch_millis("l_shipdate", li.schema["l_shipdate"].dataType).alias("timestamp"),
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("obs_key"),
    ]


def obs_from_lineitem(li: DataFrame, time: str | None = None, extra=()) -> DataFrame:
    """`obs` over lineitem; `time` names a column to use as it is instead of epoch milliseconds."""
    keys = _keys(li)
    if time is not None:
        keys[1] = F.col(time).alias("timestamp")
    ln = F.col("l_linenumber")
    quantity_status = (F.when(ln == 1, 0).when(ln == 2, 1).when(ln == 3, 2).when(ln == 4, 64)
                       .when(ln == 5, 66).when(ln == 6, 128).otherwise(3))
    return li.select(
        *keys,
        F.col("l_quantity").alias("li_ua_quantity_value"),
        quantity_status.cast("int").alias("li_ua_quantity_status"),
        F.col("l_extendedprice").alias("li_ua_price_value"),
        F.when(F.col("l_extendedprice") > 60000, 2).otherwise(0).cast("int").alias("li_ua_price_status"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("li_ua_discount_value"),
        F.col("l_tax").alias("li_ua_tax_value"),
        ln.cast("int").alias("li_ua_linenumber_value"),
        F.col("l_returnflag").alias("li_ua_flag_value"),
        F.lit(1.0).alias("li_ua_unit_value"),
        *extra,
    )


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs_from_lineitem(read_table(spark, sf_dir, "lineitem"))


MARKET_ATTRS = ("re_ua_high", "re_ua_low", "re_ua_open", "re_ua_close2", "re_ua_ask", "re_ua_bid", "re_ua_mid")


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    p, t, d = F.col("l_extendedprice"), F.col("l_tax"), F.col("l_discount")
    values = {
        "re_ua_high": p * (1 + t),
        "re_ua_low": p * (1 - d),
        "re_ua_open": p,
        "re_ua_close2": p * (1 + t - d),
        "re_ua_ask": F.nullif(p * (1 + t / 2), p),
        "re_ua_bid": p * (1 - t / 2),
        "re_ua_mid": p,
    }
    cols = _keys(li)
    cols += [values[a].alias(f"{a}_value") for a in MARKET_ATTRS]
    cols += [F.lit(0).cast("int").alias(f"{a}_status") for a in MARKET_ATTRS]
    return li.select(*cols)


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stacked rule 'models' scored on obs: (model, label, prediction, y, y_hat)."""
    o = obs(spark, sf_dir)
    label = F.when(F.col("li_ua_price_status") == 2, 0.0).otherwise(1.0)
    base = o.select(
        label.alias("label"),
        F.col("li_ua_quantity_value").alias("q"),
        F.col("li_ua_price_value").alias("y"),
        (F.lit(1500.0) * F.col("li_ua_quantity_value")).alias("y_hat"),
    )
    # one scan: each row carries both rules' predictions, stacked by explode (not a union of two scans)
    rules = F.array(
        F.struct(F.lit("rule_a").alias("model"), F.when(F.col("q") > 35, 0.0).otherwise(1.0).alias("prediction")),
        F.struct(F.lit("rule_b").alias("model"), F.lit(1.0).alias("prediction")),
    )
    return base.select(F.explode(rules).alias("r"), "label", "y", "y_hat").select(
        "r.model", "label", "r.prediction", "y", "y_hat")


def events_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second source: the events table as an observation table with the user as entity."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").cast("string").alias("ado_id"),
        epoch_millis("ts", ev.schema["ts"].dataType).alias("timestamp"),
        F.col("event_id").cast("string").alias("obs_key"),
        F.col("value").alias("ev_ua_value_value"),
        F.when(F.col("value") < 0, 2).otherwise(0).cast("int").alias("ev_ua_value_status"),
        F.col("event_type").alias("ev_ua_type_value"),
    )


def obs_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`obs` with the ship date itself as time column (TIMESTAMP_NTZ in the driver's tables)."""
    li = read_table(spark, sf_dir, "lineitem")
    return obs_from_lineitem(li, "l_shipdate")


def obs_with_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`obs` with two string attributes more: the line status, and the return flag with the line number."""
    li = read_table(spark, sf_dir, "lineitem")
    extra = [F.col("l_linestatus").alias("li_ua_state_value"),
             F.concat_ws("-", "l_returnflag", "l_linenumber").alias("li_ua_mark_value")]
    return obs_from_lineitem(li, extra=extra)


def learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observation table with a label that its features determine: b is 1 for line numbers above 3, y is
    10 b + 5, c is 1 - b, and b's status is suspect where b is 1. `quantity` is no attribute."""
    li = read_table(spark, sf_dir, "lineitem")
    b = F.when(F.col("l_linenumber") > 3, 1.0).otherwise(0.0)
    return li.select(*_keys(li), b.alias("li_ua_b_value"), (1 - b).alias("li_ua_c_value"), (F.lit(10.0) * b + F.lit(5.0)).alias("li_ua_y_value"),
                     F.when(b == 1.0, 2).otherwise(0).cast("int").alias("li_ua_b_status"),
                     F.col("l_quantity").alias("quantity"))


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`learnable` with noise that no attribute explains: every fifth quantity flips b's status, and moves y by -2 to 2."""
    df = learnable(spark, sf_dir)
    step = F.col("quantity") % 5
    status = F.when((F.col("li_ua_b_status") == 2) != (step == 0), 2).otherwise(0)
    return df.withColumns({"li_ua_b_status": status.cast("int"), "li_ua_y_value": F.col("li_ua_y_value") + step - 2})
