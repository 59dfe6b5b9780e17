"""Per-entity aggregates: distinct entities, counts, standard deviations, and joining them back.

All are one `groupBy` on the entity key; Spark's partial (map-side) aggregation means a hot entity
holding a third of all rows costs one small partial row per input partition, not one big task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_SCHEMA, ObsSchema
from .joins import COUNT_COL, lookup_join, materialise_small


def distinct_entities(df: DataFrame, schema: ObsSchema = DEFAULT_SCHEMA) -> DataFrame:
    return df.select(schema.id_col).distinct()


def entity_counts(df: DataFrame, schema: ObsSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Rows per entity (a null entity is a group of its own)."""
    return df.groupBy(schema.id_col).agg(F.count(F.lit(1)).alias("n_rows"))


def entity_summary(df: DataFrame, schema: ObsSchema = DEFAULT_SCHEMA) -> DataFrame:
    """One row: total rows, distinct entities (null counted as one) and whether there are several."""
    idc = F.col(schema.id_col)
    per = df.groupBy(idc.alias("_e")).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(
        F.sum("_n").cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).alias("n_entities"),
        (F.count(F.lit(1)) > 1).cast("int").alias("multiple_entities"),
        F.max("_n").alias("max_rows_per_entity"),
    )


def entity_stddev(df: DataFrame, attributes, schema: ObsSchema = DEFAULT_SCHEMA,
                  require_all: bool = True, with_count: bool = False) -> DataFrame:
    """Sample stddev of each attribute's value per entity.

    With `require_all`, entities where any requested attribute has a null stddev (fewer than two
    values) are left out, as the stddev injector needs every one of them. `with_count` is for joins: it adds
    the rows of each entity and keeps every entity, its stddevs all null where `require_all` would leave it
    out, so that a huge entity without a stddev is still known to be huge.
    """
    cols = [schema.value_col(a) for a in attributes]
    aggs = [F.stddev_samp(F.col(c).cast("double")).alias(f"sd_{c}") for c in cols]
    if with_count:
        aggs.append(F.count(F.lit(1)).alias(COUNT_COL))  # rows per entity: lets a join salt hot entities
    out = df.groupBy(schema.id_col).agg(*aggs)
    if require_all and cols:
        cond = F.col(f"sd_{cols[0]}").isNotNull()
        for c in cols[1:]:
            cond = cond & F.col(f"sd_{c}").isNotNull()
        if not with_count:
            return out.where(cond)
        out = out.withColumn("_all", cond)
        out = out.withColumns({f"sd_{c}": F.when(F.col("_all"), F.col(f"sd_{c}")) for c in cols}).drop("_all")
    return out


def join_entity_stats(df: DataFrame, stats: DataFrame, schema: ObsSchema = DEFAULT_SCHEMA,
                      how: str = "left", force_shuffle: bool = False) -> DataFrame:
    """Attach one row of per-entity statistics to every row of its entity.

    The statistics are checkpointed (one row per entity) and measured: broadcast when they fit the
    session's broadcast threshold, otherwise a shuffle join whose hot keys are salted.
    """
    small = stats.withColumnRenamed(schema.id_col, "_k")
    small, may_broadcast = materialise_small(small)
    return lookup_join(df, small, schema.id_col, "_k", how=how, null_safe=True,
                       may_broadcast=may_broadcast and not force_shuffle)


def entity_feature_ranges(df: DataFrame, features, schema: ObsSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Per-entity min and max of each feature (the statistics behind per-entity scaling)."""
    aggs = []
    for c in features:
        aggs += [F.min(F.col(c)).alias(f"min_{c}"), F.max(F.col(c)).alias(f"max_{c}")]
    return df.groupBy(schema.id_col).agg(F.count(F.lit(1)).alias("n_rows"), *aggs)

