"""Featurising operators: casts, frequency index, per-entity scaling, label binarising, assembly, sort."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.exprs import binarize_status, epoch_millis, to_double
from ..schema import DEFAULT_SCHEMA, ObsSchema, is_string, spare_names
from .joins import COUNT_COL, broadcast_limit, lookup_join, materialise_small
from .rank import with_global_rank


def to_double_all(df: DataFrame, keep=(C.ID_COL,)) -> DataFrame:
    """Cast every column but `keep` to double in one projection; unparsable values become null.

    Times (TIMESTAMP, TIMESTAMP_NTZ, DATE) become epoch milliseconds."""
    def cast(f):
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return epoch_millis(f.name, f.dataType).cast("double")
        return to_double(f.name, f.dataType)

    return df.select(*[F.col(f.name) if f.name in keep else cast(f).alias(f.name) for f in df.schema.fields])


def binarize_labels(df: DataFrame, label: str = C.LABEL_COL) -> DataFrame:
    """Status codes of `label` -> 0.0 suspect / 1.0 normal (see functions.exprs.binarize_status)."""
    return df.withColumn(label, binarize_status(label))


def frequency_index_tables(df: DataFrame, columns) -> dict[str, tuple[DataFrame, bool]]:
    """Per column: (value, index) with index 0 for the most frequent value, ties in ascending value order, and
    whether that table may be broadcast. Nulls get no index.

    All columns are counted in one pass, as (column, value) pairs, and ranked by one global sort; one row per
    sort partition and one per column reach the driver, whatever the number of distinct values. The number of
    jobs does not grow with the number of columns.
    """
    columns = list(columns)
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("string").alias("v"))
                      for i, c in enumerate(columns)])
    counts = (df.select(F.explode(pairs).alias("p")).where(F.col("p.v").isNotNull())
              .groupBy(F.col("p.c").alias("c"), F.col("p.v").alias("v")).agg(F.count(F.lit(1)).alias(COUNT_COL)))
    ranked = with_global_rank(counts, "c", F.col(COUNT_COL).desc(), "v")
    facts = ranked.groupBy("c").agg(F.min("_rank").alias("first"),
                                    F.sum(F.octet_length("v") + F.lit(40)).alias("bytes")).collect()
    limit = broadcast_limit(df.sparkSession)
    seen = {r["c"]: (int(r["first"]), int(r["bytes"])) for r in facts}
    out = {}
    for i, c in enumerate(columns):
        first, nbytes = seen.get(i, (0, 0))
        table = ranked.where(F.col("c") == i).select(
            F.col("v").alias(c), (F.col("_rank") - F.lit(first)).cast("double").alias("_idx"), COUNT_COL)
        out[c] = (table, 0 <= nbytes <= limit)
    return out


def frequency_index_table(df: DataFrame, column: str) -> tuple[DataFrame, bool]:
    """The frequency index of one column."""
    return frequency_index_tables(df, [column])[column]


def index_columns(df: DataFrame, columns, force_shuffle: bool = False) -> DataFrame:
    """Replace string columns by their frequency index (double); rows with a null in one of them are skipped.

    The indexed columns move to the end of the schema, as the original StringIndexer chain did. They are
    indexed by the rows where all of them are present. `force_shuffle` takes the salted shuffle join even when
    an index table would fit a broadcast.
    """
    columns = list(columns)
    if not columns:
        return df
    whole = F.col(f"`{columns[0]}`").isNotNull()
    for c in columns[1:]:
        whole = whole & F.col(f"`{c}`").isNotNull()
    out = df.where(whole)
    for c, (table, small) in frequency_index_tables(out, columns).items():
        key, index = spare_names(out, "key", "idx")
        table = table.withColumnsRenamed({c: key, "_idx": index})
        joined = lookup_join(out, table, c, key, how="inner", null_safe=False, may_broadcast=small and not force_shuffle)
        rest = [x for x in out.columns if x != c]
        out = joined.select(*[F.col(f"`{x}`") for x in rest], F.col(index).alias(c))
    return out


def index_column(df: DataFrame, column: str, force_shuffle: bool = False) -> DataFrame:
    """Replace one string column by its frequency index."""
    return index_columns(df, [column], force_shuffle)


def index_strings(df: DataFrame, schema: ObsSchema = DEFAULT_SCHEMA, force_shuffle: bool = False) -> DataFrame:
    """Frequency-index every string `_value` column (schema order)."""
    return index_columns(df, [f.name for f in df.schema.fields
                              if f.name.endswith(schema.value_suffix) and is_string(f.dataType)], force_shuffle)


def scaled_between(x, mn, mx):
    """x/std then min-max to [0, 1] in closed form: (x-min)/(max-min); a constant feature maps to 0.5."""
    return F.when(mx == mn, F.lit(0.5)).otherwise((x - mn) / (mx - mn))


def scale_by_entity(df: DataFrame, features, key: str = C.ID_COL, suffix: str = "",
                    force_shuffle: bool = False) -> DataFrame:
    """Per-entity std-scaling then min-max scaling of `features`, without a loop over entities.

    One groupBy (partial aggregation absorbs a hot entity) gives min/max per entity; the per-entity
    table is checkpointed and joined back, broadcast only when measured below the threshold.
    """
    features = list(features)
    entity, *names = spare_names(df, "k", *[f"{side}{i}" for i in range(len(features)) for side in ("mn", "mx")])
    low, high = names[::2], names[1::2]
    aggs = []
    for c, lo, hi in zip(features, low, high, strict=True):
        aggs += [F.min(F.col(c)).alias(lo), F.max(F.col(c)).alias(hi)]
    aggs.append(F.count(F.lit(1)).alias(COUNT_COL))  # rows per entity: lets the join salt hot entities
    stats = df.groupBy(F.col(key).alias(entity)).agg(*aggs)
    stats, small = materialise_small(stats)
    joined = lookup_join(df, stats, key, entity, how="left", null_safe=True, may_broadcast=small and not force_shuffle)
    out = []
    for c in df.columns:
        if c in features:
            i = features.index(c)
            out.append(scaled_between(F.col(c), F.col(low[i]), F.col(high[i])).alias(c + suffix))
            if suffix:
                out.append(F.col(c))
        else:
            out.append(F.col(f"`{c}`"))
    return joined.select(*out)


def scale_global(df: DataFrame, features, suffix: str = "") -> DataFrame:
    """The same scaling over the whole frame: one global min/max aggregate (two numbers per feature
    reach the driver) folded into the projection as literals."""
    features = list(features)
    aggs = []
    for i, c in enumerate(features):
        aggs += [F.min(F.col(c)).alias(f"_mn{i}"), F.max(F.col(c)).alias(f"_mx{i}")]
    stats = df.agg(*aggs).first()
    out = []
    for c in df.columns:
        if c in features:
            i = features.index(c)
            mn, mx = stats[f"_mn{i}"], stats[f"_mx{i}"]
            mn_c = F.lit(mn).cast("double")
            mx_c = F.lit(mx).cast("double")
            out.append(scaled_between(F.col(c), mn_c, mx_c).alias(c + suffix))
            if suffix:
                out.append(F.col(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def assemble(df: DataFrame, features, output: str = C.FEATURES_COL) -> DataFrame:
    """VectorAssembler over the feature columns; NaN fails as in the original (handleInvalid='error')."""
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="error").transform(df)


def _row_hash(df: DataFrame):
    """Hash of a whole row (vectors through their array form) and of where it comes from, so equal rows spread too."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import VectorUDT

    cols = [vector_to_array(F.col(f.name)) if isinstance(f.dataType, VectorUDT) else F.col(f.name)
            for f in df.schema.fields]
    return F.xxhash64(*cols, F.spark_partition_id())


def sort_by_time(df: DataFrame, schema: ObsSchema = DEFAULT_SCHEMA, tie_col: str | None = None) -> DataFrame:
    """Global ascending time order.

    The entity and then a hash of the row break ties, so that rows sharing one (time, entity) key -- a
    hot entity's burst -- still spread over the range partitions instead of landing in one task.
    `tie_col` names a precomputed row hash (dropped after the sort).
    """
    keys = [F.col(schema.time_col)] + ([F.col(schema.id_col)] if schema.id_col in df.columns else [])
    if tie_col is not None:
        return df.orderBy(*keys, F.col(tie_col)).drop(tie_col)
    return df.orderBy(*keys, _row_hash(df))
