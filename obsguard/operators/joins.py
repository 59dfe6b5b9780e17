"""Lookup joins of a big frame against a small per-key table whose size is measured, not guessed.

Three plans, chosen from measurements of the (checkpointed) per-key table:

1. broadcast hash join when the table fits the session's broadcast threshold: the big side is not
   shuffled at all;
2. otherwise a shuffle join in which *hot* keys are salted: a key whose row count exceeds twice the
   fair share of one shuffle partition (total / P) gets S = ceil(8 * n_key * P / total) salts; its rows
   on the big side spread over the salts by a hash of the row and its input partition, and its single
   row on the small side is replicated S times. At most P/2 keys can be hot, so the hot-key table has a proven bound and
   is broadcast;
3. AQE's skew-join split stays on as a second line of defence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import spare_names
from ..session import reliable_checkpoint

COUNT_COL = "_n"
SALTS_A_SHARE = 8


def broadcast_limit(spark) -> int:
    """Byte bound for an explicit broadcast: the session's own auto-broadcast threshold."""
    raw = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")).strip().lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    s = raw[:-1] if raw.endswith("b") else raw
    if s and s[-1] in units:
        return int(float(s[:-1]) * units[s[-1]])
    return int(s)


def measured_bytes(small: DataFrame) -> tuple[int, int]:
    """(rows, approximate in-memory bytes) of a materialised table, by one small aggregate job."""
    widths = []
    for f in small.schema.fields:
        name = f.dataType.typeName()
        if name in ("string", "binary"):
            widths.append(F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) + F.lit(8))
        else:
            widths.append(F.lit(8))
    row_bytes = widths[0]
    for w in widths[1:]:
        row_bytes = row_bytes + w
    r = small.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes + F.lit(16)).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


def materialise_small(small: DataFrame) -> tuple[DataFrame, bool]:
    """Checkpoint a per-key table (cuts lineage, fixes its content) and decide whether it may be broadcast."""
    frozen = reliable_checkpoint(small)
    _, nbytes = measured_bytes(frozen)
    limit = broadcast_limit(small.sparkSession)
    return frozen, (limit > 0 and nbytes <= limit)


def hot_keys(small: DataFrame, key: str, count_col: str = COUNT_COL, partitions: int | None = None) -> DataFrame:
    """(key, _salts) for keys holding more than two fair shares of a shuffle partition.

    Bounded by construction: the counts sum to the total, so fewer than P/2 keys qualify.
    """
    p = partitions or int(small.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    total = small.agg(F.sum(count_col).alias("t")).first()["t"] or 0
    if total <= 0 or p < 2:
        return small.where(F.lit(False)).select(F.col(key), F.lit(1).alias("_salts"))
    share = total / p
    # several salts a share: they fall into partitions by hash, and many small ones fall evenly
    salts = F.least(F.ceil(F.col(count_col) * F.lit(SALTS_A_SHARE) / F.lit(share)), F.lit(SALTS_A_SHARE * p)).cast("int")
    return small.where(F.col(count_col) > F.lit(2 * share)).select(F.col(key), salts.alias("_salts"))


def _salt_of_row(df: DataFrame, n_salts, helpers) -> F.Column:
    """Spread of a hot key's rows over its salts: a hash of the row plus the number of its input partition.

    Distinct rows spread by their hash, equal rows by where they come from. Both are the same on a retry
    whatever the order of rows in a task, so no row is lost or doubled when a stage is run again in part."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields
            if f.name not in helpers and not isinstance(f.dataType, T.MapType)]
    spread = F.xxhash64(*cols).bitwiseAND(F.lit((1 << 40) - 1)) + F.spark_partition_id()
    return F.pmod(spread, n_salts.cast("bigint")).cast("int")


def lookup_join(big: DataFrame, small: DataFrame, big_key: str, small_key: str, how: str = "left",
                null_safe: bool = True, may_broadcast: bool = False, count_col: str = COUNT_COL) -> DataFrame:
    """Join `small` (one row per key) onto `big`, dropping the small side's key and count column.

    Helper columns take names that neither side has."""
    key, hot_key, salts, salt_left, salt_right, count_key = spare_names(
        big, "lookup_key", "hot_key", "hot_salts", "left_salt", "right_salt", "count_key", also=small.columns)
    small = small.withColumnRenamed(small_key, key)
    big_col = F.col(f"`{big_key}`")

    def same():
        return big_col.eqNullSafe(F.col(key)) if null_safe else big_col == F.col(key)

    if may_broadcast:
        right = small.drop(count_col)
        return big.join(F.broadcast(right), same(), how).drop(key)
    if count_col not in small.columns:   # no counts came along: take them from the big side's key alone
        counts = big.groupBy(big_col.alias(count_key)).agg(F.count(F.lit(1)).alias(count_col))
        small = reliable_checkpoint(small.join(counts, F.col(key).eqNullSafe(F.col(count_key)), "left").drop(count_key))

    hot = hot_keys(small, key, count_col).withColumnRenamed(key, hot_key).withColumnRenamed("_salts", salts)
    # the hot-key table is bounded (< P/2 rows), so broadcasting it is safe
    found = F.col(salts).isNotNull()
    tagged = big.join(F.broadcast(hot), big_col.eqNullSafe(F.col(hot_key)) & found, "left")
    salt = F.when(found, _salt_of_row(tagged, F.col(salts), (hot_key, salts))).otherwise(F.lit(0))
    left = tagged.withColumn(salt_left, salt).drop(hot_key, salts)

    rep = small.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col(hot_key)) & found, "left")
    every = F.when(found, F.sequence(F.lit(0), F.col(salts) - 1)).otherwise(F.array(F.lit(0)))
    right = rep.withColumn(salt_right, F.explode(every)).drop(hot_key, salts, count_col)
    joined = left.join(right, same() & (F.col(salt_left) == F.col(salt_right)), how)
    return joined.drop(key, salt_left, salt_right)
