"""Train/test splits: by date, by a reproducible hash draw, or Spark's random split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import hex_word, md5_hex, row_key, time_at_most, word_below
from ..schema import DEFAULT_SCHEMA, ObsSchema


def split_by_date(df: DataFrame, split_ms: int, schema: ObsSchema = DEFAULT_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(time <= split, time > split): disjoint; together complete except for a null time."""
    early = time_at_most(schema.time_col, df.schema[schema.time_col].dataType, split_ms)
    return df.where(early), df.where(~early)


def tag_by_date(df: DataFrame, split_ms: int, name: str = "part", schema: ObsSchema = DEFAULT_SCHEMA) -> DataFrame:
    """The same split as a column in one scan: 0 up to the split, 1 after it, null for a null time."""
    early = time_at_most(schema.time_col, df.schema[schema.time_col].dataType, split_ms)
    return df.withColumn(name, F.when(early, F.lit(0)).when(~early, F.lit(1)))


def split_word(key_cols, seed: int):
    """Word 0 of the row's digest; its unit value is the split draw (compared as text, exactly)."""
    return hex_word(md5_hex(key_cols, seed, "split"), 0)


def _between(word, lo: float, hi: float | None):
    cond = ~word_below(word, lo)
    if hi is not None:
        cond = cond & word_below(word, hi)
    return cond


def hash_split(df: DataFrame, weights, seed: int, key_cols=None,
               schema: ObsSchema = DEFAULT_SCHEMA) -> list[DataFrame]:
    """Weighted split by a uniform draw hashed from each row's key: the same rows land in the same
    part whatever the partitioning, task retries or recomputation (unlike an RNG per partition).

    `key_cols` should tell rows apart: rows with equal keys go together. Without it every row draws by all its
    columns and its place in the scan."""
    keys = list(key_cols) if key_cols else row_key(df)
    total = float(sum(weights))
    if total <= 0:
        raise ValueError("weights must sum to a positive number")
    word = split_word(keys, seed)
    parts, lo = [], 0.0
    for i, w in enumerate(weights):
        hi = lo + w / total
        parts.append(df.where(_between(word, lo, hi if i < len(weights) - 1 else None)))
        lo = hi
    return parts


def tag_split(df: DataFrame, weights, seed: int, key_cols=None, name: str = "part",
              schema: ObsSchema = DEFAULT_SCHEMA) -> DataFrame:
    """The same assignment as a column (part index), in one scan."""
    keys = list(key_cols) if key_cols else row_key(df)
    total = float(sum(weights))
    word = split_word(keys, seed)
    expr, lo = None, 0.0
    for i, w in enumerate(weights[:-1]):
        lo += w / total
        below = word_below(word, lo)
        expr = F.when(below, F.lit(i)) if expr is None else expr.when(below, F.lit(i))
    last = F.lit(len(weights) - 1)
    return df.withColumn(name, last if expr is None else expr.otherwise(last))


def random_split(df: DataFrame, weights, seed: int) -> list[DataFrame]:
    """Spark's randomSplit (depends on partitioning; prefer hash_split for reproducible parts)."""
    return df.randomSplit(list(weights), seed)
