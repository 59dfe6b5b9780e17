"""Isotonic regression of any number of distinct feature values, as a table of steps.

Rows are pooled by feature value (weight, weighted label sum). The values in order are dealt into chunks; within a chunk,
neighbours that violate the order merge into blocks (the slopes of the lower convex hull of the chunk's cumulative
sums). What is left can only be wrong where two chunks meet, so the next round's chunks are laid across those
places. A round that merges nothing proves the steps right. Chunks grow while the blocks in them stay few, so long
runs of violations shrink fast; the number of values or blocks in one task is bounded at any size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import with_global_rank
from ..session import discard, stored

CHUNK = 1 << 18          # blocks in a task, at most
_BLOCK = "chunk bigint, place bigint, first_x double, last_x double, weight double, total double"


def merged(weights, totals) -> list[tuple[int, int, float, float]]:
    """(first, last, weight, total) of the blocks into which neighbours with falling means merge."""
    out: list = []
    for i, (w, t) in enumerate(zip(weights, totals, strict=True)):
        first = i
        while out and out[-1][3] / out[-1][2] >= t / w:
            first, _, w0, t0 = out.pop()
            w, t = w + w0, t + t0
        out.append((first, i, w, t))
    return out


def _round(blocks: DataFrame, width: int, offset: int) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        got = merged(frame["weight"].tolist(), frame["total"].tolist())
        first, last = [g[0] for g in got], [g[1] for g in got]
        return pd.DataFrame({"chunk": frame["chunk"].iloc[0], "place": frame["place"].to_numpy()[first],
                             "first_x": frame["first_x"].to_numpy()[first], "last_x": frame["last_x"].to_numpy()[last],
                             "weight": [g[2] for g in got], "total": [g[3] for g in got]})

    dealt = blocks.withColumn("chunk", F.floor((F.col("place") + F.lit(offset)) / F.lit(width)))
    return dealt.groupBy("chunk").applyInPandas(run, _BLOCK)


def isotonic_steps(df: DataFrame, x: str, y: str, weight: str | None = None, increasing: bool = True, chunk: int = CHUNK) -> DataFrame:
    """(first_x, last_x, weight, value): the steps of the least-squares fit of y that never falls with x (or never rises).

    Rows with a null x or y, and rows without weight, take no part; NaN is the largest x."""
    sign = 1.0 if increasing else -1.0
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(F.col(x).cast("double").alias("x"), (F.col(y).cast("double") * sign).alias("y"), w.alias("w"))
    rows = rows.where("x is not null and y is not null and w > 0")
    values = rows.groupBy("x").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("y")).alias("total"))
    placed = with_global_rank(values, "x", name="place")
    blocks, path = stored(placed.select(F.lit(0).cast("bigint").alias("chunk"), "place", F.col("x").alias("first_x"), F.col("x").alias("last_x"),
                                        "weight", "total"), "isotonic")
    spark = df.sparkSession
    values_n = before = blocks.count()
    width, offset = chunk, 0
    while before:
        blocks, after_path = stored(_round(blocks, width, offset), "isotonic")
        discard(spark, path)
        path, after = after_path, blocks.count()
        whole = width >= values_n and offset == 0
        if whole or (after == before and offset > 0):
            break
        before, offset = after, offset + width // 2
        wide = blocks.groupBy(F.floor((F.col("place") + F.lit(offset)) / F.lit(2 * width))).count().agg(F.max("count").alias("m")).first()
        if wide["m"] <= chunk:
            width *= 2
    return blocks.select("first_x", "last_x", "weight", (F.col("total") / F.col("weight") * sign).alias("value"))


def step_ends(steps: DataFrame) -> DataFrame:
    """(x, value, weight): the first and the last feature value of every step, its weight shared between them. The fit
    of these rows is the fit of all rows."""
    ends = F.when(F.col("first_x") == F.col("last_x"), F.array("first_x")).otherwise(F.array("first_x", "last_x"))
    return steps.select(F.explode(ends).alias("x"), "value", (F.col("weight") / F.size(ends)).alias("weight"))
