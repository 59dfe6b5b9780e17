"""Helpers shared by the corpus operators: column selection, hold-out rule, shared scratch tables."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

HOLD_OUT_FOLDS = 5
SLICE_BYTES = 1 << 21    # of an Arrow batch that are worked on, and sent back, together


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark only (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(HOLD_OUT_FOLDS)


def held_out(id_col: Column) -> Column:
    """Rows kept out of training. A null id has no fold: it is not held out and never learned from."""
    return F.coalesce(fold(id_col) == 0, F.lit(False))


def trainable(id_col: Column) -> Column:
    return F.coalesce(fold(id_col) != 0, F.lit(False))


def uniform(*cols: Column, seed: int) -> Column:
    """A draw in [0, 1) that is a pure function of the columns and the seed (53 bits of XXH64)."""
    bits = F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def saved(df: DataFrame, name: str = "table", options: dict[str, str] | None = None) -> DataFrame:
    """Write a frame as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage on storage that every executor sees, column-compressed, so a lost executor costs
    only the tasks it was running. `options` are the writer's.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of frames that are done: it learns of them by garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows, without copies, of about SLICE_BYTES each (one row at least).

    Spark fills a batch by rows, however long their texts: its strings, and their copies, are made for one run at a time."""
    rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def add_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable], inputs: list[str], schema: str,
                keep: list[str] | None = None) -> DataFrame:
    """Append columns computed per Arrow batch; a computed column replaces an input column of its name.

    `fn` gets a run of a batch's rows, with `inputs` first (aliased positionally as i0, i1, ...), and returns one array
    per field of `schema`; the kept input columns travel beside them in the same batch.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    new = _parse_datatype_string(schema)
    names = {f.name for f in new.fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    # a kept input travels once
    sent = list(dict.fromkeys(c for c in kept if c not in inputs))
    part = df.select(*[F.col(f"`{c}`").alias(f"i{i}") for i, c in enumerate(inputs)],
                     *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(sent)])
    places = [inputs.index(c) if c in inputs else len(inputs) + sent.index(c) for c in kept]
    kept_fields = [df.schema[c] for c in kept]
    out_schema = StructType([type(f)(f"k{i}", f.dataType, True) for i, f in enumerate(kept_fields)] + new.fields)
    new_types = [f.type for f in to_arrow_schema(new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (run_of for whole in batches for run_of in slices(whole)):
            cols = fn(batch)
            arrays = [batch.column(i) for i in places]
            arrays += [pa.array(c, type=t) for c, t in zip(cols, new_types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in out_schema.fields])

    out = part.mapInArrow(run, out_schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *[f.name for f in new.fields])


def texts_of(array: pa.Array) -> list[str]:
    """Python strings of an Arrow text column; null reads as the empty text."""
    return ["" if t is None else t for t in array.to_pylist()]


def stratified_sample(rows: DataFrame, label: str, id_col: str, per_class: int, seed: int) -> tuple[DataFrame, dict]:
    """About `per_class` rows of each label, chosen by a hash of the id; also the exact label counts.

    The counts run over all rows; only one number per label reaches the driver. A label is kept whole
    when it has fewer rows.
    """
    counts = {r[0]: int(r[1]) for r in rows.groupBy(label).agg(F.count(F.lit(1))).collect() if r[0] is not None}
    if not counts:
        return rows.where(F.lit(False)), {}
    cut = F.lit(False)
    for value, n in counts.items():
        cut = cut | ((F.col(label) == F.lit(value)) & (F.col("_u") < F.lit(min(1.0, per_class / n))))
    drawn = rows.withColumn("_u", uniform(F.col(id_col), seed=seed)).where(cut).drop("_u")
    return drawn, counts
