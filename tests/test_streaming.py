"""The stateless row operators run unchanged on a streaming DataFrame (file source, memory sink)."""
import tempfile

from pyspark.sql import functions as F

from obsguard.functions.exprs import binarize_status
from obsguard.operators import clean
from obsguard.operators.inject import SuspectInjector
from obsguard.sources import fixtures


def _rows(spark, sf_small, df_fn):
    li = spark.read.parquet(f"{sf_small}/lineitem.parquet")
    stream = spark.readStream.schema(li.schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_small)
    out = df_fn(fixtures.obs_from_lineitem(stream))
    ckpt = tempfile.mkdtemp(prefix="obsguard-stream-", dir="/tmp")
    q = (out.writeStream.format("memory").queryName("obs_stream_out").outputMode("append")
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.sql("SELECT * FROM obs_stream_out").collect()
    spark.catalog.dropTempView("obs_stream_out")
    batch = df_fn(fixtures.obs_from_lineitem(li)).collect()
    return got, batch


def test_row_operators_on_stream(spark, sf_small):
    def plan(df):
        df = clean.complete_rows(df)
        df = clean.as_of(df, 946598400000)
        df = SuspectInjector(key_cols=("obs_key", "timestamp")).zeroes(df, ["li_ua_quantity"], 3)
        return df.withColumn("label", binarize_status("li_ua_quantity_status")).select(
            "obs_key", "timestamp", "li_ua_quantity_value", "label")

    got, batch = _rows(spark, sf_small, plan)
    assert len(got) == len(batch) > 0
    assert sorted(got, key=repr) == sorted(batch, key=repr)
    assert any(r["li_ua_quantity_value"] == 0.0 for r in got)
    assert F is not None
