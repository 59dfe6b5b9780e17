"""A durable ledger of finished grid cells, so that a search that was stopped goes on where it was.

Entries are small Parquet appends under one folder of shared storage: the search's key, the cell, its metric. The key
names everything that decides a cell's metric: task, family, settings and a fingerprint of the training rows that does not
depend on their order or partitions. Cells that failed are not entered: a restart tries them again.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "search string, cell string, metric double"


def fingerprint(df: DataFrame, content) -> str:
    """The rows as a bag: their number, and sums of two parts of a hash of each; the same in any order."""
    h = df.select(content.alias("h"))
    low = F.col("h").bitwiseAND(F.lit((1 << 31) - 1))
    r = h.agg(F.count(F.lit(1)).alias("n"), F.sum(low).alias("a"), F.sum(F.shiftrightunsigned("h", 33)).alias("b")).first()
    return f"{r['n']}-{r['a'] or 0}-{r['b'] or 0}"


def search_key(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def cell_name(values: dict) -> str:
    return json.dumps(values, sort_keys=True, default=str)


class CellLedger:
    def __init__(self, spark: SparkSession, path: str, search: str):
        self.spark, self.path, self.search = spark, path.rstrip("/"), search

    def entries(self) -> DataFrame:
        """All entries. A ledger that was never written is empty; any other failure to read is raised."""
        try:
            return self.spark.read.schema(_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{self.path}/cells")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _SCHEMA)

    def finished(self) -> dict[str, float]:
        """cell -> metric of this search's finished cells (a grid is small)."""
        mine = self.entries().where(F.col("search") == self.search).groupBy("cell").agg(F.max("metric").alias("metric"))
        return {r["cell"]: r["metric"] for r in mine.collect()}

    def enter(self, cells: list[tuple[str, float]]) -> None:
        """Append finished cells, each call as a folder of its own: concurrent searches never meet."""
        if cells:
            rows = [(self.search, c, float(m)) for c, m in cells]
            self.spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.parquet(f"{self.path}/cells/{uuid.uuid4().hex}")

    def compact(self) -> None:
        """Rewrite the entries as one file and remove the folders they came from. For quiet times: a search that reads
        while it runs may miss cells and fit them again."""
        from ..session import discard

        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/cells")
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return
        old = [s.getPath().toString() for s in fs.listStatus(where)]
        kept = self.entries().groupBy("search", "cell").agg(F.max("metric").alias("metric"))
        kept.coalesce(1).write.parquet(f"{self.path}/cells/{uuid.uuid4().hex}")
        for folder in old:
            discard(self.spark, folder)
