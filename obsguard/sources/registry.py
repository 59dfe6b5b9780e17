"""Model registry: fitted pipelines saved with MLWriter, indexed by a log of numbered entries.

Key = (task, attribute, family, config_hash). Every save writes a new model directory, never an existing one, and then
commits an entry to the log: a small file that takes the next free number by a rename that fails if the number is taken
(whoever loses tries the next one and counts again, so concurrent saves get distinct versions). Readers see a prefix of the
log: entries appear whole or not at all, nothing is ever changed or replaced, and clearing is an entry too, so no
reader breaks and no model is touched. After `COMPACT` entries a snapshot of the log is written as Parquet beside it, and
readers start from the newest whole one. Paths live under one root, which on a cluster is shared storage.

The rename is atomic on HDFS. Where a file system checks and then moves (a local one), a lock orders the threads of one
driver.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY_SCHEMA = ("task string, attribute string, family string, config_hash string, version bigint, "
                   "path string, created_at timestamp, metric double, features string, featuriser string")
_ENTRY = f"entry bigint, kind string, {REGISTRY_SCHEMA}"
COMPACT = 64
_commits = threading.Lock()


class ModelRegistry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.log_path = f"{self.root}/registry/log"
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    # -- the log -------------------------------------------------------------------------------
    def _names(self, folder: str) -> list[str]:
        """Names in a folder; a folder that was never written is empty, any other failure is raised."""
        where = self._hadoop.Path(folder)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _state(self) -> tuple[int, list[str]]:
        """(entries in the newest whole snapshot, names of the later entry files)."""
        done = 0
        for name in reversed([n for n in self._names(f"{self.root}/registry") if n.startswith("snapshot-")]):
            if "_SUCCESS" in self._names(f"{self.root}/registry/{name}"):
                done = int(name.split("-")[1])
                break
        return done, [n for n in self._names(self.log_path) if n.endswith(".json") and int(n[:-5]) > done]

    def entries(self) -> DataFrame:
        """The log as it is now: (entry, kind, index columns)."""
        done, later = self._state()
        out = self.spark.createDataFrame([], _ENTRY)
        if done:
            out = out.unionByName(self.spark.read.schema(_ENTRY).parquet(f"{self.root}/registry/snapshot-{done:012d}"))
        if later:
            read = self.spark.read.schema(_ENTRY).option("mode", "FAILFAST").option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
            out = out.unionByName(read.json([f"{self.log_path}/{n}" for n in later]))
        return out

    def _commit(self, row: dict, numbered) -> int:
        """Append an entry under the next free number; `numbered(n)` completes the row for that number."""
        context = self._hadoop.FileContext.getFileContext(self._hadoop.Path(self.root).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        while True:
            done, later = self._state()
            n = max([done, *(int(x[:-5]) for x in later)]) + 1
            text = json.dumps({"entry": n, **row, **numbered(n)}, default=str)
            draft = f"{self.root}/registry/drafts/{uuid.uuid4().hex}"
            self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(draft)
            part = next(x for x in self._names(draft) if x.startswith("part-"))
            target = self._hadoop.Path(f"{self.log_path}/{n:012d}.json")
            try:
                with _commits:
                    target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target.getParent())
                    context.rename(self._hadoop.Path(f"{draft}/{part}"), target, no_options)
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                    raise
                continue                       # somebody else took the number
            finally:
                context.delete(self._hadoop.Path(draft), True)
            if n - done >= COMPACT:
                self.compact()
            return n

    def compact(self) -> None:
        """Write the log up to now as one Parquet snapshot. Entry files stay, for readers that have listed them."""
        _, later = self._state()
        if later:
            n = int(later[-1][:-5])
            self.entries().coalesce(1).write.mode("ignore").parquet(f"{self.root}/registry/snapshot-{n:012d}")

    # -- table ---------------------------------------------------------------------------------
    def table(self) -> DataFrame:
        """The index: the saves since the last clearing. A registry that was never written is empty."""
        log = self.entries()
        cleared = log.where("kind = 'clear'").agg(F.coalesce(F.max("entry"), F.lit(0)).alias("cleared"))
        kept = log.where("kind = 'save'").join(F.broadcast(cleared), F.col("entry") > F.col("cleared"))      # one row
        return kept.select(*[c.split()[0] for c in REGISTRY_SCHEMA.split(", ")])

    def _key(self, task, attribute, family, config_hash=None):
        cond = (F.col("task") == task) & (F.col("attribute") == attribute) & (F.col("family") == family)
        if config_hash is not None:
            cond = cond & (F.col("config_hash") == config_hash)
        return cond

    def list_models(self) -> DataFrame:
        return self.table().select("task", "attribute", "family", "config_hash", "version", "created_at", "metric",
                                   "features")

    def exists(self, task, attribute, family, config_hash=None) -> bool:
        return self.table().where(self._key(task, attribute, family, config_hash)).limit(1).count() > 0

    def latest(self, task, attribute, family, config_hash=None):
        return (self.table().where(self._key(task, attribute, family, config_hash))
                .orderBy(F.col("created_at").desc(), F.col("version").desc(), F.col("path")).limit(1).first())

    # -- models --------------------------------------------------------------------------------
    def save(self, model: PipelineModel, task, attribute, family, config_hash, metric=None, features=(), featuriser=None) -> str:
        """Save under a fresh directory and commit the entry; returns the directory. `featuriser` is the folder of the
        fitted featuriser that makes this model's features. Versions count all saves of a key."""
        path = f"{self.root}/models/{task}/{family}/{uuid.uuid4().hex}"
        model.write().save(path)      # fails rather than replacing anything
        row = {"kind": "save", "task": task, "attribute": attribute, "family": family, "config_hash": config_hash, "path": path,
               "created_at": dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f"),
               "metric": None if metric is None else float(metric), "features": "\n".join(features), "featuriser": featuriser}

        def numbered(n: int) -> dict:
            saves = self.entries().where((F.col("kind") == "save") & (F.col("entry") < n) & self._key(task, attribute, family, config_hash))
            return {"version": saves.count() + 1}

        self._commit(row, numbered)
        return path

    def load(self, task, attribute, family, config_hash=None, features=None) -> PipelineModel:
        """The latest model of a key; with `features`, only if it was trained on just these, in this order."""
        row = self.latest(task, attribute, family, config_hash)
        if row is None:
            raise KeyError(f"no model ({task}, {attribute}, {family}, {config_hash}) in registry {self.root}")
        if features is not None and (row["features"] or "") != "\n".join(features):
            raise ValueError(f"the model at {row['path']} was trained on features {(row['features'] or '').split()}, "
                             f"not on {list(features)}")
        return PipelineModel.load(row["path"])

    def clear(self) -> None:
        """Empty the index from here on (model directories stay until storage cleanup)."""
        self._commit({"kind": "clear"}, lambda n: {})


def default_root(spark: SparkSession) -> str:
    """Registry root next to the session's checkpoint folder (shared storage on a cluster)."""
    from ..session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark)
    return os.path.join(os.path.dirname(base.rstrip("/")), "obsguard-registry")
