"""The registry's log: distinct versions under concurrent saves, readers that nothing breaks, snapshots."""
from multiprocessing.pool import ThreadPool

import pytest
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer

from obsguard.sources import registry
from obsguard.sources.registry import ModelRegistry


@pytest.fixture()
def model():
    return PipelineModel(stages=[SQLTransformer(statement="SELECT * FROM __THIS__")])


def test_concurrent_saves_get_distinct_versions(spark, model, tmp_path):
    root = str(tmp_path / "r")

    def save(i):
        return ModelRegistry(spark, root).save(model, "t", "a", "f" if i % 3 else "g", "h", metric=float(i))

    with ThreadPool(6) as pool:
        paths = pool.map(inheritable_thread_target(spark)(save), range(9))
    rows = ModelRegistry(spark, root).table().collect()
    assert len(set(paths)) == 9 and {r.path for r in rows} == set(paths)
    assert sorted(r.version for r in rows if r.family == "f") == [1, 2, 3, 4, 5, 6]
    assert sorted(r.version for r in rows if r.family == "g") == [1, 2, 3]


def test_clearing_breaks_no_reader(spark, model, tmp_path):
    reg = ModelRegistry(spark, str(tmp_path / "r"))
    first = reg.save(model, "t", "a", "f", "h")
    listed = reg.list_models()          # planned before, read after
    reg.clear()
    assert listed.count() == 1 and reg.list_models().count() == 0 and not reg.exists("t", "a", "f")
    second = reg.save(model, "t", "a", "f", "h")
    assert reg.latest("t", "a", "f")["path"] == second != first and reg.latest("t", "a", "f")["version"] == 2
    assert PipelineModel.load(first) is not None


def test_snapshots_hold_the_log(spark, model, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "COMPACT", 3)
    reg = ModelRegistry(spark, str(tmp_path / "r"))
    for i in range(4):
        reg.save(model, "t", f"a{i}", "f", "h", metric=0.5, features=["x", "y"])
    assert reg._state() == (3, ["000000000004.json"])
    before = reg.list_models()
    (tmp_path / "r" / "registry" / "snapshot-000000000004").mkdir()          # a snapshot that was not finished
    assert sorted(r.attribute for r in reg.list_models().collect()) == ["a0", "a1", "a2", "a3"] and before.count() == 4
    row = reg.latest("t", "a2", "f")
    assert row.metric == 0.5 and row.features == "x\ny" and row.featuriser is None and row.version == 1
    assert [x.name for x in (tmp_path / "r" / "registry" / "drafts").iterdir() if not x.name.startswith(".")] == []
