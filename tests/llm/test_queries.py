"""The registered queries against their SQL, and the pipeline against brute force over its stages."""
import math
import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from obsguard.llm import common, oracle, queries
from test_corpus_operators import _components_by_hand, _fingerprint_by_hand, _hits_by_hand

TABLES = ["documents", "benchmark", "labels", "embeddings", "conversations"]
CONTRACT = {
    "op1_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op3_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int",
                     "slot": "bigint", "grown_shard": "int"},
    "op4_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op8_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint",
                           "items_sha256": "string", "contaminated": "boolean"},
    "op11_lexical_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op12_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op13_merkle_manifest": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string",
                             "folded_root": "string", "verified": "boolean"},
}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(oracle.registered()))
def test_query_matches_sql(spark, sf_small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    sdf = queries.registered()[name](spark, sf_small)
    res = con.execute(oracle.registered()[name])
    names = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(names)
    mine = sorted((tuple(_norm(r[c]) for c in sorted(names)) for r in sdf.collect()), key=repr)
    theirs = sorted((tuple(_norm(r[names.index(c)]) for c in sorted(names)) for r in res.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns_of_the_contract(spark, sf_small, name):
    out = queries.registered()[name](spark, sf_small)
    types = dict(out.dtypes)
    assert {c: types.get(c) for c in CONTRACT[name]} == CONTRACT[name]
    rows = out.collect()
    if "doc_id" in types and name != "op11_lexical_search":
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in common.table(spark, sf_small, "documents").collect())
    if "held_out" in types:
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    if "predicted" in types:
        cut = 0.3 if name == "op1_quality" else 0.5
        assert all(r.predicted == int(r.score >= cut) and 0 <= r.score <= 1 for r in rows)


def test_pipeline_stages(spark, sf_small):
    docs = common.table(spark, sf_small, "documents")
    items = [(r.item_id, r.text) for r in common.table(spark, sf_small, "benchmark").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "shard"]
    stage = dict(corpus_pipeline.STAGES)
    odd = docs.unionByName(spark.createDataFrame([(9000, "12 34 !!", "en", "s", 1), (9001, None, "en", None, 1)], docs.schema))

    told = common.saved(stage["language"](spark, odd, sf_small))
    assert told.columns == docs.columns
    assert sorted(r.doc_id for r in told.collect()) == sorted(r.doc_id for r in docs.collect())

    single = common.saved(stage["near_duplicates"](spark, told, sf_small))
    want = _components_by_hand({r.doc_id: _fingerprint_by_hand(r.text) for r in told.collect()})
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(set(want.values()))

    clean = common.saved(stage["decontaminate"](spark, single, sf_small))
    left = [r.doc_id for r in single.collect() if not _hits_by_hand(r.text, items)[-1]]
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == sorted(left)

    mixed = common.saved(stage["mix"](spark, clean, sf_small))
    counts = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(counts) <= set(left) and max(counts.values()) <= 2

    out = stage["shard"](spark, mixed, sf_small).collect()
    assert Counter(r.doc_id for r in out) == counts
    for s in range(8):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))


def test_run_gives_the_same_rows_again(spark, sf_small):
    a = corpus_pipeline.run(spark, sf_small).select("doc_id", "shard", "slot")
    b = corpus_pipeline.run(spark, sf_small).select("doc_id", "shard", "slot")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
