"""Mixing, sharding, token counts, near-duplicates, chat, neighbours, decontamination: brute force and edges."""
import hashlib
import re
import zlib
from collections import defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from obsguard.llm import chat, common, decontam, mixing, neighbours, queries, sharding, simhash, tokens
from obsguard.session import ensure_checkpoint_dir

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SMALL, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en", None, None), (2, "", None, "b", 0), (None, "lone words here", "en", "b", 1),
            (None, None, None, None, None), (5, "x" * 300_000, "en", "a", 1), (6, "same text of some words", "en", "a", 1),
            (6, "same text of some words", "en", "a", 1), (7, "same text of some words", "en", "", 1),
            (8, "tab\tand nbsp  em\x0bvt", "fr", "c", 3)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- mixing ------------------------------------------------------------------------------------------

def _mix_by_hand(sizes: dict) -> dict:
    """Targets by repeated resharing. sizes: source -> words."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total = 1.5 * sum(sizes.values())
    target, open_sources = {s: 0.0 for s in order}, set(order)
    while total > 1e-9 and open_sources:
        share = total / sum(weight[s] for s in open_sources)
        total = 0.0
        for s in sorted(open_sources, key=order.index):
            target[s] += share * weight[s]
            if target[s] >= 2 * sizes[s]:
                total += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_sources.discard(s)
    return target


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mixture(which, request):
    table = request.getfixturevalue(which)
    got = mixing.mix(table).join(table.select("doc_id", "source").distinct(), "doc_id") if which == "docs" else None
    rows = mixing.mix(table).collect()
    texts = table.collect()
    sizes = defaultdict(int)
    for r in texts:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    target = _mix_by_hand(sizes)
    assert sorted({round(r.target, 3) for r in rows}) == sorted({round(t, 3) for t in target.values()})
    assert len(rows) == len(texts) and all(r.taken == r.copies * r["size"] and r.taken <= 2 * r["size"] for r in rows)
    if got is not None:
        taken, largest = defaultdict(int), defaultdict(int)
        for r in got.collect():
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r["size"])
        assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in target)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(table.repartition(5)).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 29, 77])
def test_mixture_meets_its_target_where_ids_repeat(spark, seed):
    """300 of 600 rows share an id (some of them the whole row), 60 have none and one text: no source is a document off."""
    rows = [(7 if i < 300 else None if i < 360 else i, "a" if i % 2 else "b", "w " * (5 if i < 200 or 300 <= i < 360 else 5 + i % 7))
            for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(3)
    got = mixing.mix(table, seed=seed)
    assert got.count() == 600
    for r in got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= r.most
    assert got.where("taken > 2 * size").isEmpty()
    copies = mixing.mixture(table, seed=seed)
    assert copies.count() == got.agg(F.sum("copies")).first()[0]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, mixing.mix(table, seed=seed).collect()), key=repr)


def test_mixture_rows_follow_the_plan(docs, empty):
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    counted = {r.doc_id: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counted == {d: c for d, c in copies.items() if c}
    assert mixing.mix(empty).count() == 0 and mixing.mixture(empty).count() == 0


def test_ranking_follows_random_over_inclusion_odds(spark):
    rows = [(b << 40, c / 10) for b in (1, 900, 2000, 4000) for c in (1, 5, 9)]
    got = spark.createDataFrame(rows, "bits long, chance double").withColumn(
        "k", mixing.ranking(F.col("bits"), F.col("chance"))).collect()

    def odds(r):
        u = (r.bits + 0.5) / 2 ** 52
        return u / (1 - u) / (r.chance / (1 - r.chance))

    assert [r.k for r in sorted(got, key=odds)] == sorted(r.k for r in got)


# -- sharding ----------------------------------------------------------------------------------------

def _check_shards(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    return {s: sum(r["size"] for r in by.get(s, [])) for s in range(shards)}


@pytest.mark.parametrize("parts", [1, 3])
def test_shards(docs, parts):
    rows = sharding.shard_documents(docs, keep=["doc_id"], parts=parts).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
               and r.law == "bytes" and r.grown_shard is None for r in rows)
    sizes = _check_shards(rows, 8)
    fair, largest = sum(sizes.values()) / 8, max(r["size"] for r in rows)
    assert all(abs(s - fair) <= largest + 0.02 * fair for s in sizes.values())
    groups = defaultdict(set)
    for r in rows:
        groups[texts[r.doc_id]].add(r.shard)
    assert all(len(g) == 1 for g in groups.values())


def test_a_hot_group_is_cut_and_edges_hold(spark, odd, empty):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "one text").otherwise(
        F.concat(F.lit("text "), "id")).alias("text"), F.lit("clash").alias("shard"), F.lit(1).alias("h1"))
    out = sharding.shard_documents(hot, 8, parts=2)
    assert out.columns == ["doc_id", "text", "h1", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    sizes = _check_shards(out.collect(), 8)
    assert max(sizes.values()) - min(sizes.values()) <= 0.03 * sum(sizes.values()) / 8 + 20
    rows = sharding.shard_documents(odd, 3, parts=2).collect()
    assert len(rows) == odd.count() and {r.text_crc32 for r in rows if r.text is None} == {0}
    _check_shards(rows, 3)
    assert sharding.shard_documents(empty).count() == 0
    same = spark.range(10).select(F.lit(1).alias("doc_id"), F.lit("t").alias("text"))
    _check_shards(sharding.shard_documents(same, 4, parts=1).collect(), 4)


@pytest.mark.parametrize("seed", range(3))
def test_groups_up_to_half_a_shard_stay_whole(spark, seed):
    """Several groups of equal texts between a tenth and half of a fair shard; one of more than half is cut."""
    rng = np.random.default_rng(seed)
    rows, share = [], [0.1, 0.3, 0.45, 0.49, 0.2, 0.8]
    for g, s in enumerate(share):
        rows += [f"group {g} {seed} " + "x" * 89] * int(s * 100)
    rows += [f"{seed} {i} " + "y" * int(rng.integers(20, 160)) for i in range(400 - len(rows))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for parts in (1, 3):
        out = sharding.shard_documents(docs, 4, parts=parts).collect()
        sizes = _check_shards(out, 4)
        fair = sum(sizes.values()) / 4
        groups = defaultdict(lambda: [set(), 0])
        for r in out:
            groups[r.text][0].add(r.shard)
            groups[r.text][1] += r["size"]
        assert all(len(g) == 1 for g, b in groups.values() if b <= sharding.WHOLE * fair)
        assert max(abs(s - fair) for s in sizes.values()) <= 0.5 * fair


def test_a_task_sorts_one_part_and_holds_it_once(spark):
    """Every part is a partition of its own (dealt by hash, several met in one), and no window buffers it again."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    out = sharding.shard_documents(docs, 8, parts=4)
    tasks = out.withColumn("task", F.spark_partition_id()).groupBy("task").agg(
        F.sum("size").alias("bytes"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.count(F.lit(1)).alias("n")).collect()
    assert len(tasks) == 32 and all(r.high - r.low + 1 == r.n for r in tasks)
    assert max(r.bytes for r in tasks) <= 1.6 * sum(r.bytes for r in tasks) / 32
    assert "Window" not in out._jdf.queryExecution().toString()
    _check_shards(out.collect(), 8)


def test_sharding_plan_is_native(docs):
    plan = sharding.shard_documents(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# -- token counts ------------------------------------------------------------------------------------

def test_token_counts(docs, odd, empty):
    encode = tokens.encoder(tokens.RANK_FILE, tokens.PATTERN).encode_ordinary
    for table in (docs, odd):
        lengths = np.array([len(encode(r.text or "")) for r in table.collect()])
        sums = common.saved(tokens.suffix_sums(tokens.length_histogram(tokens.token_lengths(table.select("text")))))
        for r in sums.collect():
            n = r.n_tokens
            assert (r.docs, r.docs_from, r.docs_upto) == ((lengths == n).sum(), (lengths >= n).sum(), (lengths <= n).sum())
            assert r.tokens_from == lengths[lengths >= n].sum() and r.total_tokens == lengths.sum()
            assert r.tokens_if_cut == np.minimum(lengths, n).sum()
        for r in tokens.at_limits(sums, [0, 1, 7, 128, 2048, 10 ** 9]).collect():
            assert r.tokens_kept == np.minimum(lengths, r.context).sum() and r.docs_cut == (lengths > r.context).sum()
            assert r.tokens_lost == lengths.sum() - r.tokens_kept
        for r in tokens.length_quantiles(sums, [0.0, 0.1, 0.5, 0.99, 1.0]).collect():
            assert r.n_tokens == min(n for n in lengths if (lengths <= n).mean() >= r.share - 1e-12)
    none = tokens.suffix_sums(tokens.length_histogram(tokens.token_lengths(empty.select("text"))))
    assert none.count() == 0 and tokens.at_limits(none, [5]).collect()[0].tokens_kept == 0


# -- near duplicates ---------------------------------------------------------------------------------

def _fingerprint_by_hand(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components_by_hand(prints: dict) -> dict:
    """doc -> least doc reachable over fingerprints within 4 bits."""
    docs = list(prints)
    parent = {d: d for d in docs}

    def find(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    for a, b in combinations(docs, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}


def test_covering_triples():
    triples = simhash.covering_triples()
    assert len(set(triples)) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_fingerprints_match_spark_hash(spark, odd):
    texts = ["one", "A b C d", "Ünï cödé x y z w v", "a  b\tc\nd e " * 40, "", None] + [r.text for r in odd.collect()]
    assert [simhash.fingerprint(t) for t in texts] == [_fingerprint_by_hand(t) for t in texts]
    got = spark.createDataFrame([("one two three four",)], "t string").select(F.xxhash64("t")).first()[0]
    assert simhash.fingerprint("one two three four") == got % (1 << 64)


@pytest.mark.parametrize("longest", [simhash.LONG_LIST, 2])
def test_near_duplicates(spark, docs, longest):
    rows = docs.select("doc_id", "text").collect()
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 30
    extra = [(10_000 + i, base + " ".join(["tail"] * 0 + [f"w{i}"])) for i in range(12)] + [(20_000, ""), (20_001, None)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    prints = {d: _fingerprint_by_hand(t) for d, t in [(r.doc_id, r.text) for r in rows] + extra}
    want = _components_by_hand(prints)
    got = simhash.near_duplicates(table, longest=longest).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints and all(len(r.fingerprint) == 16 for r in got)
    kept = simhash.keep_one(table, longest=longest)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_list_links_span_the_same_parts():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    values = np.unique(np.array([c ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for c in centre
                                 for a, b in rng.integers(0, 64, (40, 2))], dtype=np.uint64))
    want = _components_by_hand({int(v): int(v) for v in values})
    for small in (2, 16, 200):
        a, b = simhash._list_links(np.zeros(len(values), np.int64), values, small)
        parent = {int(v): int(v) for v in values}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
        assert {v: find(v) for v in parent} == want


def test_components_of_a_long_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 100), (200, 201)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {201: 200}


def test_near_duplicate_edges(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert len(zero) == 3 and {r.component_id for r in zero} == {1}
    kept = simhash.keep_one(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 5), (False, 6), (False, 8), (True, 0)]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


# -- decontamination ---------------------------------------------------------------------------------

def _words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def _hits_by_hand(text, items, window=10):
    words, hit, ids = _words(text), set(), set()
    for item, item_text in items:
        own = _words(item_text)
        n = min(window, len(own))
        grams = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i:i + n]) in grams:
                hit |= set(range(i, i + n))
                if item is not None:
                    ids.add(str(item))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("blocks", [False, True])
def test_decontamination(spark, docs, odd, empty, blocks, monkeypatch):
    bench = common.table(spark, SMALL, "benchmark")
    first = bench.orderBy("item_id").first()
    more = [(900, first.text + " trailing"), (901, "two words"), (902, None), (903, " .,- "), (None, "lone words here"), (12, first.text)]
    bench = bench.unionByName(spark.createDataFrame(more, "item_id long, text string"))
    planted = [(5000, "before " + first.text.upper() + " after two-words end two words two words"),
               (5001, " ".join(_words(first.text)[:9])), (5002, "two. words, lone--words here" * 3), (5003, "two")]
    table = docs.unionByName(odd).unionByName(spark.createDataFrame(
        [(i, t, None, None, None) for i, t in planted], DOCS))
    if blocks:
        monkeypatch.setattr(decontam, "BLOCK_BYTES", 2000)
        monkeypatch.setattr(decontam, "SHARD_BYTES", 20_000)
    items = [(r.item_id, r.text) for r in bench.collect()]
    index = common.saved(decontam.build_index(table))
    got = decontam.summarise(decontam.search(index, bench)).collect()
    want = sorted(((r.doc_id, *_hits_by_hand(r.text, items)) for r in table.collect()), key=repr)
    assert sorted(((r.id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=repr) == want
    clean = decontam.drop_contaminated(table, bench)
    assert clean.columns == table.columns
    assert sorted((r.doc_id or -1) for r in clean.collect()) == sorted((w[0] or -1) for w in want if not w[-1])
    assert decontam.summarise(decontam.search(decontam.build_index(empty), bench)).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontam.summarise(decontam.search(index, none)).collect()} == {0}
    assert decontam.drop_contaminated(table, none).count() == table.count()


def test_proximity(spark):
    table = spark.createDataFrame([(1, "red green blue"), (2, "red x green blue"), (3, "green red blue"), (4, "red x x x green blue")],
                                  "doc_id int, text string")
    item = spark.createDataFrame([("i", "red green blue")], "item_id string, text string")
    index = decontam.build_index(table)
    found = {s: sorted(r.id for r in decontam.search(index, item, slop=s).collect() if r.matches) for s in (0, 1, 3)}
    assert found == {0: [1], 1: [1, 2, 3], 3: [1, 2, 3, 4]}
    with pytest.raises(ValueError):
        decontam.search(index, item, slop=decontam.GAP)


def test_index_round_trip():
    texts = ["a b a", None, "c", "", "b " * 500, "é9 x"]
    shard = decontam.Shard.build(texts)
    again = decontam.Shard.unpacked(*shard.packed())
    assert np.array_equal(shard.positions, again.positions) and np.array_equal(shard.terms, again.terms)
    assert list(shard.n_words) == [3, 0, 1, 0, 500, 2]


def test_packed_numbers_take_few_bytes():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**35 - 1, 2**62, 2**63 - 1, 0], dtype=np.int64)
    packed = decontam._varints(values)
    assert np.array_equal(decontam._numbers(packed), values)
    assert len(packed) == sum(max(1, -(-int(v).bit_length() // 7)) for v in values)
    assert len(decontam._numbers(decontam._varints(values[:0]))) == 0
    n_words, terms, counts, steps = decontam.Shard.build(["one two three " * 10_000] * 3).packed()
    assert len(steps) < 100_000 and len(counts) <= 9     # of 90,000 places of three terms


def test_the_index_is_written_in_groups_of_bounded_bytes(spark, tmp_path, monkeypatch):
    """A writer that looks at its size every hundred rows held a hundred shards at once."""
    monkeypatch.setattr(decontam, "GROUP_BYTES", 1 << 20, raising=False)
    item = "a passage that stands in the seventh of the documents and in no other one of them at all"
    text = F.concat(F.repeat(F.lit("red green blue "), 210_000), F.when(F.col("id") == 7, item).otherwise(""))   # a shard each
    spark.range(12).coalesce(1).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(kept.glob("decontam-index-*"))
    got = queries.op10_decontaminate(spark, str(tmp_path))
    (folder,) = set(kept.glob("decontam-index-*")) - before
    groups = [m.row_group(g) for f in folder.glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 12
    assert max(g.total_byte_size for g in groups) < 2 << 20 and max(g.num_rows for g in groups) <= 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1     # one set of Python workers in the stage that searches
    assert [tuple(r)[:4] for r in got.where("contaminated").collect()] == [(7, 630_019, 19, 1)]


def test_overlapping_and_repeated_matches_are_summed_up_once(spark):
    match = "array<struct<item:string,start:bigint,stop:bigint>>"
    rows = [(1, 50, [("b", 0, 10), ("a", 5, 12), ("b", 20, 30), (None, 21, 25), ("", 40, 41)]), (2, 9, []), (None, 0, []),
            (3, 8, [(None, 2, 4)]), (4, 9, [("é", 0, 2), ("z", 0, 2), ("\U0001F600", 1, 2), ("\uffff", 1, 2)])]
    got = {r.id: tuple(r)[1:] for r in decontam.summarise(spark.createDataFrame(rows, f"id long, n_words long, matches {match}")).collect()}
    sha = {k: hashlib.sha256(v.encode()).hexdigest() for k, v in {1: ",a,b", 2: "", 4: "z,é,\uffff,\U0001F600"}.items()}
    assert got == {1: (50, 23, 3, sha[1], True), 2: (9, 0, 0, sha[2], False), None: (0, 0, 0, sha[2], False),
                   3: (8, 2, 0, sha[2], True), 4: (9, 2, 4, sha[4], True)}


# -- chat --------------------------------------------------------------------------------------------

def test_perspectives(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "é!"), (1, 3, "ann", None), (1, 3, None, "who"),
             (2, None, "ann", "x"), (None, 1, "zed", "y"), (3, 0, "system", "only")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("perspective", F.lit(1))
    for size in (64, 2):
        rows = chat.rotate(table, segment=size).orderBy("conv_id", "perspective", "segment").collect()
        whole, masked = defaultdict(str), defaultdict(list)
        for r in rows:
            key = (r.conv_id, r.perspective)
            assert r.offset == len(whole[key])
            masked[key] += [r.text[m.start:m.stop] for m in r.mask]
            whole[key] += r.text
        assert set(whole) == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "ann"), (None, "zed")}
        assert whole[1, "bob"] == ("<|system|>\nbe kind<|end|>\n<|user|>ann\nhi<|end|>\n<|assistant|>\né!<|end|>\n"
                                   "<|user|>ann\n<|end|>\n<|user|>unknown\nwho<|end|>\n")
        assert masked[1, "ann"] == ["hi<|end|>\n", "<|end|>\n"] and masked[1, "bob"] == ["é!<|end|>\n"]
        assert max(r.n_turns for r in rows) <= size
    assert chat.rotate(table.limit(0)).count() == 0


# -- neighbours --------------------------------------------------------------------------------------

def _nearest_by_hand(ids, vectors, queries, k):
    out = []
    for i in queries:
        scored = sorted((-sum(float(a) * float(b) for a, b in zip(vectors[i], vectors[j], strict=True)), ids[j])
                        for j in range(len(ids)) if ids[j] != ids[i])
        out += [(ids[i], r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_neighbours(spark, block):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(90, 6)).astype(np.float32)
    vectors[10:30] = vectors[9]                               # ties
    vectors[40] *= 1000
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(100, None), (120, [0.0] * 6), (140, [float("nan")] * 6), (160, [1.0] * 5 + [None]), (180, [float("inf")] * 6),
           (200, [])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    for k in (5, 200):
        got = neighbours.nearest(table, F.col("vec_id") % 20 == 0, k, query_block=block, candidate_block=block).collect()
        want = _nearest_by_hand(list(range(90)), vectors, range(0, 90, 20), k)
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [w[:3] for w in want]
        assert all(abs(r.score - w[3]) <= 1e-9 * abs(w[3]) + 1e-12
                   for r, w in zip(sorted(got, key=lambda r: (r.query_id, r["rank"])), want, strict=True))
    assert neighbours.nearest(table.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest(table.where("vec_id >= 100"), F.lit(True)).count() == 0


def test_every_query_row_has_a_list_and_lengths_must_agree(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(40, 4))
    ids = [0, 0, 20, *range(1, 20), *range(21, 39)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(table, F.col("vec_id") % 20 == 0, 3, query_block=2, candidate_block=8).collect()
    want = [w for n in range(3) for w in _nearest_by_hand(ids, vectors, [n], 3)]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(w[:3] for w in want)
    odd_one = spark.createDataFrame([(99, [1.0, 2.0])], table.schema)
    with pytest.raises(ValueError, match="components"):
        neighbours.nearest(table.unionByName(odd_one), F.lit(True))


def test_int8_bounds_hold():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 33)) * rng.lognormal(size=(200, 1))
    t = neighbours.Tile(np.arange(200), x)
    near = (t.small.astype(float) @ t.small.T.astype(float)) * t.scale[:, None] * t.scale
    bound = t.norm[:, None] * t.off + t.off[:, None] * t.rounded_norm
    assert (np.abs(x @ x.T - near) <= bound * (1 + 1e-9) + 1e-12).all()
