"""Ranked search, Jaccard join and Merkle manifest: brute force, edges, and the parts their methods name."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsguard.llm import jaccard, lexical, manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    long_text = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, "en", None, None), (2, "", None, "b", 0), (None, "Lone words here", "en", "b", 1),
            (None, None, None, None, None), (5, long_text, "en", "a", 1), (6, "same text of some words twice", "en", "a", 1),
            (6, "same text of some words twice", "en", "a", 1), (7, "same text of some words twice", "en", "", 1),
            (6, "SAME text of some words twice", "de", "a", 1), (8, "tab\tand nbsp em\x0bvt", "fr", "c", 3),
            (-9, long_text + " end", "en", "a", 2), (1 << 40, "same text of some words", "", "a", 9), (11, "!!! ...", "fr", "c", 0)]
    rows += [(100 + i, "near copies of one text " + " ".join(f"x{j}" if j != i else "other" for j in range(60)), "en", "a", i) for i in range(40)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def clashing(df):
    """The same table with more columns, named like helpers."""
    more = ["q", "score", "rank", "h", "n", "cls", "key", "comp", "digest", "rid", "kind", "tree", "at", "nodes", "leaf", "chunk", "_n", "_pid", "id", "th"]
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(more)])


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- ranked search -----------------------------------------------------------------------------------

def _terms(text):
    fold = {c: c + 32 for c in range(65, 91)}
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))


def _ranked_by_hand(docs, items, k=50):
    tf = [(i, Counter(_terms(t))) for i, t in docs]
    full = [(i, c) for i, c in tf if c]
    n_docs, n_terms = len(full), sum(sum(c.values()) for _, c in full)
    df = Counter(t for _, c in full for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in full:
            n = sum(c.values())
            m = 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(_terms(text)) if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def test_search_equals_brute_force(spark, odd):
    items = spark.createDataFrame([(1, "some words HERE"), (2, None), (3, "nothing of this"), (1, "x1 x2 w3 near text"), (4, "")], "item_id long, text string")
    index = lexical.build_index(clashing(odd))
    got = lexical.search(index, items.withColumn("score", F.lit(1)), k=7)
    want = _ranked_by_hand([(r.doc_id, r.text) for r in odd.collect()], [tuple(r) for r in items.collect()], 7)
    assert rows_of(got) == want and got.columns == ["query_id", "rank", "doc_id", "score"]
    assert rows_of(lexical.search(index, items, k=7, block_bytes=20)) == want      # several blocks of queries


def test_search_of_nothing(spark, odd):
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert not lexical.search(lexical.build_index(odd.where("false")), items).count()
    assert not lexical.search(lexical.build_index(odd), items.where("false")).count()
    assert not lexical.search(lexical.build_index(odd.select(F.col("doc_id"), F.lit(None).cast("string").alias("text"))), items).count()


@pytest.mark.parametrize("seed", range(6))
def test_best_positions_find_the_top_and_stop_early(seed):
    rng = np.random.default_rng(seed)
    n, lists, dense = 3000, [], np.zeros((4, 3000), np.int64)
    for t in range(4):
        docs = np.sort(rng.choice(n, 1500, replace=False))
        impact = (rng.pareto(1.5, 1500) * 50).astype(np.int64) if seed % 2 else rng.integers(1, 4, 1500)
        dense[t, docs] = impact
        lists.append(lexical.ImpactList(docs, impact))
    total = dense.sum(axis=0)
    best = np.lexsort((np.arange(n), -total))[:10]
    docs, scores, accesses = lexical.best_positions(lists, 10, first=8)
    assert docs.tolist() == best.tolist() and scores.tolist() == total[best].tolist()
    if seed % 2:
        assert accesses < 6000 / 2          # skewed impacts: far from the ends of the lists
    floor = int(total[best[4]])              # ten documents elsewhere reach this score: lesser ones may be left out
    docs, scores, _ = lexical.best_positions(lists, 10, floor, first=8)
    above = total[best] >= floor
    assert docs[:above.sum()].tolist() == best[above].tolist()


# -- Jaccard join ------------------------------------------------------------------------------------

def _set_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _linked_by_hand(docs):
    sets = [(i, _set_of(t)) for i, t in docs]
    at = list(range(len(sets)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                at[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(s), least.get(root(i))) for i, (doc, s) in enumerate(sets)), key=repr)


def test_jaccard_equals_brute_force(odd):
    want = _linked_by_hand([(r.doc_id, r.text) for r in odd.collect()])
    got = jaccard.jaccard_components(clashing(odd))
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and rows_of(got) == want
    assert rows_of(jaccard.jaccard_components(odd.where("false"))) == []


@pytest.mark.parametrize("seed", range(1))
def test_jaccard_of_chains_and_heavy_shingles(spark, seed, monkeypatch):
    """Chains of near copies around the threshold, with shingles that count as heavy, pivot rounds and salts."""
    monkeypatch.setattr(jaccard, "FIRST_PIVOTS", 1)
    monkeypatch.setattr(jaccard, "MORE_PIVOTS", 2)
    monkeypatch.setattr(jaccard, "HEAVY", 64)
    monkeypatch.setattr(jaccard, "LOCAL", 2)
    rng = np.random.default_rng(seed)
    docs = []
    for family in range(3):
        words = [f"f{family}w{i}" for i in range(rng.integers(8, 90))]
        for _ in range(40):
            words = list(words)
            for _ in range(rng.integers(0, 3)):
                words[rng.integers(len(words))] = f"n{rng.integers(10**6)}"
            docs.append((len(docs), " ".join(words[:rng.integers(max(1, len(words) - 6), len(words) + 1)])))
    common = " ".join(f"c{i}" for i in range(12))
    docs += [(len(docs) + i, f"{common} t{i} u{i}") for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows_of(jaccard.jaccard_components(df.repartition(4)))
    assert got == _linked_by_hand(docs)


@pytest.mark.parametrize("seed", range(20))
def test_suffix_filter_never_rejects_a_link(seed):
    rng = np.random.default_rng(seed)
    x, y = (np.unique(rng.integers(0, 120, rng.integers(1, 80))) for _ in range(2))
    both = len(np.intersect1d(x, y))
    assert jaccard.apart(x, y) <= len(x) + len(y) - 2 * both
    n_x, n_y = len(x) + int(rng.integers(0, 3)), len(y)
    assert jaccard.linked(x, y, n_x, n_y) == (100 * both >= 80 * (n_x + n_y - both))


# -- manifest ----------------------------------------------------------------------------------------

def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _enc(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def _tree(row):
    rows = [row]
    while len(rows[-1]) > 1:
        rows.append([_h(*rows[-1][i:i + 2]) for i in range(0, len(rows[-1]), 2)])
    return rows


def _path(rows, at):
    out = []
    for row in rows[:-1]:
        out.append((at % 2, row[at ^ 1] if at ^ 1 < len(row) else None))
        at //= 2
    return out


def _fold(value, path):
    for side, other in path:
        value = _h(value) if other is None else _h(other, value) if side else _h(value, other)
    return value


def _manifest_by_hand(docs):
    langs = defaultdict(list)
    for r in docs:
        fields = [r.doc_id, r.source, r.lang, r.n_chars, r.text]
        leaf = _h(_enc(*fields))
        other = leaf
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None:
            other = _h(_enc(r.doc_id, r.source, r.lang, r.n_chars + 1, r.text))
        langs[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf, other))
    order = sorted(langs, key=lambda v: (v is not None, (v or "").encode()))
    trees = {v: _tree([x[2] for x in sorted(langs[v])]) for v in order}
    top = _tree([trees[v][-1][0] for v in order]) if order else None
    out = []
    for at, v in enumerate(order):
        for i, (real, doc, leaf, other) in enumerate(sorted(langs[v])):
            path = _path(trees[v], i) + _path(top, at)
            folded = _fold(other, path)
            out.append((doc if real else None, leaf, trees[v][-1][0], top[-1][0], _h(*[o for _, o in path if o]), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [10, 2])
def test_manifest_equals_brute_force(odd, levels, monkeypatch):
    if levels == 2:
        monkeypatch.setattr(manifest, "PACK", 4)
    want = _manifest_by_hand(odd.collect())
    got = manifest.manifest(clashing(odd), levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows_of(got) == want
    assert rows_of(manifest.manifest(odd.where("false"))) == []


def test_manifest_of_far_apart_and_dense_ids(spark):
    ids = [-(1 << 63), -(1 << 62), -1, 0, 1, (1 << 63) - 1, *range(1 << 20, (1 << 20) + 5000), *[1 << 33] * 5]
    df = spark.createDataFrame([(i, f"t{n}", "en" if n % 3 else None, "s", (1 << 63) - 1 if n % 5 else 1) for n, i in enumerate(ids)], DOCS)
    assert rows_of(manifest.manifest(df.repartition(5))) == _manifest_by_hand(df.collect())


@pytest.mark.parametrize("size", [1, 100, 1500, 4096])
def test_ranks_of_a_container(size):
    rng = np.random.default_rng(size)
    places = np.sort(rng.choice(4096, size, replace=False))
    again = np.sort(rng.choice(places, min(size, 20), replace=False))
    packs = [(places, np.zeros(0, np.int64), np.zeros(0, np.int64)), (again, np.zeros(0, np.int64), np.zeros(0, np.int64))]
    c = manifest.Container.merged(packs)
    rows = np.sort(np.concatenate([places, again]))
    assert c.rows() == len(rows)
    rank, repeated = manifest.ranks_in(places, *c.packed())
    assert rank.tolist() == np.searchsorted(rows, places).tolist() and repeated.tolist() == np.isin(places, again).tolist()
