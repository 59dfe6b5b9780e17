"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 64 bits: bit b is 1 if it is set in over half of the XXH64 values (seed 42) of the text's
4-word shingles. Fingerprints link when at most 4 bits differ. Four differing bits spoil at most four of the
eight bytes, so linked fingerprints share at least four positional bytes. The inverted index lists the
distinct fingerprints under triples of positional bytes: twenty triples such that any four positions hold at
least one of them (Turan's construction for eight points). Pairs of one list are tallied (shared positional
bytes), kept from four on, and verified by their differing bits.

A list yields links that span its connected parts, not all its pairs. A list longer than `LONG_LIST` is not
compared within a task: its members are linked through all values within two bit flips of them, which finds
every pair within four flips exactly and is dealt out as rows. Components then come from alternating
large-star and small-star rounds over the links. Exact copies share a fingerprint and count once.

Cases: a null or empty text has no words and fingerprint zero, and links like any other; a null doc_id is
never a component's id unless the component has no other; repeated rows keep their rows; an empty table
gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join, materialise_small
from ..session import reliable_checkpoint
from . import common

SHINGLE = 4
BITS = 4                 # differing bits of linked fingerprints, at most
MIN_BYTES = 8 - BITS     # positional bytes that linked fingerprints share, at least
SEED = 42
LONG_LIST = 1 << 15
PENDING = 1 << 18        # links that a task holds before it contracts them
_CHUNK = 1 << 15         # shingles unpacked at a time


def covering_triples() -> list[tuple[int, int, int]]:
    """Twenty triples of byte positions; every four positions contain one.

    Positions fall into three groups. A triple lies inside one group, or has two positions in a group and
    the third in the next group around."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [t for g in groups for t in combinations(g, 3)]
    for i, g in enumerate(groups):
        out += [(*pair, c) for pair in combinations(g, 2) for c in groups[(i + 1) % 3]]
    return [tuple(sorted(t)) for t in out]


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = b"" if text is None else text.encode("utf-8", "replace").lower()   # A-Z only, as bytes
    words = words.split()                                                      # at 20 and 09 to 0D
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - SHINGLE + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        stop = min(at + _CHUNK, n)
        cuts = zip(starts[at:stop].tolist(), ends[at + SHINGLE - 1:stop + SHINGLE - 1].tolist(), strict=True)
        h = np.array([digest(joined[a:b], SEED) for a, b in cuts], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The kept columns and `fp`, the fingerprint as a signed long. One pass over whole texts."""

    def run(batch):
        values = np.array([fingerprint(t) for t in batch.column(0).to_pylist()], dtype=np.uint64)
        return [values.view(np.int64)]

    return common.add_columns(docs, run, [text_col], "fp bigint", keep=keep)


def hex_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _linked(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Tally shared positional bytes, keep pairs with enough of them, verify the differing bits."""
    x = np.ascontiguousarray(a ^ b)
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    ok = shared >= MIN_BYTES
    ok[ok] = np.bitwise_count(x[ok]) <= BITS
    return ok


def _spanning(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(v, w) pairs that connect every linked part of a list of distinct fingerprints, each part as a star."""
    left, right, rest = [], [], values
    while len(rest):
        first, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            near = _linked(rest, queue.pop())
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), first))
                right.append(found)
                queue.extend(found)
                rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections as stars around the least signed value of each part."""
    nodes, at = np.unique(np.concatenate([a, b]).view(np.int64), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        fresh = label.copy()
        np.minimum.at(fresh, label[x], low)
        np.minimum.at(fresh, label[y], low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    member = label != np.arange(len(nodes))
    return nodes[label[member]].view(np.uint64), nodes[member].view(np.uint64)


def _list_links(keys: np.ndarray, values: np.ndarray, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole lists, sorted by key: short lists all at once, longer ones one by one."""
    left, right = [], []
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([heads, [len(keys)]]))
    short = np.repeat(sizes <= small, sizes)
    k, v = keys[short], values[short]
    for step in range(1, small):
        same = np.flatnonzero(k[step:] == k[:-step])
        if not len(same):
            break
        a, b = v[same], v[same + step]
        ok = _linked(a, b)
        left.append(a[ok])
        right.append(b[ok])
    for head, size in zip(heads[sizes > small], sizes[sizes > small], strict=True):
        a, b = _spanning(values[head:head + size])
        left.append(a)
        right.append(b)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _links_of(longest: int):
    """Task over rows (key, fp) sorted by key: links (a, b), and members of over-long lists as (fp, null).

    The links found by a task are contracted to stars before they leave it, which keeps them few and the
    rounds of the components short."""
    pending: list = []

    def emit(a, b=None):
        signed = a.view(np.int64)
        other = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(signed), other], ["a", "b"])

    def run(batches):
        pending.clear()
        key = np.zeros(0, np.int64)
        val = np.zeros(0, np.uint64)
        long_key = None
        for batch in batches:
            k = np.concatenate([key, batch.column(0).to_numpy()])
            v = np.concatenate([val, batch.column(1).to_numpy().view(np.uint64)])
            if long_key is not None:              # the list that was too long goes on
                n = int(np.searchsorted(k, long_key, "right"))
                if n:
                    yield emit(v[:n])
                    k, v = k[n:], v[n:]
                if not len(k):
                    key, val = k, v
                    continue
                long_key = None
            tail = int(np.searchsorted(k, k[-1], "left")) if len(k) else 0
            if tail:
                yield from lists(k[:tail], v[:tail])
            key, val = k[tail:], v[tail:]
            if len(key) > longest:
                long_key = key[0]
                yield emit(val)
                key, val = key[:0], val[:0]
        if len(key):
            yield from lists(key, val)
        yield from drained()

    def lists(k, v):
        heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sizes = np.diff(np.concatenate([heads, [len(k)]]))
        over = np.repeat(sizes > longest, sizes)
        if over.any():
            yield emit(v[over])
        keep = np.repeat((sizes > 1) & (sizes <= longest), sizes)
        if keep.any():
            pending.append(_list_links(k[keep], v[keep]))
            if sum(len(a) for a, _ in pending) > PENDING:
                yield from drained()

    def drained():
        a, b = (np.concatenate(x) for x in zip(*pending, strict=True)) if pending else (np.zeros(0, np.uint64),) * 2
        pending.clear()
        if len(a):
            yield emit(*_contracted(a, b))

    return run


def _flip_links(members: DataFrame) -> DataFrame:
    """Exact links among the members of over-long lists: two values within four flips meet at a value within
    two flips of either. Everyone who reaches a value links to the least of them, so links stay in proportion."""
    masks = [0] + [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i, j in combinations(range(64), 2)]
    signed = np.array(masks, dtype=np.uint64).view(np.int64).tolist()
    flips = F.array(*[F.lit(m).cast("bigint") for m in signed])   # 2,081 of them
    reach = members.repartition("fp").select("fp", F.explode(flips).alias("mask"))
    reach = reach.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("meet"))
    least = reach.groupBy("meet").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return (reach.join(least, "meet").where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
            .distinct())


def links(fps: DataFrame, longest: int = LONG_LIST) -> DataFrame:
    """(a, b): links that connect exactly the distinct fingerprints (`fp`) at most BITS bits apart."""
    byte = [F.shiftrightunsigned(F.col("fp"), 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    keys = [F.lit(t << 24).cast("bigint") + F.shiftleft(byte[x], 16) + F.shiftleft(byte[y], 8) + byte[z]
            for t, (x, y, z) in enumerate(covering_triples())]
    index = fps.select(F.explode(F.array(*keys)).alias("key"), "fp")
    rows = index.repartition("key").sortWithinPartitions("key").select("key", "fp")
    found = common.saved(rows.mapInArrow(_links_of(longest), "a bigint, b bigint"), "simhash-links")
    pairs = found.where("b is not null").distinct()
    members = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    if members.limit(1).count():
        pairs = pairs.unionByName(_flip_links(members)).distinct()
    return pairs


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) of every node that has a link, root being the least node reachable.

    Alternating large-star and small-star rounds until the links are stars; every round's links are kept in
    shared storage. They halve the distances to the roots, so `rounds` is far beyond any graph: reaching it is an error."""
    state = reliable_checkpoint(edges.where("a <> b").select("a", "b").distinct())
    for _ in range(rounds):
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            state.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # done when the links are stars: no node but a root has two links, no root has a link to a lesser node
        ends = both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        if not ends.where("low < u and (high > u or low <> high)").limit(1).count():
            break
        least = ends.select(F.col("u").alias("w"), F.least("u", "low").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        state = reliable_checkpoint(small)
    else:
        raise RuntimeError(f"the links are not stars after {rounds} rounds")
    return state.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))


def fingerprint_components(marked: DataFrame, key: Column, longest: int = LONG_LIST) -> DataFrame:
    """(f, least, _n): for every distinct fingerprint of `marked`, the least `key` of its component and its rows."""
    fps = reliable_checkpoint(marked.groupBy("fp").agg(F.min(key).alias("key"), F.count(F.lit(1)).alias("n")))
    roots = reliable_checkpoint(components(links(fps.select("fp"), longest)))
    # only linked fingerprints, mostly few, are gathered by component; the joins by fingerprint have unique keys
    own = fps.select(F.col("fp").alias("f"), "key")
    least = (roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
             .join(own, F.col("node") == F.col("f")).groupBy(F.col("root").alias("r"))
             .agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("_n")))
    least, small = materialise_small(least)
    linked = lookup_join(roots, least, "root", "r", how="inner", null_safe=False, may_broadcast=small)
    linked = linked.select("node", "least").unionByName(least.select(F.col("r").alias("node"), "least"))
    return fps.join(linked, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("f"), F.coalesce("least", "key").alias("least"), F.col("n").alias("_n"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    longest: int = LONG_LIST) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least id reachable)."""
    marked = common.saved(fingerprints(docs, text_col, [id_col]), "simhash")
    table, small = materialise_small(fingerprint_components(marked, F.col(id_col), longest))
    # exact copies make a hot fingerprint: the join salts it by its count
    joined = lookup_join(marked, table, "fp", "f", how="inner", null_safe=False, may_broadcast=small)
    return joined.select(id_col, hex_text(F.col("fp")).alias("fingerprint"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONG_LIST) -> DataFrame:
    """The documents with one row of every component: the least id (null last), then the least text hash."""
    names = docs.columns
    spare = {c: f"c{i}" for i, c in enumerate(names)}
    own = docs.toDF(*spare.values())
    ident = F.struct(F.col(spare[id_col]).isNull().alias("last"), F.col(spare[id_col]).alias("id"),
                     F.xxhash64(spare[text_col]).alias("text"))
    own = own.withColumn("who", ident)
    marked = common.saved(fingerprints(own, spare[text_col], ["who"]), "simhash")
    chosen = fingerprint_components(marked, F.col("who"), longest).select("least").distinct()
    chosen = reliable_checkpoint(chosen.select(F.col("least.last").alias("l"), F.col("least.id").alias("i"),
                                               F.col("least.text").alias("t")))
    plain = own.withColumns({"l": F.col("who.last"), "i": F.col("who.id"), "t": F.col("who.text")}).drop("who")
    on = (plain["l"] == chosen["l"]) & plain["i"].eqNullSafe(chosen["i"]) & (plain["t"] == chosen["t"])
    kept = plain.join(chosen, on, "left_semi")
    again = marked.groupBy("who").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if again:   # rows that repeat an id and a text: one of them stays
        kept = kept.dropDuplicates(["l", "i", "t"])
    return kept.select(*spare.values()).toDF(*names)
