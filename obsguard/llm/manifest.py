"""Merkle manifest of the documents, with leaf coordinates from bitmap ranks.

Every row is a leaf: the sha256 of its fields. A language's leaves ascend by doc_id; every two consecutive nodes
become one until one is left, the language's subroot; the subroots, ordered by language, likewise give the root.

1. *Bitmaps.* Each scan task packs its doc_ids by (language, doc_id >> 12) as sorted 12-bit positions; partial packs
   of a key are merged into a container, a bitmap with a popcount directory or, where that is smaller, the
   positions themselves. Rows that repeat a doc_id are counted beside it.
2. *Directory.* A container's first rank is the number of rows in all containers below it: the counts are summed
   within parents of at most 4,096 children (65,536 at the top), level by level over the id's 12-bit digits. No list of
   containers is ever whole in one task.
3. *Ranks.* Leaves meet their container; a leaf's coordinate is the container's first rank plus the directory's
   and the popcount below its bit. Leaves are not sorted by id. Rows with one doc_id (or none) in a language go by their leaf,
   numbered by a global sort of just those rows.
4. *Slots.* Leaves are keyed by (language, rank >> 10) and put into slot arrays, each reduced by ten levels to one
   node; the nodes are keyed again, and so on. The siblings passed on the way are kept by slot; going down, every block
   gets the siblings above it, and each leaf its proof.

A tampered table is checked against the honest one: where 7 divides the crc32 of the decimal doc_id, n_chars is one
higher; every leaf is folded with the siblings of its honest one.

Cases: a null field is `-`; null languages are a language, the first; null doc_ids come first in theirs and
are not tampered with; rows equal in language, doc_id and leaf stand in any order, which gives the same nodes; a null n_chars stays
null; long texts are hashed whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.joins import lookup_join, materialise_small
from ..operators.rank import with_global_rank
from ..session import reliable_checkpoint
from . import common

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 7
DIGIT = 12                       # bits of a doc_id that a container covers
MASK = (1 << DIGIT) - 1
LEVELS = 10                      # levels that a slot array reduces
PACK = 1 << 20                   # ids that a scan task packs at a time
_SPARSE = (1 << DIGIT) // 16     # ids from which a container is a bitmap
_DIGEST = 32


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed) -> Column:
    """The leaf of a row, as 32 bytes; `changed` replaces fields."""
    parts = [encoded(changed.get(c, F.col(c))) for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, leaf, changed): `changed` is the leaf of the tampered row, null where nothing is tampered with."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c) for c in FIELDS[1:]])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    return own.select(F.col("lang").cast("string").alias("lang"), "doc_id", leaf_hash().alias("leaf"),
                      F.when(hit, leaf_hash(n_chars=more)).alias("changed"))


# -- ranks -------------------------------------------------------------------------------------------

class Container:
    """Positions (`DIGIT` bits) of the ids of a key, with how often the repeated ones occur."""

    def __init__(self, places: np.ndarray, extra_at: np.ndarray, extra: np.ndarray):
        self.places, self.extra_at, self.extra = places, extra_at, extra

    @classmethod
    def merged(cls, packs: list) -> Container:
        places = np.concatenate([p for p, _, _ in packs])
        found, times = np.unique(places, return_counts=True)
        rows = np.zeros(1 << DIGIT, np.int64)
        rows[found] = times
        for _, at, more in packs:
            np.add.at(rows, at, more)
        again = found[rows[found] > 1]
        return cls(found, again, rows[again] - 1)

    def rows(self) -> int:
        return len(self.places) + int(self.extra.sum())

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        """(directory, bits or positions, repeated positions, their further rows)."""
        extra = self.extra_at.astype("<u2").tobytes(), self.extra.astype("<i8").tobytes()
        if len(self.places) < _SPARSE:
            return b"", self.places.astype("<u2").tobytes(), *extra
        bits = np.zeros(1 << DIGIT, np.uint8)
        bits[self.places] = 1
        below = np.concatenate([[0], np.cumsum(bits.reshape(-1, 512).sum(axis=1, dtype=np.int64))[:-1]])
        return below.astype("<i4").tobytes(), np.packbits(bits, bitorder="little").tobytes(), *extra


def ranks_in(places: np.ndarray, directory: bytes, body: bytes, extra_at: bytes, extra: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(rows below each position in the container, whether its id is repeated)."""
    if directory:
        below, words = np.frombuffer(directory, "<i4").astype(np.int64), np.frombuffer(body, "<u8")
        block, word = places >> 9, places >> 6
        rank = below[block]
        for k in range(8):                       # whole words between the directory's block and the position's word
            at = (block << 3) + k
            rank = rank + np.where(at < word, np.bitwise_count(words[at]), 0)
        mask = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        rank = rank + np.bitwise_count(words[word] & mask)
    else:
        rank = np.searchsorted(np.frombuffer(body, "<u2"), places).astype(np.int64)
    at, more = np.frombuffer(extra_at, "<u2").astype(np.int64), np.frombuffer(extra, "<i8")
    if len(at):
        before = np.searchsorted(at, places)
        rank = rank + np.concatenate([[0], np.cumsum(more)])[before]
        return rank, (before < len(at)) & (at[np.minimum(before, len(at) - 1)] == places)
    return rank, np.zeros(len(places), bool)


_CONTAINER = "lang string, chunk bigint, n bigint, directory binary, body binary, extra_at binary, extra binary"


def containers(leaves: DataFrame) -> DataFrame:
    """One row per (lang, chunk): the merged bitmap of its doc_ids, and its number of rows."""

    def pack(batches):
        held, size = [], 0

        def flush():
            packs: dict = {}
            langs, ids = [x for l, _ in held for x in l], np.concatenate([i for _, i in held])
            codes = {v: k for k, v in enumerate(dict.fromkeys(langs))}
            code = np.array([codes[v] for v in langs], dtype=np.int64)
            chunk = ids >> DIGIT
            order = np.lexsort((chunk, code))
            cut = np.flatnonzero((np.diff(code[order]) != 0) | (np.diff(chunk[order]) != 0)) + 1
            names = list(codes)
            for part in np.split(order, cut):
                packs[(names[code[part[0]]], int(chunk[part[0]]))] = Container.merged(
                    [((ids[part] & MASK).astype(np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))])
            return rows(packs)

        for batch in batches:
            held.append((batch.column(0).to_pylist(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= PACK:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def rows(packs: dict):
        got = [(lang, chunk, c.rows(), *c.packed()) for (lang, chunk), c in packs.items()]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*got, strict=True), [pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 4], strict=True)],
            ["lang", "chunk", "n", "directory", "body", "extra_at", "extra"])

    def unpack(directory, body, extra_at, extra):
        places = (np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little")) if directory
                  else np.frombuffer(body, "<u2").astype(np.int64))
        return places, np.frombuffer(extra_at, "<u2").astype(np.int64), np.frombuffer(extra, "<i8")

    def merge(batches):
        key, parts = None, []
        for batch in batches:
            out = {}
            for lang, chunk, _, *body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, chunk) != key:
                    if parts:
                        out[key] = Container.merged(parts)
                    key, parts = (lang, chunk), []
                parts.append(unpack(*body))
                if len(parts) > 64:
                    got = Container.merged(parts)
                    parts = [(got.places, got.extra_at, got.extra)]
            if out:
                yield rows(out)
        if parts:
            yield rows({key: Container.merged(parts)})

    ids = leaves.where("doc_id is not null").select("lang", "doc_id")
    partial = ids.mapInArrow(pack, _CONTAINER)
    return partial.repartition("lang", "chunk").sortWithinPartitions("lang", "chunk").mapInArrow(merge, _CONTAINER)


def directory_of(counts: DataFrame, nulls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((lang, chunk, first) with the rank of a container's first row, (lang, n) with all rows of a language).

    `counts` (lang, chunk, n) is stored; `nulls` (lang, n0) counts rows without a doc_id, which come first."""
    out, level, up = counts.select("lang", "chunk", F.lit(0).cast("bigint").alias("first")), counts.select("lang", "chunk", "n"), 0
    for turn in range(64 // DIGIT - 1):
        # the highest digit, signed, has no parent
        parent = F.shiftright(F.col("chunk"), DIGIT) if turn < 64 // DIGIT - 2 else F.lit(0).cast("bigint")
        below = Window.partitionBy("lang", parent).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        sums = reliable_checkpoint(level.select(F.col("lang").alias("l"), F.col("chunk").alias("c"),
                                                F.coalesce(F.sum("n").over(below), F.lit(0)).alias("s")))
        own = F.shiftright(F.col("chunk"), up)
        out = out.join(sums, F.col("lang").eqNullSafe(F.col("l")) & (own == F.col("c"))).select(
            "lang", "chunk", (F.col("first") + F.col("s")).alias("first"))
        level = reliable_checkpoint(level.groupBy("lang", parent.alias("chunk")).agg(F.sum("n").alias("n")))
        up += DIGIT
    totals = (level.groupBy("lang").agg(F.sum("n").alias("n")).unionByName(nulls.select("lang", F.col("n0").alias("n")))
              .groupBy("lang").agg(F.sum("n").alias("n")))
    zero = nulls.select(F.col("lang").alias("l"), "n0")
    out = out.join(zero, F.col("lang").eqNullSafe(F.col("l")), "left").select(
        "lang", "chunk", (F.col("first") + F.coalesce("n0", F.lit(0))).alias("first"))
    return out, totals


def ranked_leaves(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((lang, rank, doc_id, leaf, changed), (lang, n)); `leaves` is a stored table."""
    packed = common.saved(containers(leaves), "manifest-bitmaps")
    nulls = reliable_checkpoint(leaves.where("doc_id is null").groupBy("lang").agg(F.count(F.lit(1)).alias("n0")))
    first, totals = directory_of(packed, nulls)
    first = first.select(F.col("lang").alias("l"), F.col("chunk").alias("c"), "first")
    whole = packed.join(first, F.col("lang").eqNullSafe(F.col("l")) & (F.col("chunk") == F.col("c"))).drop("l", "c", "n")
    names = ["first", "directory", "body", "extra_at", "extra"]
    blank = [F.lit(None).cast(t).alias(c) for c, t in zip(names, ["bigint", *["binary"] * 4], strict=True)]
    blank_leaf = [F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("leaf"), F.lit(None).cast("binary").alias("changed")]
    both = whole.select("lang", "chunk", F.lit(0).alias("kind"), *names, *blank_leaf).unionByName(
        leaves.where("doc_id is not null").select("lang", F.shiftright("doc_id", DIGIT).alias("chunk"), F.lit(1).alias("kind"),
                                                  *blank, "doc_id", "leaf", "changed"))

    def look_up(batches):
        """Rows sorted by (lang, chunk, kind): a container, then its leaves."""
        now = None
        for batch in batches:
            kind = batch.column(2).to_numpy()
            heads = np.flatnonzero(kind == 0)
            for a, b in zip(np.concatenate([[-1], heads]), np.concatenate([heads, [len(kind)]]), strict=True):
                if a >= 0:
                    now = [batch.column(i)[int(a)].as_py() for i in range(3, 8)]
                if b > a + 1:
                    part = batch.slice(int(a) + 1, int(b - a) - 1)
                    below, again = ranks_in(part.column(8).to_numpy() & MASK, *now[1:])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(now[0] + below, pa.int64()), pa.array(again), *[part.column(i) for i in (8, 9, 10)]],
                        ["lang", "rank", "again", "doc_id", "leaf", "changed"])

    dealt = both.repartition("lang", "chunk").sortWithinPartitions("lang", "chunk", "kind")
    ranked = common.saved(dealt.mapInArrow(look_up, "lang string, rank bigint, again boolean, doc_id bigint, leaf binary, changed binary"),
                          "manifest-ranks")
    # rows that share a doc_id, or have none: numbered among themselves by their leaf
    shared = ranked.where("again").select("lang", "rank", "doc_id", "leaf", "changed").unionByName(
        leaves.where("doc_id is null").select("lang", F.lit(0).cast("bigint").alias("rank"), "doc_id", "leaf", "changed"))
    sole = ranked.where("not again").drop("again")
    if shared.limit(1).count():
        spread = F.xxhash64("leaf", F.spark_partition_id(), F.monotonically_increasing_id())
        numbered = common.saved(with_global_rank(shared.withColumn("spread", spread), F.col("lang").asc_nulls_first(),
                                                 F.col("doc_id").asc_nulls_first(), "leaf", "spread", name="at").drop("spread"), "manifest-shared")
        start = numbered.groupBy(F.col("lang").alias("l"), F.col("rank").alias("r")).agg(F.min("at").alias("start"))
        start = start.select(F.struct("l", "r").alias("k"), "start")
        keyed = numbered.withColumn("key", F.struct(F.col("lang").alias("l"), F.col("rank").alias("r")))
        placed = lookup_join(keyed, start, "key", "k", how="inner")
        sole = sole.unionByName(placed.select("lang", (F.col("rank") + F.col("at") - F.col("start")).alias("rank"), "doc_id", "leaf", "changed"))
    return sole, totals


# -- levels ------------------------------------------------------------------------------------------

def node(run: list[bytes]) -> bytes:
    """H of a run of nodes: the digests as hex text, concatenated."""
    return hashlib.sha256("".join(x.hex() for x in run).encode()).digest()


def reduced(slots: list[bytes], levels: int) -> list[list[bytes]]:
    """The slot array and what it becomes, level by level."""
    out = [slots]
    for _ in range(levels):
        slots = [node(slots[i:i + 2]) for i in range(0, len(slots), 2)]
        out.append(slots)
    return out


def levels_in(nodes: int, levels: int) -> int:
    """Levels that a slot array goes up where a tree has so many nodes: all that are left, or `levels`."""
    return min(levels, max(0, int(nodes - 1).bit_length()))


def siblings_of(levels: list[list[bytes]], slot: int) -> list[bytes]:
    """The siblings on the way from a slot up the array."""
    out = []
    for row in levels[:-1]:
        if (slot ^ 1) < len(row):
            out.append(row[slot ^ 1])
        slot >>= 1
    return out


_BLOCK = "tree string, block bigint, nodes bigint, slots binary, docs array<bigint>, changed array<binary>, top binary"


def slot_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, block, nodes, slots, docs, changed, top): nodes (tree, at, nodes, hash, doc_id, changed) put into slot arrays.

    `nodes` is the number of nodes that the tree has at this level; `top` what the array is reduced to."""

    def build(table: pa.Table) -> pa.Table:
        slot = table.column("at").to_numpy() & ((1 << levels) - 1)
        if not np.array_equal(np.sort(slot), np.arange(len(slot))):
            raise ValueError("the ranks of a block are not its slots")
        place = np.empty(len(slot), np.int64)
        place[slot] = np.arange(len(slot))
        table = table.take(pa.array(place))
        hashes = table.column("hash").to_pylist()
        total = table.column("nodes")[0].as_py()
        top = reduced(hashes, levels_in(total, levels))[-1]
        return pa.table({"tree": pa.array([table.column("tree")[0].as_py()], pa.string()),
                         "block": pa.array([table.column("block")[0].as_py()], pa.int64()), "nodes": pa.array([total], pa.int64()),
                         "slots": pa.array([b"".join(hashes)], pa.binary()),
                         "docs": pa.array([table.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                         "changed": pa.array([table.column("changed").to_pylist()], pa.list_(pa.binary())), "top": pa.array(top, pa.binary())})

    keyed = nodes.withColumn("block", F.shiftright("at", levels))
    return keyed.groupBy("tree", "block").applyInArrow(build, _BLOCK)


def _above(blocks: DataFrame, levels: int) -> DataFrame:
    """The blocks' tops as the nodes of the next level of slot arrays."""
    return blocks.select("tree", F.col("block").alias("at"), F.ceil(F.col("nodes") / F.lit(1 << levels)).alias("nodes"), F.col("top").alias("hash"),
                         F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("changed"))


def forest(nodes: DataFrame, name: str, levels: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((tree, root), the lowest blocks, (tree, block, above) with the siblings above each of them, lowest first)."""
    stack, level = [], nodes
    while True:
        stack.append(common.saved(slot_blocks(level, levels), name))
        if not stack[-1].where(F.col("nodes") > (1 << levels)).limit(1).count():
            break
        level = _above(stack[-1], levels)
        # trees that are done go up as the one node they are; it has no sibling and stays what it is
    roots = stack[-1].select("tree", F.col("top").alias("root"))

    def passed_down(batches):
        size = 1 << levels
        for batch in batches:
            trees, blocks, above = [], [], []
            for tree, block, total, slots, upper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = [slots[i:i + _DIGEST] for i in range(0, len(slots), _DIGEST)]
                rows = reduced(row, levels_in(total, levels))
                for slot in range(len(row)):
                    trees.append(tree)
                    blocks.append(block * size + slot)
                    above.append(b"".join(siblings_of(rows, slot)) + upper)
            yield pa.RecordBatch.from_arrays([pa.array(trees, pa.string()), pa.array(blocks, pa.int64()), pa.array(above, pa.binary())],
                                             ["tree", "block", "above"])

    down = stack[-1].select("tree", "block", F.lit(b"").alias("above"))
    for blocks in reversed(stack[1:]):
        up = down.select(F.col("tree").alias("t"), F.col("block").alias("b"), "above")
        joined = blocks.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b")))
        down = joined.select("tree", "block", "nodes", "slots", "above").mapInArrow(passed_down, "tree string, block bigint, above binary")
        down = common.saved(down, name)
    return roots, stack[0], down


def fold(value: bytes, at: int, nodes: int, siblings: list[bytes]) -> tuple[bytes, int]:
    """(what a node at this place becomes at the top of a tree, siblings used)."""
    used = 0
    while nodes > 1:
        if (at ^ 1) < nodes:
            pair = [value, siblings[used]] if at % 2 == 0 else [siblings[used], value]
            used += 1
        else:
            pair = [value]
        value, at, nodes = node(pair), at >> 1, (nodes + 1) >> 1
    return value, used


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    leaves = common.saved(leaves_of(docs), "manifest-leaves")
    ranked, totals = ranked_leaves(leaves)
    totals, small = materialise_small(totals.select(F.col("lang").alias("l"), "n", F.col("n").alias("_n")))
    nodes = lookup_join(ranked, totals, "lang", "l", how="inner", may_broadcast=small)
    # a null language keeps its own tree: names are told from null by a mark in front
    tree = F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("lang"))).alias("tree")
    nodes = nodes.select(tree, F.col("rank").alias("at"), F.col("n").alias("nodes"), F.col("leaf").alias("hash"), "doc_id", "changed")
    subroots, blocks, above = forest(nodes, "manifest-blocks", levels)
    # the languages' tree: null ("-") sorts before the others ("=..."), those bytewise
    langs = reliable_checkpoint(with_global_rank(subroots, "tree", name="at"))
    n_langs = langs.count()
    tops, top_blocks, top_above = forest(langs.select(F.lit("all").alias("tree"), "at", F.lit(n_langs).cast("bigint").alias("nodes"),
                                                      F.col("root").alias("hash"), F.lit(None).cast("bigint").alias("doc_id"),
                                                      F.lit(None).cast("binary").alias("changed")), "manifest-languages", levels)
    top = tops.first()
    root_hash = bytes(top["root"]) if top else b""
    # per language: its place, and the siblings of its subroot
    size = 1 << levels
    spread = top_blocks.join(top_above.select(F.col("block").alias("b"), "above"), F.col("block") == F.col("b"))

    def proofs(batches):
        for batch in batches:
            at, out = [], []
            for block, total, slots, upper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = reduced([slots[i:i + _DIGEST] for i in range(0, len(slots), _DIGEST)], levels_in(total, levels))
                at += [block * size + s for s in range(len(rows[0]))]
                out += [b"".join(siblings_of(rows, s)) + upper for s in range(len(rows[0]))]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out, pa.binary())], ["place", "beside"])

    beside = spread.select("block", "nodes", "slots", "above").mapInArrow(proofs, "place bigint, beside binary")
    facts = langs.join(beside, F.col("at") == F.col("place")).select(
        F.col("tree").alias("k"), F.col("root").alias("subroot"), F.col("at").alias("lang_at"), "beside")
    facts, small = materialise_small(facts)
    full = blocks.join(above.select(F.col("tree").alias("t"), F.col("block").alias("b"), "above"), (F.col("tree") == F.col("t")) & (F.col("block") == F.col("b")))
    full = lookup_join(full.drop("t", "b", "top"), facts, "tree", "k", how="inner", null_safe=False, may_broadcast=small)

    def finish(batches):
        names, root = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"], root_hash.hex()
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in
                    ("block", "nodes", "slots", "docs", "changed", "above", "subroot", "lang_at", "beside")]
            for block, total, slots, docs_, changed, upper, subroot, lang_at, beside_ in zip(*cols, strict=True):
                row = [slots[i:i + _DIGEST] for i in range(0, len(slots), _DIGEST)]
                rows = reduced(row, levels_in(total, levels))
                upper = [upper[i:i + _DIGEST] for i in range(0, len(upper), _DIGEST)]
                tail = [beside_[i:i + _DIGEST] for i in range(0, len(beside_), _DIGEST)]
                proof_hash, folded = [], []
                for slot, (leaf, other) in enumerate(zip(row, changed, strict=True)):
                    path = siblings_of(rows, slot) + upper
                    proof_hash.append(node(path + tail).hex())
                    value, used = fold(leaf if other is None else other, block * size + slot, total, path)
                    folded.append(fold(value, lang_at, n_langs, tail)[0].hex())
                m = len(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs_, pa.int64()), pa.array([x.hex() for x in row]), pa.array([subroot.hex()] * m), pa.array([root] * m),
                     pa.array(proof_hash), pa.array(folded), pa.array([f == root for f in folded])], names)

    return full.mapInArrow(finish, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
