"""N-gram Jaccard self-join by rare-first prefix filtering.

A document's set holds its distinct 5-word shingles, as 64-bit hashes. Two sets link when 100 |A and B| >= 80 |A or B|.

1. *Sets.* One scan gives per document its set's size and 128-bit digest, and the front of the set in hash order.
   Documents with equal sets form a class; one row stands for it from here on.
2. *Heavy shingles.* Every scan task lists the shingles frequent in it; those frequent in the corpus are at
   most 2 ** 19 (their counts add up to no more than all shingles), so that table may be broadcast. They rank as
   the most frequent ones and are neither counted nor listed by shingle, so no list of a single shingle is large.
3. *Survivors.* Linked sets share their first m common shingles within the first n - ceil(0.8 n) + m of any common
   order. In hash order that needs no counts; a class that shares fewer than m of that front (m a tenth of the set)
   with classes of fitting size has no link and drops out. 48 bits of the hash do here: a chance match only keeps
   a class that goes later.
4. *Rare-first order.* The survivors' shingles are counted. A shingle of one class only matches nothing, but
   ranks first and uses up prefix places. The others get a key: 7 bits of falling rarity (quarter powers of two of
   the count), then 56 bits of the hash; keys ascend from rare to frequent.
5. *Prefix lists.* A class is listed under the non-unique shingles of its rare-first prefix, with its size and the
   positions. Partners must pass the length filter and the positional filter.
6. *Verification in rounds.* A list's pairs are not spelt out. In each round a list names some members as pivots
   (first the two with the fewest unique shingles, which are nearest to most; later those outside its largest component),
   pairs them with its members in other components, and lets the pivots go. A pair that several lists propose is
   verified once, by the suffix filter and then exactly. A list ends when those left are in one component, so no link
   between components is lost and a group of near copies costs a few pairs a member.

Hot lists are salted when pivots are joined to members and sets to pairs (`operators.joins.lookup_join`).

Cases: without words or text a set is empty, its size 0, and the row is linked with nothing; with fewer than five
words the whole sequence is one shingle; rows with equal ids are separate rows of one id; a null id never
names a component that has another id; very long texts are shingled whole; an empty table gives an empty result; other
columns are not read. Shingles are compared by hash: 64 bits for counting, 56 and the rarity for the overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.joins import lookup_join, materialise_small
from ..session import reliable_checkpoint
from . import common
from .features import mix
from .simhash import components

SHINGLE = 5
NEED, OF = 80, 100            # links from this share of the union on
HEAVY = 1 << 19               # heavy shingles, at most
FLUSH = 1 << 21               # shingles after which a scan task lists its frequent ones
LOCAL = 8                     # a shingle that a task lists stands in so many of its documents, at least
FIRST_PIVOTS, MORE_PIVOTS = 2, 64        # pivots of a list in the first round, in the second; then four times as many
BITS = 25                     # of the table that spares texts a shuffle
_HASH_BITS = 56
_FRONT_SHIFT = 16             # the front keeps the upper 48 bits of a hash
_WORDS_KEPT = 1 << 16
_SLICE = 256                   # texts of a batch that are Python strings at a time


def prefix_length(n):
    """Places of the order that hold a shingle shared with any partner."""
    return n - (NEED * n + OF - 1) // OF + 1


def shared_front(n):
    """m: the places of the front that a partner's front must share."""
    return np.maximum(1, n // 10)


def front_length(n):
    return prefix_length(n) - 1 + shared_front(n)


def texts_of(batch: pa.RecordBatch, column: int):
    for at in range(0, batch.num_rows, _SLICE):
        yield from batch.column(column).slice(at, _SLICE).to_pylist()


class Shingler:
    """Distinct shingle hashes of texts; the hashes of words are remembered within a bound."""

    def __init__(self):
        self.known: dict = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = b"" if text is None else text.encode("utf-8", "replace").lower()   # A-Z only, as bytes
        words = words.split()                                                      # at 20 and 09 to 0D
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > _WORDS_KEPT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(SHINGLE, len(h))
        n = len(h) - width + 1
        out = np.full(n, width, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
        return np.unique(out)


def scan_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(kind, id, th, n, digest, front, h, cnt): a row a document (kind 0), and the task's frequent shingles (kind 1)."""

    def run(batches):
        shingles, held, size = Shingler(), [], 0

        def frequent():
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            some = counts >= max(LOCAL, size / HEAVY / 2)
            m = int(some.sum())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                 pa.nulls(m, pa.binary()), pa.nulls(m, pa.list_(pa.int64())), pa.array(found[some].view(np.int64)),
                 pa.array(counts[some])], names)

        names = ["kind", "id", "th", "n", "digest", "front", "h", "cnt"]
        for batch in batches:
            rows: list = [[], [], []]
            for text in texts_of(batch, 2):
                s = shingles(text)
                rows[0].append(len(s))
                rows[1].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                rows[2].append((s[:front_length(len(s))] >> np.uint64(_FRONT_SHIFT)).view(np.int64) if len(s) else None)
                held.append(s)
                size += len(s)
                if size >= FLUSH:
                    yield frequent()
                    held, size = [], 0
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(m, np.int32)), batch.column(0), batch.column(1), pa.array(rows[0], pa.int64()),
                 pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.list_(pa.int64())), pa.nulls(m, pa.int64()),
                 pa.nulls(m, pa.int64())], names)
        if size:
            yield frequent()

    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("th"),
                      F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "kind int, id bigint, th bigint, n bigint, digest binary, front array<bigint>, h bigint, cnt bigint")


def heavy_shingles(scanned: DataFrame) -> np.ndarray:
    """The hashes (sorted) of shingles that hold at least total / 2 ** 19 places: at most 2 ** 19 of them.

    A task lists what holds at least half that share of its own shingles, and `LOCAL` places; what is missed by that
    merely ranks by its count like any other shingle."""
    total = scanned.agg(F.sum("n").alias("t")).first()["t"] or 0
    least = max(64, total / HEAVY)
    got = scanned.where("kind = 1").groupBy("h").agg(F.sum("cnt").alias("c")).where(F.col("c") >= F.lit(float(least))).select("h")
    return np.sort(np.array([r["h"] for r in got.toLocalIterator()], dtype=np.int64))


def fitting(small, large):
    """The length filter: sets of these sizes may link."""
    return large * NEED <= small * OF


def routed(rows: DataFrame) -> DataFrame:
    """Rows dealt by shingle; those of heavy shingles, which nobody counts, anywhere (by class)."""
    return rows.repartition(F.when(F.col("hot"), F.xxhash64("cls")).otherwise(F.col("h")))


def _runs(batches, columns: int):
    """Batches of rows sorted by their first column, regrouped so that no value spans two of them."""
    rest = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        tail = int(np.searchsorted(cols[0], cols[0][-1]))
        if tail:
            yield [c[:tail] for c in cols]
        rest = [c[tail:] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest


def _heads(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each run of equal values begins, how long it is)."""
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return heads, np.diff(np.concatenate([heads, [len(values)]]))


def survivors(fronts: DataFrame, heavy) -> DataFrame:
    """(cls): the classes that share enough of their hash-order front with classes of fitting size.

    `fronts` holds (cls, n, front), a row a class. A heavy shingle counts as shared."""
    hot_fronts = np.unique(heavy.value.view(np.uint64) >> np.uint64(_FRONT_SHIFT)).view(np.int64)

    def split(batches):
        for batch in batches:
            lists = batch.column(2)
            h = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(np.repeat(batch.column(1).to_numpy(), sizes)),
                 pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(np.isin(h, hot_fronts))], ["h", "n", "cls", "hot"])

    def shared(batches):
        """Rows sorted by (hot, h, n): a row counts if its neighbour has its shingle and a fitting size."""
        last, counted = None, False
        for batch in batches:
            h, n, cls, hot = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(h):
                continue
            if last is not None:
                h, n, cls, hot = (np.concatenate([[x], y]) for x, y in zip(last, (h, n, cls, hot), strict=True))
            near = (h[1:] == h[:-1]) & fitting(n[:-1], n[1:])
            keep = hot.astype(bool)
            keep[1:] |= near
            keep[:-1] |= near
            last, last_kept = (h[-1], n[-1], cls[-1], hot[-1]), bool(keep[-1])
            keep[0] &= not counted
            counted = last_kept
            found, first, times = np.unique(cls[keep], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[keep][first]), pa.array(times)], ["cls", "n", "c"])

    rows = fronts.select("cls", "n", "front").mapInArrow(split, "h bigint, n bigint, cls bigint, hot boolean")
    counts = routed(rows).sortWithinPartitions("hot", "h", "n").mapInArrow(shared, "cls bigint, n bigint, c bigint")
    # a partner may be as small as this; its front covers as many common shingles as its own m
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * NEED / F.lit(OF)) / 10))
    return counts.groupBy("cls").agg(F.sum("c").alias("c"), F.max("n").alias("n")).where(F.col("c") >= least).select("cls")


def likely(own: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `own` (i, t, text) whose text hash shares its place in a bit table with one of `keys` (th).

    The table has 2 ** `BITS` bits at any size, 4 MB: while the keys are few against it, the join that follows moves few
    texts; it never loses one."""
    place = F.pmod(F.col("th"), F.lit(1 << BITS))
    low = place.bitwiseAND(F.lit((1 << 15) - 1))
    parts = keys.groupBy(F.shiftright(place, 15).alias("b")).agg(F.bitmap_construct_agg(low).alias("m")).collect()
    bits = np.zeros(1 << BITS >> 3, np.uint8)
    for r in parts:                               # 1,024 rows of 4 KB, at most
        bits[r["b"] << 12:(r["b"] + 1) << 12] = np.frombuffer(r["m"], np.uint8)
    shared = own.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            at = batch.column(1).to_numpy() & ((1 << BITS) - 1)
            yield batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))

    return own.mapInArrow(run, own.schema)


def ordered_sets(texts: DataFrame, heavy) -> DataFrame:
    """(cls, n, u, tokens) of the classes whose rare-first prefix reaches shingles of several classes.

    `texts` holds (cls, text), a row a class or equal rows; u counts the shingles that no other class has, `tokens` are the
    keys of the others, rare first."""
    low = np.int64((1 << _HASH_BITS) - 1)

    def explode(batches):
        shingles = Shingler()
        for batch in batches:
            held, size = [], 0
            for cls, text in zip(batch.column(0).to_pylist(), texts_of(batch, 1), strict=True):
                s = shingles(text).view(np.int64)
                held.append((s, np.full(len(s), cls), np.full(len(s), len(s)), np.isin(s, heavy.value)))
                size += len(s)
                if size > 1 << 18:
                    yield flat(held)
                    held, size = [], 0
            if held:
                yield flat(held)

    def flat(held):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["h", "cls", "n", "hot"])

    def keyed(batches):
        """Rows sorted by (hot, h): those of heavy shingles, and of shingles that several rows have."""

        def plain():
            for batch in batches:
                hot = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
                if hot.any():
                    h, own, n = (batch.column(i).to_numpy()[hot] for i in range(3))
                    heavies.append(pa.RecordBatch.from_arrays(
                        [pa.array(own), pa.array(n), pa.array((np.int64(127) << _HASH_BITS) | (h & low))], ["cls", "n", "key"]))
                yield batch.filter(pa.array(~hot))

        heavies: list = []
        for h, own, n in _runs(plain(), 3):
            yield from heavies
            heavies.clear()
            _, df = _heads(h)
            rare = np.minimum(126, np.floor(4 * np.log2(df))).astype(np.int64)
            many = np.repeat(df > 1, df)
            key = (np.repeat(rare, df) << _HASH_BITS) | (h & low)
            yield pa.RecordBatch.from_arrays([pa.array(own[many]), pa.array(n[many]), pa.array(key[many])], ["cls", "n", "key"])
            # heavies of later batches follow
        yield from heavies

    def gathered(batches):
        """Rows sorted by (cls, key): one row a class, if its prefix reaches beyond its unique shingles."""
        for own, n, key in _runs(batches, 3):
            new = np.concatenate([[True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])])     # equal rows of a class
            own, n, key = own[new], n[new], key[new]
            heads, sizes = _heads(own)
            size, unique = n[heads], n[heads] - sizes
            keep = prefix_length(size) > unique
            offsets = np.concatenate([[0], np.cumsum(sizes[keep])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[heads][keep]), pa.array(size[keep]), pa.array(unique[keep]),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[np.repeat(keep, sizes)]))], ["cls", "n", "u", "tokens"])

    rows = texts.select("cls", "text").mapInArrow(explode, "h bigint, cls bigint, n bigint, hot boolean")
    tokens = routed(rows).sortWithinPartitions("hot", "h").mapInArrow(keyed, "cls bigint, n bigint, key bigint")
    return tokens.repartition("cls").sortWithinPartitions("cls", "key").mapInArrow(
        gathered, "cls bigint, n bigint, u bigint, tokens array<bigint>")


def prefix_lists(sets: DataFrame) -> DataFrame:
    """(key, cls, n, u, pos): every set under the non-unique shingles of its rare-first prefix; pos counts from 0."""
    n = F.col("n")
    places = n - F.ceil(n * NEED / F.lit(OF)) + 1 - F.col("u")
    front = F.posexplode(F.slice("tokens", F.lit(1), F.least(places, F.size("tokens")).cast("int")))
    return sets.select("cls", "n", "u", front.alias("at", "key")).select("key", "cls", "n", "u", (F.col("u") + F.col("at")).alias("pos"))


def _proposed(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """(a, b): pivots with the members of their lists in other components, by the length and positional filters.
    Two pivots of a list are paired once."""
    n, pos, comp = (F.col(c) for c in ("n", "pos", "comp"))

    def fits(p):
        need = F.ceil((n + p["n"]) * NEED / F.lit(OF + NEED))
        left = F.least(n - pos, p["n"] - p["pos"])                                  # shared from here on, at most
        once = F.col("turn").isNull() | (p["turn"] < F.col("turn"))
        return once & (p["comp"] != comp) & fitting(F.least(n, p["n"]), F.greatest(n, p["n"])) & (left >= need)

    wide = lookup_join(members, pivots, "key", "pkey", how="inner", null_safe=False)
    fit = wide.select("cls", "u", F.explode(F.filter("pivots", fits)).alias("p"))
    # one way round in all lists; first the one with fewer unique shingles, mostly the pivot
    pair = F.array_sort(F.array(F.struct(F.col("p.u").alias("u"), F.col("p.cls").alias("cls")), F.struct("u", "cls")))
    return fit.select(pair[0]["cls"].alias("a"), pair[1]["cls"].alias("b")).distinct()


def apart(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """The suffix filter's bound: sorted sets differ in at least so many elements, by halving both at y's middle."""
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    half = len(y) // 2
    at = int(np.searchsorted(x, y[half]))
    has = int(at < len(x) and x[at] == y[half])
    return apart(x[:at], y[:half], depth - 1) + apart(x[at + has:], y[half + 1:], depth - 1) + 1 - has


def linked(x: np.ndarray, y: np.ndarray, n_x: int, n_y: int) -> bool:
    """Whether sets of these sizes, whose shared elements all lie in x and y, overlap enough."""
    need = -(-NEED * (n_x + n_y) // (OF + NEED))
    if apart(x, y) > len(x) + len(y) - 2 * need:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. `pairs` is a stored table of distinct pairs."""

    def check(batches):
        for batch in batches:
            a, b, n_a, n_b = (batch.column(i).to_numpy() for i in range(4))
            x, y = batch.column(4), batch.column(5)
            vx, vy = (c.flatten().to_numpy() for c in (x, y))
            ox, oy = (c.offsets.to_numpy() - c.offsets[0].as_py() for c in (x, y))
            ok = np.array([linked(vx[ox[i]:ox[i + 1]], vy[oy[i]:oy[i + 1]], int(n_a[i]), int(n_b[i])) for i in range(len(a))], dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    counts = pairs.groupBy(F.col("a").alias("k")).agg(F.count(F.lit(1)).alias("_n"))
    first = sets.join(counts, sets["cls"] == counts["k"]).select(F.col("cls").alias("k"), F.col("n").alias("n_a"), F.col("tokens").alias("x"), "_n")
    second = sets.select(F.col("cls").alias("c"), F.col("n").alias("n_b"), F.col("tokens").alias("y"))
    both = pairs.join(second, pairs["b"] == second["c"]).drop("c")
    wide = lookup_join(both, first, "a", "k", how="inner", null_safe=False)
    return wide.select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(check, "a bigint, b bigint")


def linked_classes(sets: DataFrame) -> DataFrame:
    """(node, root) of every class that has a link, root being the least class reachable. `sets` is a stored table."""
    members = common.saved(prefix_lists(sets).withColumn("comp", F.col("cls")), "jaccard-lists")
    links, roots, most = None, None, FIRST_PIVOTS
    while True:
        by_comp = members.groupBy(F.col("key").alias("k"), "comp").agg(F.count(F.lit(1)).alias("c"))
        lists = by_comp.groupBy("k").agg(F.sum("c").alias("_n"), F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("c", "comp")).alias("big"))
        lists = reliable_checkpoint(lists.where("comps > 1").select("k", "_n", "big"))
        if not lists.limit(1).count():
            break
        # what is left of the open lists, and which of their members take a turn as pivots
        sized = lists.withColumn("size", F.col("_n"))
        members = lookup_join(members, sized, "key", "k", how="inner", null_safe=False)
        first = [] if roots is None else [(F.col("comp") == F.col("big")).cast("int")]
        members = common.saved(members.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(*first, "u", "cls"))), "jaccard-lists")
        members = members.withColumn("turn", F.when(F.col("r") <= most, F.col("r"))).drop("r", "big")
        pivots = members.where("turn is not null").groupBy(F.col("key").alias("pkey")).agg(
            F.collect_list(F.struct("cls", "n", "u", "pos", "comp", "turn")).alias("pivots"), F.max("size").alias("_n"))
        pairs = common.saved(_proposed(members, pivots), "jaccard-pairs")
        fresh = common.saved(verified(pairs, sets), "jaccard-links")
        members = members.where("turn is null").drop("size", "turn")
        if fresh.limit(1).count():
            links = fresh if links is None else links.unionByName(fresh)
            roots = reliable_checkpoint(components(links))
            at = roots.select(F.col("node").alias("at"), "root")
            members = members.join(at, members["cls"] == at["at"], "left").withColumn("comp", F.coalesce("root", "cls")).drop("at", "root")
        most = max(MORE_PIVOTS, most * 4)
    if roots is None:
        return sets.select(F.col("cls").alias("node"), F.col("cls").alias("root")).where(F.lit(False))
    return roots


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, n_shingles, component_id (least id reachable by links, its own included)."""
    spark = docs.sparkSession
    scanned = scan_sets(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id())
    scanned = common.saved(scanned, "jaccard-scan")
    rows = scanned.where("kind = 0")
    heavy = spark.sparkContext.broadcast(heavy_shingles(scanned))
    classes = common.saved(rows.where("digest is not null").groupBy("digest").agg(
        F.min("rid").alias("cls"), F.min("id").alias("least"), F.count(F.lit(1)).alias("_n")), "jaccard-classes")
    copies = classes.where(F.col("_n") > 1).select(F.col("digest").alias("d"), "cls", "_n")
    extra = lookup_join(rows.select("rid", "digest").where("digest is not null"), copies, "digest", "d", how="inner", null_safe=False)
    extra = common.saved(extra.where("rid <> cls").select("rid"), "jaccard-copies")
    fronts = rows.where("digest is not null").join(extra, "rid", "left_anti").select(F.col("rid").alias("cls"), "n", "front")
    common.release(spark)
    alive = common.saved(survivors(fronts, heavy), "jaccard-survivors")
    common.release(spark)
    keys = common.saved(rows.select(F.col("rid").alias("cls"), "id", "th").join(alive, "cls"), "jaccard-keys")
    own = docs.select(F.col(id_col).cast("bigint").alias("i"), F.xxhash64(text_col).alias("t"), F.col(text_col).cast("string").alias("text"))
    own = likely(own, keys)
    texts = own.join(keys, own["i"].eqNullSafe(keys["id"]) & (own["t"] == keys["th"])).select("cls", "text")
    sets = common.saved(ordered_sets(texts, heavy), "jaccard-sets")
    common.release(spark)
    roots = linked_classes(sets)
    linked_ones = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    ids = linked_ones.join(classes.select(F.col("cls").alias("node"), "least"), "node")
    least = ids.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("_n"))
    least, small = materialise_small(least)
    named = lookup_join(linked_ones, least, "root", "r", how="inner", null_safe=False, may_broadcast=small).select("node", "component")
    table = classes.join(named, classes["cls"] == named["node"], "left").select(
        F.col("digest").alias("d"), F.coalesce("component", "least").alias("component_id"), "_n")
    table, small = materialise_small(table)
    some = lookup_join(rows.where("digest is not null").select("id", "n", "digest"), table, "digest", "d", how="inner", null_safe=False,
                       may_broadcast=small).select("id", "n", "component_id")
    none = rows.where("digest is null").select("id", "n", F.col("id").alias("component_id"))
    return some.unionByName(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
