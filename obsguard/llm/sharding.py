"""Sharding by histogram sort, with DataFrame functions only.

Documents are sorted by (hash of the text, hash of the id) and cut into shards of near equal bytes. The cuts
(splitters) are found before any row moves: exact bytes and rows are counted by bucket of the key across all
partitions, every splitter picks the bucket edge nearest to its share, and those not within tolerance are
counted again in finer buckets of the one bucket that holds them. Then the rows are exchanged once, straight
into their places.

Equal texts are neighbours in this order and stay in one shard: a cut that falls inside their group moves to its
nearer edge, and the tolerance yields. Only a group of more than `WHOLE` of a fair shard is cut inside, by the
hash of the ids. Every shard is sorted
in `parts` smaller parts, so no task holds a shard: a part is a partition of its own, dealt by its number, and is sorted once;
slots follow from the exact row counts below the cuts and a row's place in its part.

Cases: a null text has no bytes (size 1, crc32 0); null ids sort by their hash
like any other; rows equal in id and text are neighbours; an empty table gives an empty result; more shards
than rows leave shards empty.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LAW = "bytes"
SHARDS = 8
TOLERANCE = 0.01         # of a shard's fair bytes, between the shards
WHOLE = 0.5              # of a shard's fair bytes: groups of equal texts up to this stay in one shard
LOOSE = 0.25             # of a part's fair bytes, inside a shard
KEY_BITS = 128           # 64 of the text's hash, 64 of the id's
MIN_KEY = -(1 << 63)
PLACE_BITS = 33          # monotonically_increasing_id: the low 33 bits number the rows of a partition


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text, plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def keys(id_col: Column, text: Column) -> dict[str, Column]:
    return {"h1": F.xxhash64(text), "h2": F.xxhash64(id_col, text)}


def _prefix(bits: int, length: int) -> Column:
    """Bits [bits, bits + length) of the 128-bit key, the most significant first, as a number."""
    col, at = ("h1", bits) if bits < 64 else ("h2", bits - 64)
    ordered = F.col(col).bitwiseXOR(F.lit(MIN_KEY))          # signed order to unsigned
    return F.shiftrightunsigned(ordered, 64 - at - length).bitwiseAND(F.lit((1 << length) - 1))


def _signed(value: int) -> int:
    """The signed hash whose order number is `value`."""
    return value - (1 << 63)


class Splitter:
    """A cut on its way: it lies inside the bucket `path` (bits of the key seen so far)."""

    def __init__(self, goal: float, tolerance: float, whole: float = 0.0):
        self.goal, self.tolerance, self.whole = goal, tolerance, whole      # groups up to `whole` bytes are not cut
        self.path, self.bits = 0, 0          # the bucket: first `bits` bits of the key
        self.below = (0, 0)                  # bytes and rows below the bucket
        self.best = None                     # (error, key, rows below)
        self.done = False

    def offer(self, key: int, bytes_below: int, rows_below: int) -> None:
        error = abs(bytes_below - self.goal)
        if self.best is None or error < self.best[0]:
            self.best = (error, key, rows_below)


def find_splitters(rows: DataFrame, shards: int, parts: int, tolerance: float = TOLERANCE,
                   loose: float = LOOSE, whole: float = WHOLE) -> list[tuple[int, int]]:
    """[(key, rows below)] of the shards * parts - 1 cuts, ascending; keys are 128-bit numbers.

    `rows` (h1, h2, size) is read once a round. A round brings to the driver one row per bucket of the cuts
    that are not settled, a number that depends on the cuts and not on the rows.
    """
    total = rows.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).first()
    all_bytes, all_rows = int(total["b"] or 0), int(total["n"])
    fair = all_bytes / (shards * parts)
    cuts = [Splitter(fair * j, tolerance * fair * parts, whole * fair * parts) if j % parts == 0 else Splitter(fair * j, loose * fair)
            for j in range(1, shards * parts)]
    for c in cuts:
        c.offer(0, 0, 0)
        c.offer(1 << KEY_BITS, all_bytes, all_rows)
        c.done = all_rows == 0
    length = min(16, max(12, math.ceil(math.log2(shards * parts)) + 5))
    while open_cuts := [c for c in cuts if not c.done]:
        bits = open_cuts[0].bits
        length = min(length, 64 - bits % 64)
        paths = sorted({c.path for c in open_cuts})
        part = rows
        if bits:     # only the buckets that hold a cut are counted again
            if bits < 64:
                part = part.withColumn("path", _prefix(0, bits))
                wanted = part["path"].isin(paths)
            else:
                lows = sorted({_signed(p >> (bits - 64)) for p in paths})
                low = F.col("h1").isin(lows)
                if bits == 64:
                    part, wanted = part.withColumn("path", F.struct("h1", F.lit(0).cast("bigint").alias("p"))), low
                else:
                    part = part.withColumn("path", F.struct("h1", _prefix(64, bits - 64).alias("p")))
                    wanted = low & F.col("path.p").isin(sorted({p & ((1 << (bits - 64)) - 1) for p in paths}))
            part = part.where(wanted)
        else:
            part = part.withColumn("path", F.lit(0).cast("bigint"))
        counted = part.groupBy("path", _prefix(bits, length).alias("bucket")).agg(
            F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        found: dict[int, list] = {}
        for r in counted:
            path = r["path"]
            if bits >= 64:
                path = ((path["h1"] + (1 << 63)) << (bits - 64)) | path["p"]
            found.setdefault(path, []).append((int(r["bucket"]), int(r["b"]), int(r["n"])))
        for listed in found.values():
            listed.sort()
        shift = KEY_BITS - bits - length
        for c in open_cuts:
            below, rows_below = c.below
            inside = None
            for bucket, b, n in found.get(c.path, []):
                path = (c.path << length) | bucket
                c.offer(path << shift, below, rows_below)
                if inside is None and below + b > c.goal:
                    inside = (path, (below, rows_below), b)
                    c.offer((path + 1) << shift, below + b, rows_below + n)
                    break
                below, rows_below = below + b, rows_below + n
            # 64 bits down, the bucket is one group of equal texts
            if inside is None or c.best[0] <= c.tolerance or shift == 0 or (shift == KEY_BITS - 64 and inside[2] <= c.whole):
                c.done = True
            else:
                c.path, c.below, _ = inside
                c.bits = bits + length
    found = [(c.best[1], c.best[2]) for c in cuts]
    # cuts inside a shard keep between the shard's own, which may have moved past them
    edges = [(0, 0), *sorted(found[parts - 1::parts]), (1 << KEY_BITS, all_rows)]
    out = []
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        out += sorted(min(max(cut, low), high) for cut in found[i * parts:(i + 1) * parts - 1]) + [high]
    return out[:-1]


def _placed(keyed: DataFrame, cuts: list[tuple[int, int]], parts: int) -> DataFrame:
    """`keyed` (h1, h2, ...) with its shard and slot: one exchange that makes every part a partition (a hash of the part's
    number would pile several into one), and a sort inside. A row's place is counted as it leaves the sort; a window would hold
    the whole part, texts included, a second time."""
    bounds = [k for k, _ in cuts]
    lowest = [0] + [rows for _, rows in cuts]    # rows below each part
    # parts by bucket of the key's first 12 bits: the part at the bucket's start, and the cuts inside it
    bucket_bits = 12
    start, inner = [], []
    for bucket in range(1 << bucket_bits):
        lo, hi = bucket << (KEY_BITS - bucket_bits), (bucket + 1) << (KEY_BITS - bucket_bits)
        at = bisect_right(bounds, lo)
        start.append(at)
        inner.append(bounds[at:bisect_left(bounds, hi)])
    spark = keyed.sparkSession
    rows = [(b, start[b], [(_signed(k >> 64), _signed(k & ((1 << 64) - 1))) for k in inner[b]])
            for b in range(1 << bucket_bits)]
    table = spark.createDataFrame(rows, "bucket bigint, start int, inner array<struct<a:bigint,b:bigint>>")
    tagged = keyed.withColumn("bucket", _prefix(0, bucket_bits)).join(F.broadcast(table), "bucket")   # 4,096 rows
    passed = F.size(F.filter("inner", lambda k: (F.col("h1") > k["a"]) | ((F.col("h1") == k["a"]) & (F.col("h2") >= k["b"]))))
    tagged = tagged.withColumn("_p", F.col("start") + passed).drop("bucket", "start", "inner")
    shard = F.floor(F.col("_p") / parts).cast("int")
    offset = [lowest[p] - lowest[p - p % parts] for p in range(len(lowest))]
    before = F.element_at(F.array(*[F.lit(o) for o in offset]).cast("array<bigint>"), F.col("_p") + 1)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return (tagged.repartitionById(len(lowest), F.col("_p")).sortWithinPartitions("h1", "h2").withColumn("_at", place)
            .withColumns({"shard": shard, "slot": before + F.col("_at")}).drop("_p", "_at"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                    keep: list[str] | None = None, parts: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """The kept columns (all by default) with size, text_crc32, law, shard, slot and grown_shard.

    A column of the input with one of these names is replaced."""
    spark = docs.sparkSession
    names = docs.columns if keep is None else keep
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [c for c in names if c not in new]
    spare = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*spare.values())
    text = F.col(spare[text_col])
    own = own.withColumns(keys(F.col(spare[id_col]), text))
    narrow = common.saved(own.select("h1", "h2", size_of(text).alias("size")), "sharding")
    if parts is None:
        parts = max(1, math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / shards))
    cuts = find_splitters(narrow, shards, parts, tolerance)
    keyed = own.select(*[spare[c] for c in kept], "h1", "h2", size_of(text).alias("size"),
                       F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    out = _placed(keyed, cuts, parts)
    return out.select(*[F.col(spare[c]).alias(c) for c in kept], "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
                      F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
