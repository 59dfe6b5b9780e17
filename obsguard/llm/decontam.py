"""Benchmark decontamination with a distributed positional inverted index.

The documents are dealt as they lie into shards of about `SHARD_BYTES` of text. Each shard holds, for every
term (hash of a lower-cased word), the sorted list of its positions; shards are stored as Parquet rows on
shared storage, in row groups of bounded bytes (`save_index`), and can be searched any number of times. A
search visits every shard with the stated benchmark windows: for each window it starts from the positions of
the window's rarest term in that shard and intersects them, offset by offset, with the lists of the next
rarer terms. Word order decides an exact phrase match; with `slop`, every term may stand up to so many words
away from its place (proximity).
Nothing is shuffled. A benchmark above `BLOCK_BYTES` is searched block after block, each block broadcast.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is `window` consecutive
words of an item; a shorter item that has words is one window.

Cases: a null or empty text has no words and no hits; an item without words matches nothing; rows with equal
ids are separate documents; items with equal ids count as one item; an item with a null id marks words but
has no id to list. Very long texts are one shard each. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .features import span_hashes

WINDOW = 10
SHARD_BYTES = 3 << 20
SHARD_DOCS = 1 << 15
BLOCK_BYTES = 8 << 20        # benchmark text that is broadcast at a time
GAP = 4096                   # positions left free between documents: no window, with its slop, reaches over
CANDIDATES = 1 << 20         # places compared at a time
GROUP_BYTES = 8 << 20        # of shards that a Parquet writer holds, or a reader takes in, at a time
_STEP = 1 << 20              # bytes hashed at a time

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[0x00:0x30] = _IS_WORD[0x3A:0x61] = _IS_WORD[0x7B:0x80] = False

_MATCHES = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
_INDEX_FIELDS = "n_words array<bigint>, terms binary, counts binary, steps binary"


def word_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, number of words of every text)."""
    raw = [b"" if t is None else t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    data = _FOLD[np.frombuffer(b"\0".join(raw) + b"\0", dtype=np.uint8)]
    hashes, firsts, at = [], [], 0
    while at < len(data):
        stop = min(at + _STEP, len(data))
        while stop < len(data):
            back = np.flatnonzero(~_IS_WORD[data[at:stop]])   # cut after a byte that is in no word
            if len(back):
                stop = at + int(back[-1]) + 1
                break
            stop = min(stop + _STEP, len(data))
        part = data[at:stop]
        edge = np.diff(np.concatenate([[False], _IS_WORD[part], [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        hashes.append(span_hashes(part, starts, ends))
        firsts.append(starts + at)
        at = stop
    first = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(first, np.concatenate([[0], np.cumsum(sizes)])))
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def _varints(values: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes of seven bits as each needs, lowest first; a byte from 128 on goes on."""
    size = np.ones(len(values), dtype=np.int64)
    for k in range(1, 9):
        size += values >= 1 << 7 * k
    starts = np.cumsum(size) - size
    out = np.empty(int(size.sum()), dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[starts[has] + k] = values[has] >> 7 * k & 127 | (size[has] > k + 1) * 128
    return out.tobytes()


def _numbers(packed: bytes) -> np.ndarray:
    """What `_varints` has packed."""
    raw = np.frombuffer(packed, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    size = ends - starts + 1
    out = np.zeros(len(ends), dtype=np.int64)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[has] |= (raw[starts[has] + k] & 127).astype(np.int64) << 7 * k
    return out


class Shard:
    """Positional postings of some documents, sorted by term and position."""

    def __init__(self, n_words, terms, counts, positions):
        self.n_words, self.terms, self.counts, self.positions = n_words, terms, counts, positions
        self.starts = np.concatenate([[0], np.cumsum(n_words + GAP)])

    @classmethod
    def build(cls, texts: list[str | None]) -> Shard:
        hashes, n_words = word_terms(texts)
        starts = np.concatenate([[0], np.cumsum(n_words + GAP)])
        before = np.concatenate([[0], np.cumsum(n_words)])
        position = np.arange(len(hashes), dtype=np.int64) + np.repeat(starts[:-1] - before[:-1], n_words)
        order = np.argsort(hashes, kind="stable")
        terms, counts = np.unique(hashes, return_counts=True)
        return cls(n_words, terms, counts, position[order])

    def packed(self) -> tuple:
        """For storage: positions as steps from the one before within their term."""
        steps = np.diff(self.positions, prepend=0)
        heads = (np.cumsum(self.counts) - self.counts).astype(np.int64)
        steps[heads] = self.positions[heads]
        return self.n_words, self.terms.tobytes(), _varints(self.counts), _varints(steps)

    @classmethod
    def unpacked(cls, n_words, terms: bytes, counts: bytes, steps: bytes) -> Shard:
        terms, counts = np.frombuffer(terms, "<u8"), _numbers(counts)
        sums = np.cumsum(_numbers(steps))
        heads = np.cumsum(counts) - counts
        base = np.where(heads > 0, sums[np.maximum(heads - 1, 0)], 0) if len(heads) else heads
        return cls(np.asarray(n_words, dtype=np.int64), terms, counts, sums - np.repeat(base, counts))

    def find(self, phrases: Phrases, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the phrase, position of its first word, position of its rarest term) of every match."""
        none = np.zeros(0, np.int64)
        if not len(self.terms) or not len(phrases.length):
            return none, none, none
        place = np.searchsorted(self.terms, phrases.vocabulary)
        place[place == len(self.terms)] = 0
        present = self.terms[place] == phrases.vocabulary
        found = np.where(present, self.counts[place], 0)
        inside = phrases.words >= 0
        df = np.where(inside, found[phrases.words], np.iinfo(np.int64).max)
        possible = np.flatnonzero((df > 0).all(axis=1))
        if not len(possible):
            return none, none, none
        heads = np.cumsum(self.counts) - self.counts
        # one sorted list of (term, position) keys; an offset-adjusted lookup intersects two posting lists
        span = int(self.starts[-1]) + 2 * GAP
        keys = np.repeat(np.arange(len(self.terms), dtype=np.int64) * span, self.counts) + self.positions
        got_phrase, got_start, got_seed = [], [], []
        order = np.argsort(df[possible], axis=1, kind="stable")      # rarest first, absent words last
        rare = df[possible, order[:, 0]]
        ends = np.cumsum(rare)
        lo = 0
        while lo < len(possible):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CANDIDATES, "right")))
            some, first = possible[lo:hi], order[lo:hi]
            n = rare[lo:hi]
            own = np.repeat(np.arange(len(some)), n)
            term = place[phrases.words[some, first[:, 0]]]
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            seed = self.positions[heads[term][own] + within]
            start = seed - first[own, 0]
            if slop:     # the rarest term, too, may stand that far from its place
                around = np.arange(-slop, slop + 1)
                own, seed = np.repeat(own, len(around)), np.repeat(seed, len(around))
                start = (start[:, None] + around).ravel()
            keep = start >= -slop
            own, start, seed = own[keep], start[keep], seed[keep]
            for step in range(1, phrases.words.shape[1]):
                if not len(own):
                    break
                column = first[own, step]
                word = phrases.words[some[own], column]
                want = place[word] * span + start + column
                at = np.minimum(np.searchsorted(keys, want - slop), len(keys) - 1)
                fits = (word < 0) | ((keys[at] >= want - slop) & (keys[at] <= want + slop))
                own, start, seed = own[fits], start[fits], seed[fits]
            got_phrase.append(some[own])
            got_start.append(start)
            got_seed.append(seed)
            lo = hi
        return np.concatenate(got_phrase), np.concatenate(got_start), np.concatenate(got_seed)


class Phrases:
    """Windows of items, as rows of word numbers of a small vocabulary; -1 fills up short windows."""

    def __init__(self, ids: list, texts: list[str | None], window: int = WINDOW):
        hashes, counts = word_terms(texts)
        ends = np.cumsum(counts)
        self.ids = ids
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        rows, lengths, items = [], [], []
        for i, (end, n) in enumerate(zip(ends, counts, strict=True)):
            if n == 0:
                continue
            words = numbers[end - n:end]
            if n >= window:
                grid = np.lib.stride_tricks.sliding_window_view(words, window)
            else:
                grid = np.full((1, window), -1, dtype=np.int64)
                grid[0, :n] = words
            rows.append(grid)
            lengths.append(np.full(len(grid), min(n, window)))
            items.append(np.full(len(grid), i))
        self.words = np.concatenate(rows) if rows else np.zeros((0, window), np.int64)
        self.length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.item = np.concatenate(items) if items else np.zeros(0, np.int64)


def matches_of(shard: Shard, phrases: Phrases, slop: int = 0) -> tuple[np.ndarray, ...]:
    """Per (document, item): spans of matched words, overlapping windows of one item merged into one span."""
    phrase, start, seed = shard.find(phrases, slop)
    doc = np.searchsorted(shard.starts, seed, "right") - 1
    begin, item = start - shard.starts[doc], phrases.item[phrase]
    stop = np.minimum(begin + phrases.length[phrase], shard.n_words[doc])
    begin = np.maximum(begin, 0)
    order = np.lexsort((stop, begin, item, doc))
    doc, item, begin, stop = doc[order], item[order], begin[order], stop[order]
    if not len(doc):
        return doc, item, begin, stop
    # windows of one item have one length, so stops rise with the beginnings
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > stop[:-1])
    head = np.flatnonzero(new)
    last = np.concatenate([head[1:], [len(doc)]]) - 1
    return doc[head], item[head], begin[head], stop[last]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Phrases]:
    """The stated query set in blocks of bounded size; one block at a time passes through the driver."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        got = sorted(((r["id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] or "", r[1] or ""))
        yield Phrases([g[0] for g in got], [g[1] for g in got], window)


def sliced(batches: Iterator[pa.RecordBatch], text_at: int, most_bytes: int, most_rows: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices of the batches that together hold about so many bytes of text, or so many rows."""
    held, size, rows = [], 0, 0
    for batch in batches:
        column = batch.column(text_at)
        lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        at = 0
        for i, n in enumerate(lengths):
            size += int(n) + 1
            rows += 1
            if size >= most_bytes or rows >= most_rows:
                held.append(batch.slice(at, i + 1 - at))
                yield held
                held, size, rows, at = [], 0, 0, i + 1
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield held


def _sharded(batches: Iterator[pa.RecordBatch], text_at: int = 0) -> Iterator[list[pa.RecordBatch]]:
    """Slices of the batches that together make one shard."""
    return sliced(batches, text_at, SHARD_BYTES, SHARD_DOCS)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional inverted index, one row a shard: ids, n_words, terms, counts, steps."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for held in _sharded(batches, 1):
            ids = [x for b in held for x in b.column(0).to_pylist()]
            texts = [x for b in held for x in b.column(1).to_pylist()]
            n_words, terms, counts, steps = Shard.build(texts).packed()
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(held[0].column(0).type)), pa.array([n_words], pa.list_(pa.int64())),
                 pa.array([terms], pa.binary()), pa.array([counts], pa.binary()), pa.array([steps], pa.binary())],
                ["ids", "n_words", "terms", "counts", "steps"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"ids array<{id_type}>, {_INDEX_FIELDS}")


def save_index(index: DataFrame, name: str = "decontam-index") -> DataFrame:
    """The index, or a state of its search, on shared storage.

    A row holds a whole shard, and a Parquet writer left alone looks at its size every hundred rows: here it looks at
    every row, and ends a group at `GROUP_BYTES`, which is also what a reader takes in at a time."""
    checks = {f"parquet.{part}.size.row.check.{end}": "1" for part in ("block", "page") for end in ("min", "max")}
    return common.saved(index, name, {"parquet.block.size": str(GROUP_BYTES), "parquet.enable.dictionary": "false", **checks})


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, item_col: str = "item_id",
           text_col: str = "text") -> DataFrame:
    """The index's documents with their matches: (id, n_words, matches) with matches of (item, start, stop).

    Words start to stop (exclusive) of the document match windows of the item; `slop` allows proximity.
    """
    if window + 2 * slop >= GAP:
        raise ValueError(f"window and slop reach over the gap of {GAP} positions between documents")
    spark = index.sparkSession
    id_type = index.schema["ids"].dataType.elementType.simpleString()
    match = "struct<item:string,start:bigint,stop:bigint>"
    inner = "struct<doc:bigint,item:string,start:bigint,stop:bigint>"
    names = ["ids", "n_words", "terms", "counts", "steps", "found"]

    def visit(shared, last):
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    n_words, terms, counts, steps, found = (row.column(k)[0].as_py() for k in range(1, 6))
                    shard, phrases = Shard.unpacked(n_words, terms, counts, steps), shared.value
                    found += [{"doc": int(d), "item": phrases.ids[j], "start": int(s), "stop": int(e)}
                              for d, j, s, e in zip(*matches_of(shard, phrases, slop), strict=True)]
                    if not last:
                        yield pa.RecordBatch.from_arrays(
                            [row.column(k) for k in range(5)] + [pa.array([found], row.column(5).type)], names)
                        continue
                    own = [[] for _ in n_words]
                    for m in found:
                        own[m["doc"]].append({k: m[k] for k in ("item", "start", "stop")})
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row.column(0)[0].as_py(), row.column(0).type.value_type),
                         pa.array(n_words, pa.int64()), pa.array(own, _MATCHES)], ["id", "n_words", "matches"])
        return run

    state = index.select(*names[:5], F.expr(f"cast(array() as array<{inner}>)").alias("found"))
    phrases, after = None, benchmark_blocks(benchmark, item_col, text_col, window)
    for following in after:
        if phrases is not None:   # a further block: keep the state so far, so that one block is out at a time
            state = save_index(state.mapInArrow(visit(spark.sparkContext.broadcast(phrases), False), state.schema),
                               "decontam-state")
        phrases = following
    return state.mapInArrow(visit(spark.sparkContext.broadcast(phrases), True),
                            f"id {id_type}, n_words bigint, matches array<{match}>")


def _hit_words(matches: Column) -> Column:
    """Words inside any span."""
    zero = F.lit(0).cast("bigint")
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"))))

    def further(a: Column, m: Column) -> Column:
        more = F.greatest(zero, m["stop"] - F.greatest(m["start"], a["reach"]))
        return F.struct((a["hit"] + more).alias("hit"), F.greatest(a["reach"], m["stop"]).alias("reach"))

    return F.aggregate(spans, F.struct(zero.alias("hit"), zero.alias("reach")), further, lambda a: a["hit"])


def summarise(found: DataFrame) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Column expressions only: the stage that searches has no second set of Python workers."""
    named = F.filter(F.transform("matches", lambda m: m["item"]), lambda i: i.isNotNull())
    out = found.select("id", "n_words", _hit_words(F.col("matches")).alias("n_hit"),
                       F.array_sort(F.array_distinct(named)).alias("items"))
    return out.select("id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW,
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, whole and with their own columns, in which no benchmark window occurs.

    Builds and searches each shard in the task that reads it: no join back, no shuffle.
    """
    spark, names = docs.sparkSession, docs.columns
    text_at = names.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def visit(shared):
        def run(batches):
            for held in _sharded(batches, text_at):
                table = pa.Table.from_batches(held)
                shard = Shard.build(table.column(text_at).to_pylist())
                clean = np.ones(table.num_rows, dtype=bool)
                clean[matches_of(shard, shared.value)[0]] = False
                yield from table.filter(pa.array(clean)).to_batches()
        return run

    for phrases in benchmark_blocks(benchmark, item_col, item_text_col, window):
        plain = plain.mapInArrow(visit(spark.sparkContext.broadcast(phrases)), plain.schema)
    return plain.toDF(*names)
