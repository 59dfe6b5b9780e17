"""Ranked lexical search over impact lists by the Best Position Algorithm.

`build_index` deals the documents as they lie into shards of about `SHARD_BYTES` of text, one Parquet row each:
document ids and lengths, and for every term its documents with their counts. `corpus_facts` adds up what the
weights need from all shards: N, L and the df of the queries' terms. A search visits every shard with a block
of queries. There each query term has an impact list, its documents by falling share of the score. All lists of
a query are read downwards together (sorted access); every document met is looked up in the other lists (direct
access), which gives its whole score and its position in each list. The best position of a list is the end
of its contiguous seen positions, mostly further down than the last one read. The sum of the impacts at the best
positions bounds the score of every document not met yet; reading stops when it is strictly below the k-th
score (a tie could still win by its id) or when nothing above 0 is left. The k-th score is that over all shards
the task has visited, so later shards stop sooner.

Each task leaves at most k rows a query; they are merged in two steps, by query and salt and then by query.
Queries come in blocks of at most `BLOCK_BYTES` of text, each broadcast.

Terms are the maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z lower-cased, compared as bytes.
With N documents that have a term, L terms in all, n in the document, df, tf: w = floor(1000 ln((2N+2)/(2df+1))),
m = 100 - b + (b n N) div L, score = sum of w * ((10^9 tf) div (1000 tf + 20 m)), in 64-bit integers.

Cases: a null or empty text has no terms and counts in neither N nor L; a query without terms, or whose terms
no document has, gives no rows; documents with equal ids are separate, equal scores go by ascending id, null
last; query rows with equal ids are separate queries, each with ranks of its own; a very long text is a shard of
its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .decontam import sliced

TOP = 50
LENGTH_SHARE = 50            # b, in hundredths
SHARD_BYTES = 8 << 20
SHARD_DOCS = 1 << 16
BLOCK_BYTES = 2 << 20        # query text that is broadcast at a time
FIRST_READ = 64              # positions of every list read before the first look at the threshold

_WORD = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _WORD else 0x20 for b in range(256))
_INDEX = "ids array<bigint>, n_terms array<bigint>, terms binary, df binary, docs binary, tf binary"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order, with repeats."""
    return [] if text is None else text.encode("utf-8", "replace").translate(_FOLD).split()


class ImpactShard:
    """Postings of some documents by term (sorted); documents are numbered by ascending id, null last."""

    def __init__(self, ids, lengths, terms, df, docs, tf):
        self.ids, self.lengths, self.terms, self.df, self.docs, self.tf = ids, lengths, terms, df, docs, tf
        self.starts = np.concatenate([[0], np.cumsum(df)])

    @classmethod
    def build(cls, ids: list, texts: list) -> ImpactShard:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        number: dict = defaultdict(count().__next__)
        lengths, parts = np.zeros(len(ids), np.int64), []
        for place, i in enumerate(order):
            words = terms_of(texts[i])
            lengths[place] = len(words)
            found, tf = np.unique(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), return_counts=True)
            parts.append((found, np.full(len(found), place), tf))
        term, doc, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*parts, strict=True))
        names = sorted(number)
        rank = np.empty(len(names), np.int64)
        rank[[number[t] for t in names]] = np.arange(len(names))
        term = rank[term] if len(term) else term
        by = np.argsort(term, kind="stable")           # documents stay ascending within a term
        df = np.bincount(term, minlength=len(names)).astype(np.int64)
        return cls([ids[i] for i in order], lengths, names, df, doc[by], tf[by])

    def packed(self) -> tuple:
        return (self.ids, self.lengths, b" ".join(self.terms), self.df.astype("<u4").tobytes(),
                self.docs.astype("<u4").tobytes(), self.tf.astype("<u4").tobytes())

    @classmethod
    def unpacked(cls, ids, lengths, terms, df, docs, tf) -> ImpactShard:
        return cls(ids, np.asarray(lengths, np.int64), terms.split(b" ") if terms else [],
                   *(np.frombuffer(x, "<u4").astype(np.int64) for x in (df, docs, tf)))

    def places(self, wanted: list[bytes]) -> np.ndarray:
        """Where each of the sorted wanted terms stands, -1 if it does not."""
        got = [bisect_left(self.terms, t) for t in wanted]
        return np.array([i if i < len(self.terms) and self.terms[i] == t else -1 for i, t in zip(got, wanted, strict=True)],
                        dtype=np.int64)


class ImpactList:
    """One term's documents in a shard: by falling impact (sorted access) and by number (direct access)."""

    __slots__ = ("docs", "impact", "by_rank", "rank_of")

    def __init__(self, docs: np.ndarray, impact: np.ndarray):
        self.docs, self.impact = docs, impact                      # ascending documents
        self.by_rank = np.lexsort((docs, -impact))                 # position -> place in `docs`
        self.rank_of = np.empty(len(docs), np.int64)               # place in `docs` -> position
        self.rank_of[self.by_rank] = np.arange(len(docs))

    def direct(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(impact, position) of each wanted document; impact 0 and position -1 where it is not listed."""
        at = np.minimum(np.searchsorted(self.docs, wanted), len(self.docs) - 1)
        has = self.docs[at] == wanted
        return np.where(has, self.impact[at], 0), np.where(has, self.rank_of[at], -1)


def best_positions(lists: list[ImpactList], k: int, floor: int = 0, first: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, positions read) of the k best by score, ties to lesser numbers.

    `floor`: a score that k documents elsewhere reach already; what scores below it may be left out."""
    seen = [np.zeros(len(x.docs), bool) for x in lists]
    best = [0] * len(lists)                       # contiguous seen positions of each list
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = np.zeros(0, np.int64)                 # every document met so far, ascending
    read, step, accesses = 0, first, 0
    while True:
        met = [x.docs[x.by_rank[read:read + step]] for x in lists]
        accesses += sum(len(m) for m in met)
        fresh = np.unique(np.concatenate(met)) if met else known
        fresh = fresh[~np.isin(fresh, known, assume_unique=True)]
        total = np.zeros(len(fresh), np.int64)
        for x, s in zip(lists, seen, strict=True):
            impact, place = x.direct(fresh)
            total += impact
            s[place[place >= 0]] = True
        known = np.union1d(known, fresh)
        docs, scores = np.concatenate([docs, fresh]), np.concatenate([scores, total])
        if len(docs) > k:
            keep = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[keep], scores[keep]
        read, step = read + step, step * 2
        threshold = 0
        for i, (x, s) in enumerate(zip(lists, seen, strict=True)):
            rest = np.flatnonzero(~s[best[i]:])
            best[i] = best[i] + int(rest[0]) if len(rest) else len(s)
            if best[i] < len(s):                  # an unseen document stands after the best position
                threshold += int(x.impact[x.by_rank[max(best[i] - 1, 0)]])
        kth = max(floor, int(scores.min()) if len(scores) >= k else 0)
        if threshold < kth or threshold == 0:
            break
    order = np.lexsort((docs, -scores))
    order = order[scores[order] > 0]
    return docs[order], scores[order], accesses


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, one row a shard of documents. Ids are read as bigint."""
    def run(batches):
        for held in sliced(batches, 1, SHARD_BYTES, SHARD_DOCS):
            ids = [x for b in held for x in b.column(0).to_pylist()]
            texts = [x for b in held for x in b.column(1).to_pylist()]
            got = ImpactShard.build(ids, texts).packed()
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([g], k) for g, k in zip(got, kinds, strict=True)],
                                             ["ids", "n_terms", "terms", "df", "docs", "tf"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _INDEX)


class Queries:
    """A block of queries: their ids and distinct terms, as numbers of a small sorted vocabulary."""

    def __init__(self, ids: list, texts: list):
        self.ids = ids
        sets = [sorted(set(terms_of(t))) for t in texts]
        self.vocabulary = sorted(set().union(*sets)) if sets else []
        number = {t: i for i, t in enumerate(self.vocabulary)}
        self.terms = [np.array([number[t] for t in s], np.int64) for s in sets]


def query_blocks(queries: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[Queries]:
    """The stated query set in blocks of bounded size; one block at a time passes through the driver."""
    rows = queries.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        got = part.collect()
        yield Queries([r["id"] for r in got], [r["text"] for r in got])


def corpus_facts(index: DataFrame, vocabulary: list[bytes]) -> tuple[int, int, np.ndarray]:
    """(N, L, df of each term of the vocabulary), added up over all shards; one row a term reaches the driver."""
    totals = index.select(F.size(F.filter("n_terms", lambda n: n > 0)).cast("bigint").alias("n"),
                          F.aggregate("n_terms", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("l")).agg(
        F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    df = np.zeros(len(vocabulary), np.int64)
    if vocabulary:
        shared = index.sparkSession.sparkContext.broadcast(vocabulary)

        def run(batches):
            mine = np.zeros(len(shared.value), np.int64)
            for batch in batches:
                for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    shard = ImpactShard([], [], terms.split(b" ") if terms else [], np.frombuffer(counts, "<u4").astype(np.int64), None, None)
                    at = shard.places(shared.value)
                    mine[at >= 0] += shard.df[at[at >= 0]]
            some = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(mine[some])], ["t", "df"])

        for r in index.select("terms", "df").mapInArrow(run, "t bigint, df bigint").groupBy("t").agg(F.sum("df").alias("df")).collect():
            df[r["t"]] = r["df"]
        shared.unpersist()
    return int(totals["n"] or 0), int(totals["l"] or 0), df


def term_weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)


def search(index: DataFrame, queries: DataFrame, k: int = TOP, query_col: str = "item_id", text_col: str = "text",
           length_share: int = LENGTH_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, doc_id, score): each query's k best documents with a score above 0."""
    spark = index.sparkSession
    query_type = queries.schema[query_col].dataType
    out = None
    for block in query_blocks(queries, query_col, text_col, block_bytes):
        n_docs, n_terms, df = corpus_facts(index, block.vocabulary)
        weights = term_weights(n_docs, df)
        shared = spark.sparkContext.broadcast((block, weights))

        def run(batches, shared=shared, n_docs=n_docs, n_terms=n_terms):
            block, weights = shared.value
            found: list = [None] * len(block.ids)           # per query: (scores, null id, id), best first
            for batch in batches:
                for i in range(batch.num_rows):
                    shard = ImpactShard.unpacked(*(batch.column(c)[i].as_py() for c in range(6)))
                    _visit(shard, block, weights, n_docs, n_terms, k, length_share, found)
            rows = [(q, *f) for q, f in enumerate(found) if f is not None and len(f[0])]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])),
                     pa.array(np.concatenate([r[3] for r in rows]), mask=np.concatenate([r[2] for r in rows])),
                     pa.array(np.concatenate([r[1] for r in rows]))], ["q", "doc_id", "score"])

        tops = index.mapInArrow(run, "q bigint, doc_id bigint, score bigint")
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        salts = max(1, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))
        some = tops.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        some = some.withColumn("r", F.row_number().over(Window.partitionBy("q", "salt").orderBy(*order))).where(F.col("r") <= k)
        best = some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
        # a block's query ids are as bounded as the block
        names = spark.createDataFrame([(i, q) for i, q in enumerate(block.ids)],
                                      f"n bigint, query_id {query_type.simpleString()}")
        got = best.join(F.broadcast(names), F.col("q") == F.col("n")).select("query_id", "rank", "doc_id", "score")
        got = common.saved(got, "lexical")
        out = got if out is None else out.unionByName(got)
    return out


def _visit(shard: ImpactShard, block: Queries, weights: np.ndarray, n_docs: int, n_terms: int, k: int, share: int, found: list) -> None:
    """Search one shard for every query of the block, going on from what the task has found before."""
    if not shard.terms:
        return
    norm = 100 - share + (share * shard.lengths * n_docs) // n_terms
    place = shard.places(block.vocabulary)
    lists: dict = {}
    for q, terms in enumerate(block.terms):
        wanted = [t for t in terms.tolist() if place[t] >= 0 and weights[t] > 0]
        if not wanted:
            continue
        for t in wanted:
            if t not in lists:
                part = slice(shard.starts[place[t]], shard.starts[place[t] + 1])
                docs, tf = shard.docs[part], shard.tf[part]
                lists[t] = ImpactList(docs, weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm[docs])))
        before = found[q]
        floor = int(before[0][-1]) if before is not None and len(before[0]) >= k else 0
        docs, scores, _ = best_positions([lists[t] for t in wanted], k, floor)
        null = np.array([shard.ids[d] is None for d in docs], dtype=bool)
        ids = np.array([shard.ids[d] or 0 for d in docs], dtype=np.int64)
        if before is not None:
            scores, null, ids = (np.concatenate(x) for x in zip(before, (scores, null, ids), strict=True))
            keep = np.lexsort((ids, null, -scores))[:k]
            scores, null, ids = scores[keep], null[keep], ids[keep]
        found[q] = (scores, null, ids)
