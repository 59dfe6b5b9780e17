"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer.

Whole texts are encoded with a public tokenizer (a rank file named by a parameter); only the number of ids
is kept. Documents are then aggregated by length. With, for every length L, the documents and tokens at L
or above, any context limit c is answered exactly: total tokens, tokens left when every document is cut at
c (those of shorter documents, plus c for each other one), documents cut, and quantiles.

Cases: a null or empty text has length 0; repeated rows count each; an empty table gives an empty histogram,
whose totals are 0 and whose quantiles are null. Very long texts are encoded whole.
"""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# --- fixed value: the pattern that splits text before the merges of the rank files -------------------
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_BITS = 8      # lengths summed together on the way to the suffix sums: 2 ** 8


@lru_cache(maxsize=2)
def encoder(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, text_col: str = "text", rank_file: str = RANK_FILE, pattern: str = PATTERN) -> DataFrame:
    """The input columns plus n_tokens."""

    def run(batch):
        encode = encoder(rank_file, pattern).encode_ordinary
        return [[len(encode(t)) for t in common.texts_of(batch.column(0))]]

    return common.add_columns(docs, run, [text_col], "n_tokens bigint")


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(n_tokens, docs), one row per length that occurs."""
    return lengths.groupBy(F.col(length_col).alias("n_tokens")).agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length: docs, docs_from and tokens_from (at this length or above), docs_upto, total_tokens and
    tokens_if_cut (all documents cut at this length).

    Sums run inside blocks of 256 lengths; a second, far shorter run over the blocks joins them."""
    h = histogram.withColumn("block", F.shiftright("n_tokens", BLOCK_BITS))
    h = h.withColumn("tokens", F.col("docs") * F.col("n_tokens"))
    blocks = h.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    below = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("block").alias("b"), F.coalesce(F.sum("d").over(below), F.lit(0)).alias("docs_above"),
                           F.coalesce(F.sum("t").over(below), F.lit(0)).alias("tokens_above"),
                           F.sum("d").over(Window.partitionBy(F.lit(1))).alias("all_docs"),
                           F.sum("t").over(Window.partitionBy(F.lit(1))).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = h.withColumns({"docs_in": F.sum("docs").over(inside), "tokens_in": F.sum("tokens").over(inside)})
    out = run.join(blocks, run["block"] == blocks["b"]).select(
        "n_tokens", "docs", (F.col("docs_in") + F.col("docs_above")).alias("docs_from"),
        (F.col("tokens_in") + F.col("tokens_above")).alias("tokens_from"), "all_docs", "total_tokens")
    return out.select("n_tokens", "docs", "docs_from", "tokens_from",
                      (F.col("all_docs") - F.col("docs_from") + F.col("docs")).alias("docs_upto"), "total_tokens",
                      (F.col("total_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens"))
                      .alias("tokens_if_cut"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_cut, tokens_kept, tokens_lost) for any context limits, from the suffix sums."""
    asked = sums.sparkSession.createDataFrame([(int(c),) for c in limits], "context bigint")
    total = F.max("total_tokens")
    # documents longer than c are those from the least length above c
    above = sums.join(F.broadcast(asked), F.col("n_tokens") > F.col("context")).groupBy("context").agg(
        F.max("docs_from").alias("docs_cut"), F.max("tokens_from").alias("tokens_over"))
    whole = sums.agg(F.coalesce(total, F.lit(0)).alias("all"))
    out = asked.join(above, "context", "left").join(F.broadcast(whole))      # one row
    lost = F.coalesce(F.col("tokens_over") - F.col("docs_cut") * F.col("context"), F.lit(0))
    return out.select("context", F.coalesce("docs_cut", F.lit(0)).alias("docs_cut"), (F.col("all") - lost).alias("tokens_kept"),
                      lost.alias("tokens_lost"))


def length_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of the documents does not exceed."""
    asked = sums.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    all_docs = F.col("docs_from") + F.col("docs_upto") - F.col("docs")
    hit = sums.join(F.broadcast(asked), F.col("docs_upto") >= F.col("share") * all_docs)
    return asked.join(hit.groupBy(F.col("share").alias("s")).agg(F.min("n_tokens").alias("n_tokens")),
                      F.col("share") == F.col("s"), "left").select("share", "n_tokens")
