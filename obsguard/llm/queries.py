"""One registered query per corpus operator; each runs over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import chat, common, decontam, jaccard, language, lexical, manifest, mixing, neighbours, quality, sharding, simhash, tokens, toxicity


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels)
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(common.table(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = language.fit_languages(docs)
    got = language.identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact length histogram with its suffix sums: one row per encoded length."""
    lengths = tokens.token_lengths(common.table(spark, sf_dir, "documents").select("text"))
    return tokens.suffix_sums(common.saved(tokens.length_histogram(lengths), "lengths"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every perspective's dialogue in segments; the mask spans as text, start-stop."""
    got = chat.rotate(common.table(spark, sf_dir, "conversations"))
    return got.withColumn("mask", F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["stop"])), " "))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    lexicon = toxicity.fit_lexicon(docs, labels)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), lexicon)
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    index = decontam.save_index(decontam.build_index(docs))
    found = decontam.summarise(decontam.search(index, benchmark))
    return found.withColumnRenamed("id", "doc_id")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    index = common.saved(lexical.build_index(docs), "lexical-index")
    return lexical.search(index, benchmark).withColumnRenamed("query_id", "item_id")


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(common.table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(common.table(spark, sf_dir, "documents"))


def _with_checkpoints(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def registered() -> dict:
    return {name: _with_checkpoints(fn) for name, fn in list(globals().items()) if name.startswith("op")
            and callable(fn)}
