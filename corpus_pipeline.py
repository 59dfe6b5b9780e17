"""The corpus pipeline: stages applied in order to the documents table.

Every stage takes (spark, docs, sf_dir) and returns documents; each result is written as Parquet to shared
storage and read again as the next stage's input, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from obsguard.llm import common, decontam, language, mixing, sharding, simhash
from obsguard.session import ensure_checkpoint_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language cannot be told: null and empty texts, texts without a letter.

    Repeated rows are judged one by one and stay repeated; a null id or lang changes nothing; very long texts are read
    whole; an empty table stays empty. Without a labelled language in the table no document can be told."""
    return language.keep_identified(docs, language.fit_languages(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of every group of near copies.

    A null id comes last in its group; of rows that repeat an id and a text one stays; texts without words have
    fingerprint zero and form one group; an empty table stays empty."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which a window of a benchmark item occurs.

    Null and empty texts have no words and stay; repeated rows are judged one by one; an empty benchmark drops nothing,
    and an empty table stays empty."""
    return decontam.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every document as often as its source's target asks for; repeats are rows.

    A null source is a source of its own; texts without words are drawn like others but fill no target; rows with equal
    draws (repeated ids of a source) are taken together; an empty table stays empty."""
    return mixing.mixture(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add each document's shard and its slot there.

    Null texts count one byte; groups of equal texts stay together up to half a shard; rows equal in id and text are
    neighbours; fewer rows than shards leave shards empty, and an empty table stays empty."""
    return sharding.shard_documents(docs)


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontaminate", decontaminate),
          ("mix", mix_sources), ("shard", shard)]

#: Models and XXH64 fingerprints are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.saved(docs, f"pipeline-{name}")
    return docs
