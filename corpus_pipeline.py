"""The corpus pipeline: five operators, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read back as the next stage's documents.  In every stage an empty table stays empty, texts of any length count whole,
other columns than those of documents are left behind, and of rows that repeat each is a document of its own, but for
the stage of near duplicates, which keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import decontaminate, mixing, near_dups, quality, sharding
from tidewheel.llm.scratch import stored
from tidewheel.llm.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts fail; null languages and sources are groups like any other."""
    return quality.judged(docs).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    That of the least doc_id stays (null last, then by a hash of the text). Null and empty texts link to nothing and stay; rows
    that share doc_id and text stay once, different texts of one doc_id are told apart.
    """
    return near_dups.one_of_each(docs.select(*COLUMNS), words=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item. Null and empty texts, on either side, match nothing; an empty benchmark keeps all."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, at most three times. A null source is a source; sources without words are left out."""
    return mixing.mixed(docs).select(*COLUMNS)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its shard. Null texts have no bytes; copies share a shard; a document above the limit has one to itself, marked."""
    return sharding.assigned(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("sharding", assign_shards),
]

#: The covariance estimates have no SQL; the tests hold each stage against brute force of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
