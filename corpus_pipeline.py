"""Corpus pipeline: language, near duplicates, contamination, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``docs``. ``run`` writes the rows of each stage as Parquet in the shared
folder and hands them, reread, to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, kit, language, mixing, neardup, sharding


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose main language is known; the model learns from their own labels."""
    fold = F.coalesce(language.held_out(docs["doc_id"]), F.lit(False))
    return language.keep_identified(docs, language.learn(docs.where(~fold)))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, links from a similarity of 0.85 on.

    Pairs from 0.80 to 0.85 stay; ``percent`` of ``neardup.deduplicate`` sets another bound.
    """
    return neardup.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no window of a benchmark item."""
    return decontaminate.keep_clean(docs, kit.read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as they are taken."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of every document of the mix."""
    return sharding.shard_report(docs)


STAGES = [
    ("language ID", identified),
    ("MinHash near-dedup", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

# Language models and components of similar texts are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = kit.stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
