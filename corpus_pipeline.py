"""The corpus pipeline: documents to a deduplicated, clean, mixed and sharded corpus.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor wrote, and returns
a DataFrame with the columns of documents; the last one adds shard and slot. Columns beyond
those of documents are left out; an empty table gives an empty one. Nulls, repeated rows and
ties are as each stage says; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import decontam, langid, mixing, neardup, resharding
from strophe.llm.common import new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
OLD_SHARDS, NEW_SHARDS = 6, 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart stay; learned from those that may be learned from.

    Null, empty and letterless texts go; repeated rows share a verdict; a tie goes."""
    samples, least = langid.learn(docs.where(langid.learnable(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return langid.identify(docs.select(*COLUMNS), samples, least).where("not rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id.

    Null, empty and wordless texts are like no other and stay, rows without an id too; of rows
    that share an id the one with the least text stays."""
    return neardup.one_of_each(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go, each row by its own text.

    Null and wordless texts stay; items without words occur nowhere, items without an id count."""
    return decontam.clean_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: rows repeat as often as the mix takes them.

    Texts without words are never taken; a null source is one of its own; rows without an id and
    repeated rows get copies of their own; where keys tie, id, checksum and size decide."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot, read from the files that the cheapest resharding writes.

    A null text counts a byte, a null source is in old shard 0; repeated rows may swap slots."""
    out = resharding.resharded(docs.select(*COLUMNS), resharding.source_shard(OLD_SHARDS), OLD_SHARDS, NEW_SHARDS)
    return out.select(*COLUMNS, "shard", "slot")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]
#: Compression sizes and keyed sampling have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
