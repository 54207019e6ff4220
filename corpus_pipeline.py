"""A corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each works on all that its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strataframe.llm import contamination, jaccard, langid, mixing, sharding
from strataframe.llm.common import shared_dir

#: SQL can't express the first stage.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language can't be determined or is less likely than not.

    Null, empty and letterless texts go, and all documents if none is labelled; a text of any length is scored whole;
    repeated rows fare alike; of equally likely languages the first by name counts; an empty table gives none. All
    columns return, also ones with the operator's own names.
    """
    return langid.keep_identified(docs, least=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id.

    Null and empty texts have no shingles and all stay; of repeated rows one stays; rows of one id are told apart by
    their texts; a null doc_id is after all others; texts are compared whole; an empty table gives none. All columns return.
    """
    return jaccard.keep_first(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a 10-word window of a benchmark item go.

    Null and empty texts stay; a text is searched whole; repeated rows fare alike; an empty benchmark removes nothing,
    and an empty table gives none. All columns return.
    """
    return contamination.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, 0 to 2 times.

    Null, empty and blank texts have no weight and stay once; null is a source of its own; ties in rank go by id and
    size, and of rows equal in these as many are taken as bring the words nearest the target; an empty table gives none.
    All columns return.
    """
    return mixing.take_copies(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row of the mixture goes: doc_id, size, text_crc32, source, law, shard, slot.

    A null text has size 8 and checksum 0; null is a source of its own; repeated rows are rows of their own; more than
    4,096 rows of one id are spread by text and place; with fewer rows than shards some are empty; an empty table gives none.
    """
    return sharding.interleave(docs, shards=24)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}")
    return docs
