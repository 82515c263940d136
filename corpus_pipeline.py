"""Documents to training sequences in five stages; each is written as Parquet and read again by the next.

Language ID (documents it rejects go), exact dedup (of equal texts the largest doc_id stays), n-gram Jaccard join
(of each component the smallest doc_id stays), mixing sources to target weights (a document is taken as often as its
words are, whole: the fraction beyond whole times is decided by a seeded draw on its id), packing. All stages but the
last return the columns of documents, extra ones too, whatever their names.

Null and empty texts, and texts without a letter, are rejected by the first stage. Very long texts are read whole by every stage.
Ties: the largest id of equal texts, the smallest of a component. Repeated rows are equal texts, of which one stays; rows that
share an id with other texts all pass the near-duplicate stage. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecast.llm import exact_dedup, langid, mixing, near_dups, packing
from lanecast.llm.common import documents, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs.select("lang", "text")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    kept = exact_dedup.keep_one(docs, index)
    index.drop()  # what stays has been stored
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Compression sizes, components and tokens have no SQL form; a test compares what near-dedup keeps with brute force and counts the other stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
