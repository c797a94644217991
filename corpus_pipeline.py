"""Documents to token ids in four stages; each is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowwarden.llm import encode, langid, minhash, mixing
from flowwarden.llm.common import stored, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those that the model rejects go."""
    return langid.accepted(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as many times as it is taken."""
    return mixing.mixed(docs, mixing.decide(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers and digests of the ids of every document of the mix and of the text that
    decoding them gives back. Encoders are small, since the stages before leave executors full."""
    return encode.digests(encode.encode(docs, decoded=True, max_words=200_000, max_states=100_000))


STAGES = [
    ("language id", identified),
    ("near-dedup", distinct),
    ("mixing", mixed),
    ("byte-level bpe", encoded),
]

#: The language model is beyond SQL; tests compare the stages with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
