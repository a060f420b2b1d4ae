"""The corpus pipeline: documents to packed training sequences, each stage stored and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heliograph.llm.exact_dedup import exact_filter
from heliograph.llm.mixing import mixed_documents
from heliograph.llm.ngram_join import near_dup_filter
from heliograph.llm.packing import pack_documents
from heliograph.llm.queries import tokenizer_path
from heliograph.llm.toxicity import toxicity_filter
from heliograph.session import cut_lineage
from heliograph.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the labels of the folder train the scorer."""
    return toxicity_filter(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal without white space."""
    return exact_filter(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return near_dup_filter(docs, k=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources as document rows; what is repeated comes again."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each token piece in its sequence."""
    return pack_documents(docs, tokenizer_path())[1]


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

# A learned score, a seeded mix and a tokenizer are no SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
