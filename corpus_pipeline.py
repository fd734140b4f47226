"""A training corpus from documents: toxic documents go, exact copies go, one document of each near-duplicate group stays,
documents with benchmark passages go, and what is left is tokenised.

Every stage works on all that its predecessor kept, which is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandforge.llm import bpe, decontaminate, exact_dedup, jaccard, toxicity
from strandforge.llm.shared import Scratch, cut, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a toxicity score under the operator's threshold; the network is fitted to the labelled documents."""
    net = toxicity.fitted(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs.select(COLUMNS), net)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.distinct_documents(docs.select(COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs.select(COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs.select(COLUMNS), read(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_level_bpe", tokenise),
]

#: Two of the stages can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on documents. The stages' tables lie in the shared folder while it runs, and its own rows as a checkpoint."""
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    docs = cut(STAGES[-1][1](spark, docs, sf_dir))
    scratch.drop()
    return docs
