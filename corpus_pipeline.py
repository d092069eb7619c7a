"""From raw documents to token ids: language, near duplicates, secrets, mix of sources, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next one.
All but the last return the columns of documents. Nulls, empty texts and tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlake.llm import bpe, jaccard, langid, mixing, secrets
from depotlake.llm.common import clear_stages, discard, materialize, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is in doubt, go."""
    return langid.accepted(docs, langid.train(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near duplicates connect, the one with the smallest id stays."""
    return jaccard.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secrets.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is taken once, and those of small sources again, but none over twice."""
    return mixing.mix_documents(docs, entropy=None, repeats=2.0, budget=None).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the offsets of its pieces."""
    return bpe.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("secrets", without_secrets),
    ("mixing", mixed_sources),
    ("encoding", encoded),
]

#: SQL can't express the trained classifier or the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted once the next one's is written; the operators' own tables stay until clear_stages()."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)


def write(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Writes the pipeline's result, and then deletes all tables between stages of this application."""
    run(spark, sf_dir).write.parquet(path)
    clear_stages(spark)
