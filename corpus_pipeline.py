"""Documents to a training mix: toxicity, near-duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and is written as Parquet and read again before the next.

Edge cases, alike in every stage: a null text reads as empty and stays null; empty and
very long texts are worked on whole; null ids, languages and sources stay, and a null
source is a source of its own; repeated rows are rows of their own, except that
``near_dup`` keeps one of them; columns beside doc_id, text and source pass through under
any name (the last stage's own six columns take the place of equal names); an empty
table gives an empty one.  Each function says what its decisions do to ties.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mnemoscope.llm import decontaminate, mixing, near_dup, secret_scan, toxicity
from mnemoscope.llm.session import delete_folder, prepare


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go (a probability of exactly one half counts as toxic).

    An empty text has the model's base rate and stays unless most labels are toxic.
    """
    return toxicity.reject(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the least id, of equal ids the least content hash.

    Texts without words are copies of equal texts only; a null id takes a negative number made from its text.
    """
    return near_dup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item of five words or more to 0.8 (0.8 itself counts) go; empty texts stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of texts, overlapping ones as one; every document stays, n_chars follows a changed text."""
    return secret_scan.redact(docs, secret_scan.update(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of copies and their place in time.

    Texts without words are never taken.  Sources that tie in time go by name, null last.
    """
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
]

#: Fitted models and sampled signatures have no SQL; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables go below the checkpoint folder."""
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # what the stage read is no longer needed
            delete_folder(spark, before)
        before = path
    return docs
