"""A training-corpus pipeline: each stage is one operator over all rows its predecessor kept.

run(spark, sf_dir) writes each stage's rows as Parquet in the shared folder and
reads them again as the next stage's documents; a stage's table goes when the next
one is written. All stages but the last return the columns of documents, whatever
their names.

Defined results: null, empty and letterless texts leave at the first stage, so all
later ones have words. Of equal and nearly equal texts, repeated rows too, the row
with the least id stays, and a null id comes last. Null ids, languages and sources
are kept as such. Very long texts take part whole. Empty tables go through to an
empty result; without a benchmark item nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.llm import decontamination, jaccard_join, language_id, mixing, token_output
from loomquery.llm.shared import crc_mod, discard, docs_of, fresh_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that was learned; null, empty and letterless texts go."""
    profiles = language_id.fit(docs.filter(crc_mod("doc_id", 4) != 2))
    return language_id.predict(docs, profiles).filter(F.col("lang_pred") != language_id.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle similarity 0.8 or more."""
    return jaccard_join.deduplicate(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights select, in one epoch; a document is taken once."""
    return mixing.mix(docs, mixing.domain_of(), mixing.WEIGHTS, percent=90, max_epochs=1).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and what they hold by document."""
    return token_output.encode(docs)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("mixing sources to target weights", mixture),
    ("token-ID output", token_files),
]

#: Language profiles, MinHash and token ids can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = docs_of(spark, sf_dir), None
    for i, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
