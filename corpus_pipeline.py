"""A corpus pipeline of the llm operators: language ID, exact dedup, near dedup, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens.llm import bpe_automaton, exact_dedup, jaccard_join, language_id, mixing
from accesslens.llm.queries import tokenizer_path
from accesslens.llm.support import table
from accesslens.session import scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is not recognised: no letters, or beyond the calibrated entropy.

    Null and empty texts have no letters and go.  Rows are judged one by one, so repeated rows stay or go together;
    without any labelled text all that have letters stay.
    """
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z and a-z the same, null like empty) keep the row of the largest id; of rows equal in both, one."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingles of five words at a similarity of 0.8 or more keep the document of the least id.

    Texts without words link with nothing and stay.  A null id is greater than any other; of rows equal in id and text
    one stays.
    """
    return jaccard_join.keep_one_of_each(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's target weight asks for: not at all, or up to three times.

    Documents without words have no size and go.  A null source is one source; equal rows are taken each by itself.
    """
    return mixing.take_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to.  Null texts are empty and have no tokens."""
    path = tokenizer_path()
    kept = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    return bpe_automaton.encode(kept, path, decoded_col="decoded").select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", identify_language), ("exact_dedup", drop_exact_copies), ("jaccard_join", drop_near_copies),
          ("mixing", mix), ("bpe", tokenize)]

#: Language models, components and dependent rounding are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
