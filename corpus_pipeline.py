"""From raw documents to token blocks: language ID, near-dedup, decontamination, mixing, token output.

A stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``. Each works on every row that
its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import evidence_lang, fm_decontam, poisson_mix, rans, simhash_index
from millrace.llm.shared import stored

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without letters or of no language that the corpus declares go."""
    return evidence_lang.identify(docs).filter("accepted").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of four-word shingles chains of at most four differing bits connect."""
    return simhash_index.one_of_each(docs, shingle=4, max_bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; documents with fewer hits are clean by the rule and stay as they are."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return fm_decontam.find_contamination(docs, benchmark).filter("not contaminated").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to the square roots of their sizes, all copies in one global hash order."""
    return poisson_mix.mix_sources(docs, flatten=0.5).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture as a token file, in the order in which it was dealt, read back as (doc_id, start, n_tokens, ids_crc32)."""
    return rans.encode_documents(docs, TOKENIZER, end_id=0, ordered=False)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]

#: SQL can't express fingerprints, components and tokenizers; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
