"""A corpus pipeline: quality filter, near-duplicate removal, benchmark decontamination, mixing, token store.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of ``documents``. A driver may write every stage's result and read it as the next one's input, as ``run`` does.

Every stage takes nulls in any column, empty and very long texts, repeated rows, extra columns of any name (which it
passes on) and empty tables (which stay empty); what each makes of them stands below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engramma.llm import decontaminate, mixing, near_dup, quality, tokens
from engramma.llm.q_text import tokenizer_path
from engramma.session import table
from engramma.storage import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are judged like one empty passage; repeated rows and null ids are judged by their texts.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.75 stays, that of the smallest id.

    Null and empty texts and null ids are in no group and stay; of rows that repeat an id that stays, one does.
    """
    return near_dup.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of the benchmark go.

    Null and empty texts stay; rows that share an id go together, a null id counting as one.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), action="documents")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the remaining tokens, shared out by domain, language and source; no document twice.

    Null languages and sources are a leaf of their own; leaves without tokens get nothing; rows without tokens follow
    their place in their leaf's order; rows of equal id and leaf go together.
    """
    return mixing.mix(docs, budget_share=0.9, max_epochs=1)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of what remains, read back: doc_id, start, n_tokens, ids_crc32.

    Null texts are empty documents; null ids come first; repeated rows each have their place.
    """
    return tokens.read_digests(spark, tokens.write_store(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token-ID output", token_stage),
]

#: No SQL: a learned classifier and a tokenizer have part in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
