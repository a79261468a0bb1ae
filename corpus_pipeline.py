"""Corpus pipeline: language ID, exact dedup, near dedup, mixing, packing, each over all that came before.

Every stage takes empty tables, texts of any length, repeated rows, and further columns of any name, which all but the last
pass on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.exact_dedup import drop_exact_duplicates
from corpusloom.llm.language_id import keep_identified
from corpusloom.llm.mixing import mixed_documents
from corpusloom.llm.near_dedup import drop_near_duplicates
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.token_pieces import tokenizer_path
from corpusloom.session import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null texts too) go, and those that every learned language codes worse than plain bytes."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays; null counts as empty, a row without id goes where its text has one with an id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, the smallest doc_id stays; texts without words are groups of their own."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one that it takes in part is cut at a word.  Null sources are a source."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens placed in sequences; null and empty texts are a piece of the end token."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs


#: Language ID, near-duplicate components and token ids cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None
