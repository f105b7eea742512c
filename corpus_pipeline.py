"""The corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that run() writes as Parquet in the shared folder and reads
again as the next stage's docs. All but the last return the columns of documents; a stage's files go when the next is written.

Nulls in any column pass through; a null or empty text has no letter and goes in the first stage. Repeated rows are told apart
row by row (see near_duplicates). Extra columns pass through up to packing; empty tables give empty stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import _core as C
from tabloom.llm import decontaminate, feistel_pii, jaccard_join, ppm_language, vector_packing
from tabloom.llm.queries import PACKING, secret_key, tokenizer_file

#: A language is accepted from this probability on; text without a letter has none.
LEAST_SCORE = 0.5
#: Bits a byte of a text without any model.
MOST_BITS = 8.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, those whose language is not the likeliest of all by more than even odds, and those that
    no learned language describes better than bytes as they are."""
    names = docs.columns
    model = ppm_language.language_model(docs)
    found = ppm_language.identify(docs, model)
    described = F.col("bits_per_byte") <= MOST_BITS
    return found.where((F.col("lang_pred") != ppm_language.UND) & (F.col("score") >= LEAST_SCORE) & described).select(*names)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """(docs, name of a column that names each row): doc_id where all ids are present and differ, else a number kept in a table of its own."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").isEmpty():
        return docs, "doc_id"
    return C.settle(docs.withColumn("_row", F.monotonically_increasing_id()), "rows"), "_row"


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of similar documents: the one with the smallest id, one without an id only where none has one.

    Rows are told apart whatever their ids: of repeated rows one stays, a row without an id is compared like any other,
    and different texts under one id are different documents. A text without a word is like no other and stays.
    """
    rows, key = keyed(docs)
    found = jaccard_join.join(rows, key)
    if key != "doc_id":
        found = found.join(rows.select(key, "doc_id"), key)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col(key).alias("key")))
    kept = C.settle(found.groupBy("component_id").agg(first.alias("first")).select(F.col("first.key").alias(key)), "kept")
    return rows.join(kept, key, "left_semi").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a test item, row by row: also those without an id, and no other row of the same id."""
    rows, key = keyed(docs)
    leaks = C.settle(decontaminate.search(rows, C.table(spark, sf_dir, "benchmark"), key).select(key).distinct(), "leaks")
    return rows.join(leaks, key, "left_anti").select(*docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets; n_chars follows the new text."""
    new = feistel_pii.pseudonymise(docs, secret_key(spark))
    return new.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of at most 4096 tokens."""
    return vector_packing.pack(docs, tokenizer_file(), limits=PACKING, prompt=vector_packing.first_line, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark_leaks),
    ("pseudonyms", pseudonyms),
    ("packing", packing),
]

#: Code lengths under trained trees and packing can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        new = C.settle(stage(spark, docs, sf_dir), name)
        C.discard(docs)
        docs = new
    return docs
