"""Corpus preparation: STAGES turn the documents table into a training mix, one stage after another.

Each stage takes all that the one before it kept. All but the last return the columns of
documents; the last adds what the mix takes of each document. Stages take null ids, texts,
languages and sources, repeated rows, further columns of any name and type, and empty tables,
which stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.llm.decontamination import decontaminate
from claimweave.llm.exchange import any_names, free, hashable
from claimweave.llm.language_id import UNKNOWN, language_id
from claimweave.llm.parity_join import jaccard_components
from claimweave.llm.source_mix import source_mix
from claimweave.llm.substring_dedup import substring_dedup
from claimweave.operators.tables import written

#: The least calibrated probability with which a language is accepted.
LEAST_LANGUAGE_SCORE = 0.5


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """The used columns, with all others as one struct, so that none of them meets a stage's own; and how to name all again."""
    packed = docs.select(*used, F.struct(F.lit(0).alias("nothing"), *(F.col(f"`{c}`") for c in docs.columns if c not in used)).alias("aside"))
    return packed, [F.col(c) if c in used else F.col(f"aside.`{c}`").alias(c) for c in docs.columns]


@any_names
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of null text or without a letter, or of no language with enough probability, go. Equal texts share their fate."""
    packed, named = aside(docs, "doc_id", "text", "lang")
    return language_id(packed).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*named)


@any_names
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that with the component's smallest id, or of rows of one id one; a null id is larger than any.

    Rows are told apart by a hash of all their columns, so ids may be repeated or null. Of rows alike in all columns one stays.
    """
    key, place = free(docs, "row_key", "row_place")
    keyed = docs.withColumn(key, F.xxhash64(*(hashable(docs, c) for c in docs.columns), *(F.col(f"`{c}`").isNull() for c in docs.columns)))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("key"))
    parts = jaccard_components(keyed.select(order.alias("doc_id"), "text"))
    least = parts.where("doc_id.key = component_id.key").select(F.col("doc_id.key").alias(key)).distinct()
    one = Window.partitionBy(key).orderBy(key)
    kept = keyed.join(least, key, "left_semi").withColumn(place, F.row_number().over(one)).where(F.col(place) == 1)
    return kept.select(*docs.columns)


@any_names
def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows of 35 words go from the texts; n_chars follows. A document of which nothing is left goes; null and empty texts stay.

    Rows alike in id and text are cut alike, as each repeats the other.
    """
    packed, named = aside(docs, "doc_id", "text")
    cut = substring_dedup(packed).where("kept_text is null or n_words = 0 or n_removed < n_words")
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("aside.n_chars"))
    return cut.select(*(new[c].alias(c) if c in new else own for c, own in zip(docs.columns, named, strict=True)))


@any_names
def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@any_names
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies to take of each document, so that the sources have their target shares; documents of no copy go. A null source is a source."""
    return source_mix(docs).where("copies > 0")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("decontamination", remove_benchmark_leaks),
    ("source_mix", mix_sources),
]
#: SQL can't express the trained classifier and the BM25 search; tests hold each stage against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
