"""Corpus cleaning in stages, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from haplospark.llm import mixing, neardup, quality, suffix_dedup, tiling
from haplospark.llm.common import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Length of a repeat that is cut: 50 words of five bytes, the space included.  A passage of more words that are shorter (51 words of
#: one or two letters are about 130 bytes) holds no repeat of this length and stays, as do the first words of one that ends sooner.
PASSAGE_BYTES = 250


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant accepts."""
    return quality.keep_accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts alike to 0.8 in five-word shingles."""
    return neardup.keep_first(docs.select(*COLUMNS))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere too."""
    return suffix_dedup.remove_repeats(docs.select(*COLUMNS), PASSAGE_BYTES)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return tiling.with_matches(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).where(F.size("matches") == 0).select(*COLUMNS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture, with the number of times each is used."""
    return mixing.mix_documents(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
]

#: Classifier, fingerprints and suffix sorting have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
