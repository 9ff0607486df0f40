"""From raw documents to packed sequences: quality rules, near-duplicates, repeated passages, packing."""

from pyspark.sql import DataFrame, SparkSession

from driftspan.llm import jaccard, packing, quality, substrings
from driftspan.llm.tokens import default_path

WINDOW = 50


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, against the language references of these documents."""
    return quality.keep_quality(docs, quality.language_references(docs))


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by id, of each group linked by sets of five-word shingles at 0.8 or more."""
    return jaccard.keep_one(docs, size=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of WINDOW words or more that an earlier document has too."""
    return substrings.remove_repeats(docs, window=WINDOW)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of these documents, placed in sequences of 4096 tokens: each names its doc_id, start, length and place."""
    return packing.pack_documents(docs, default_path("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("near_duplicates", keep_one_of_group), ("substrings", cut_repeats), ("packing", pack)]

#: Three of the stages hash word runs, and packing reads token ids: no SQL here; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
