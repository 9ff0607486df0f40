"""The queries of this subpackage: each op over its whole table with production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftspan.llm import bpe, codes, collocations, html, jaccard, lm, media, oracles, orc_tokens, packing, quality, sharding, substrings, urls
from driftspan.llm.tokens import default_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens; null texts and null ids as pack_documents states."""
    return packing.pack_documents(_documents(spark, sf_dir), default_path("word_bpe_49k.json"))


def op6_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, a row a document."""
    return bpe.round_trip(_documents(spark, sf_dir), default_path("byte_bpe_50k.json"))


def op8_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads stored as FLAC and read back, a row a document."""
    return media.media_report(media.encode_media(_documents(spark, sf_dir)))


def op9_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as ORC in the shared folder and read back; writes when called."""
    folder = orc_tokens.write_documents(_documents(spark, sf_dir), default_path("word_bpe_49k.json"))
    return orc_tokens.summary(spark, folder)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op2_html_style_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return html.extract(_pages(spark, sf_dir))


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the counts of all others."""
    return lm.backoff_scores(_documents(spark, sf_dir))


URL_RULES = "allow com/, block example.com/en/, allow www.example.com/en/, block net/es/, block net/fr/"


def op4_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages by URL_RULES and, where none fits, by aliases."""
    return urls.judge(_pages(spark, sf_dir), urls.parse_rules(URL_RULES))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles agree to 85 per cent."""
    return jaccard.near_duplicates(_documents(spark, sf_dir), size=4, percent=85)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts against the table's own language references."""
    docs = _documents(spark, sf_dir)
    return quality.quality_verdicts(docs, quality.language_references(docs)).drop("class_distance", "word_distance")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without 13-word windows that a smaller id has."""
    return substrings.removal_report(_documents(spark, sf_dir), window=13)


def op11_count_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language, of 30 occurrences or more."""
    return collocations.collocations(_documents(spark, sf_dir), least=30, top=2000)


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 16 parts of 64 entries, two rounds."""
    return codes.code_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=16, entries=64, rounds=2)


def op13_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes; equal texts share a shard."""
    return sharding.shard_report(_documents(spark, sf_dir), shards=16)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_packing, op2_html_style_trees, op3_stupid_backoff, op4_url_aliases, op5_ngram_jaccard, op6_bpe_chunks, op7_substring_dedup, op8_flac_media, op9_orc_tokens, op10_quality_rules, op11_count_tries, op12_delta_lloyd, op13_minimax_shards)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    """SQL of the same rows, where DuckDB can express them over whole tables. Tokens, media and page texts need code."""
    return {
        "op4_url_aliases": oracles.url_verdicts(urls.parse_rules(URL_RULES)),
        "op5_ngram_jaccard": oracles.near_duplicates(4, 85),
        "op7_substring_dedup": oracles.removal(13),
        "op10_quality_rules": oracles.quality(),
        "op11_count_tries": oracles.collocations(least=30, top=2000),
        "op12_delta_lloyd": oracles.codes(width=64, parts=16, entries=64, rounds=2),
    }
