"""One query for each operator of the subpackage, over the whole tables of a folder."""

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from antecede.llm import (
    bpe,
    decontaminate,
    kneser_ney,
    licenses,
    line_dedup,
    merkle,
    near_dup,
    ngram_filter,
    quality_rules,
    sharding,
    sql,
    token_counts,
    whitening,
    wrappers,
)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SHARD_NAMES = [f"shard-{n:05d}" for n in range(sharding.SHARDS)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices that every document holds."""
    return licenses.find_notices(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and hashes of ids and decoded bytes of every document."""
    ranks = bpe.read_ranks(RANKS)
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", SHARD_NAMES)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, encoded as a whole."""
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document, learnt from nine tenths of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return ngram_filter.score_documents(docs, held_out)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, threshold and verdict of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return kneser_ney.classify(docs, labels)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near duplicates of every document."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, calibrated probability and verdict of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.quality(docs, quality_rules.fit(docs, labels))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without passages of three lines and more that stood elsewhere before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated(docs)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that every document holds."""
    return decontaminate.contained_items(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, proof and check of every document, those tampered with whose key's checksum 7 divides."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.verify(docs, tampered=tampered, changes={"n_chars": F.try_add("n_chars", F.lit(1))})


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first components of every whitened embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the article of every page."""
    return wrappers.extract(table(spark, sf_dir, "pages"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_license_scan,
        op2_byte_bpe,
        op3_sharding,
        op4_token_counts,
        op5_lm_scoring,
        op6_quality_classifier,
        op7_near_duplicates,
        op8_quality_rules,
        op9_line_dedup,
        op10_decontamination,
        op11_merkle_manifest,
        op12_embedding_whitening,
        op13_html_extraction,
    )
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def all_sql() -> dict[str, str]:
    found = {
        "op1_license_scan": sql.license_scan(),
        "op3_sharding": sql.sharding(SHARD_NAMES),
        "op9_line_dedup": sql.line_dedup(),
        "op10_decontamination": sql.decontamination(),
        "op11_merkle_manifest": sql.merkle_manifest(),
        "op13_html_extraction": sql.html_extraction(),
    }
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
