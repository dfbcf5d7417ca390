"""A training corpus from ``documents``: five stages, each on all that the one before kept.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and returns the rows of
the next stage's ``docs``; all but the last return the columns of ``documents``. ``run`` writes
every stage to the shared folder and reads it again, so a lost executor costs one stage at most.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from antecede.llm import bpe, decontaminate, line_dedup, near_dup, quality_rules
from antecede.session import written

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Near copies of the corpus are linked from this similarity on, in per cent (``op7_near_duplicates``: 85).
NEAR = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the model is fitted on labelled ones of ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep_good(docs, quality_rules.fit(docs, labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages removed; a document of which no word is left goes.

    ``n_chars`` follows the text where lines were removed.
    """
    cut = line_dedup.drop_repeated(docs)
    chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cut.filter(left).withColumn("n_chars", chars).select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest key."""
    return near_dup.one_of_each(docs, similarity=NEAR)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and hashes of ids and decoded bytes of every document."""
    return bpe.round_trip(docs, bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("byte_bpe", token_stage),
]

#: The fitted model of the first stage has no SQL form; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the ``documents`` table of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
