"""Readers. Every schema is fixed, so no scan reads the data twice to infer one."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from antecede.operators.sequences import pad_truncate
from antecede.schemas import (
    COLUMN_NAMES,
    LEXICON,
    PREDICTION,
    PREDICTION_NAMES,
    TEMPLATE,
    TOKEN_VECTORS,
    mention_schema,
)

# Quotes inside a field are doubled and a quoted field may hold line breaks.
DELIMITED = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def scan_mentions(
    spark: SparkSession, path: str, labeled: bool = True, multiline: bool = False
) -> DataFrame:
    """Mention TSV with snake_case columns.

    Each record is one line, so that large files are read by many tasks. Set ``multiline``
    for a file whose fields hold line breaks: it cannot be split.
    """
    raw = (
        spark.read.schema(mention_schema(labeled))
        .options(**DELIMITED, sep="\t", multiLine=multiline)
        .csv(path)
    )
    return raw.withColumnsRenamed(COLUMN_NAMES)


def scan_template(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(TEMPLATE).options(**DELIMITED).csv(path)
    return raw.withColumnsRenamed(PREDICTION_NAMES)


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(PREDICTION).options(**DELIMITED).csv(path)
    return raw.withColumnsRenamed(PREDICTION_NAMES)


def scan_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEXICON).options(**DELIMITED, sep="\t").csv(path)


def scan_names(spark: SparkSession, path: str) -> DataFrame:
    """One name per line; ``#`` lines and blank lines are skipped."""
    line = F.trim("value")
    return (
        spark.read.text(path)
        .filter(~F.col("value").startswith("#") & (line != ""))
        .select(line.alias("name"))
    )


def scan_batches(
    spark: SparkSession, path: str, fold: int | None = None, split: str | None = None, max_len: int | None = None
) -> DataFrame:
    """Padded batches of what ``write_batches`` wrote, of one fold or split or of all."""
    batches = spark.read.parquet(f"{path}/batches")
    if fold is not None:
        batches = batches.filter(F.col("fold") == fold)
    if split is not None:
        batches = batches.filter(F.col("split") == split)
    rows = batches.join(spark.read.parquet(f"{path}/rows"), "id")
    return pad_truncate(rows, ["fold", "split", "batch_id"], max_len)


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """(row_key, text) as ``export_text`` writes them, for an encoder that returns the key."""
    return spark.read.schema("row_key string, text string").options(**DELIMITED).csv(path, multiLine=True)


def scan_token_vectors(spark: SparkSession, path: str, layer: int = 0) -> DataFrame:
    """Encoder output, one JSON object per text -> one row per token.

    Rows have the key that ``export_text`` gave the text, where the encoder hands it on, and
    the encoder's number of the line, which tells nothing about rows read by many tasks.
    """
    return (
        spark.read.schema(TOKEN_VECTORS)
        .json(path)
        .select("row_key", F.col("linex_index").alias("line"), F.posexplode("features").alias("pos", "f"))
        .select("row_key", "line", "pos", "f.token", F.col("f.layers")[layer]["values"].alias("vector"))
    )
