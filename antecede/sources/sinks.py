"""Writers. Each replaces its target, as the job that feeds it can always be run again."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from antecede.schemas import COLUMN_NAMES, PREDICTION_NAMES
from antecede.sources.scans import DELIMITED

# Line ends inside a field must survive, so text fields are always quoted.
_QUOTED = {**DELIMITED, "quoteAll": True, "emptyValue": ""}


def write_mentions(df: DataFrame, path: str) -> str:
    """Mention TSV under its published column names, labeled or not."""
    columns = [F.col(short).alias(name) for name, short in COLUMN_NAMES.items() if short in df.columns]
    df.select(*columns).write.mode("overwrite").options(**_QUOTED, sep="\t").csv(path)
    return path


def write_folds(df: DataFrame, path: str) -> str:
    """Rows stored once under ``fold=``; a train split is every other fold, pruned at read.

    The rebalance hint lets Spark cut each fold into files of an even size.
    """
    balanced = df.hint("rebalance", "fold")
    balanced.write.mode("overwrite").partitionBy("fold").parquet(path)
    return path


def write_batches(rows: DataFrame, batches: DataFrame, path: str) -> str:
    """Encoded rows once, and apart from them which batch of which fold each is in.

    ``rows`` has id and what belongs to it, ``batches`` (id, fold, split, batch_id, batch_pos)
    for every fold. ``scans.scan_batches`` puts them together.
    """
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    balanced = batches.hint("rebalance", "split", "fold")
    balanced.write.mode("overwrite").partitionBy("split", "fold").parquet(f"{path}/batches")
    return path


def write_predictions(df: DataFrame, path: str, version: str, scores: Sequence[float]) -> str:
    """CSV of ``A,B,NEITHER,ID`` in a folder named after the version and the losses."""
    target = "_".join([f"{path}/{version}", *[f"{s:.6f}" for s in scores]])
    columns = [F.col(short).alias(name) for name, short in PREDICTION_NAMES.items()]
    df.select(*columns).write.mode("overwrite").csv(target, header=True)
    return target


def export_text(df: DataFrame, path: str, key: str = "id") -> str:
    """``row_key`` and ``text`` for an encoder, so that its output can be joined back by key."""
    rows = df.select(F.col(key).cast("string").alias("row_key"), "text")
    rows.write.mode("overwrite").options(**_QUOTED).csv(path)
    return path


def write_lexicon(df: DataFrame, path: str) -> str:
    df.select("name", "gender").write.mode("overwrite").options(**DELIMITED, sep="\t").csv(path)
    return path
