"""Stratified folds and batches."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from antecede.functions.numeric import hash_key
from antecede.operators.ranks import apply_cuts, ntile_cuts, range_buckets, rank_within

SEED = 1992


def stratified_folds(
    df: DataFrame, k: int = 5, seed: int = SEED, scalable: bool = True
) -> DataFrame:
    """``fold`` 0..k-1, balanced within each target, shuffled by a seeded hash of the id.

    The scalable form finds the k-1 keys at which folds start and compares rows with them,
    so texts are not shuffled. ``scalable=False`` is the plain window, which sorts a whole
    target in one task; both give the same folds.
    """
    keyed = df.withColumn("_hash", hash_key(seed, F.col("id")))
    if scalable:
        order = ["_hash", "id"]
        cuts = ntile_cuts(keyed, "target", order, F.substr("_hash", F.lit(1), F.lit(3)), k)
        return apply_cuts(keyed, cuts, "target", order, "fold").drop("_hash")
    window = Window.partitionBy("target").orderBy("_hash", "id")
    return keyed.withColumn("fold", F.ntile(k).over(window) - 1).drop("_hash")


def stratified_folds_ordered(df: DataFrame, k: int = 5, order: str = "id") -> DataFrame:
    """Folds in the order of a unique row key of any type."""
    sliced = range_buckets(df.select("target", order), order)
    cuts = ntile_cuts(sliced, "target", [order], F.col("_range"), k)
    return apply_cuts(df, cuts, "target", [order], "fold")


def batch_assign(
    df: DataFrame,
    size: int = 32,
    shuffle: bool = True,
    drop_last: bool = True,
    seed: int = SEED,
    epoch: int = 0,
    order: str = "id",
    by: list[str] | None = None,
) -> DataFrame:
    """``batch_id`` and place in the batch, per ``by``; a short last batch may be dropped.

    Shuffled batches follow a seeded hash of the id. Ordered ones follow a key of any type. Rows
    are shuffled with all their columns: give it keys, and join what else rows have to the result.
    """
    by = by or []
    if shuffle:
        keyed = df.withColumn("_order", hash_key(f"{seed}|{epoch}", F.col("id")))
        bucket = F.conv(F.substr("_order", F.lit(1), F.lit(3)), 16, 10).cast("int")
        ranked = rank_within(keyed, by, ["_order", "id"], bucket, "_rank", "_all").drop("_order")
    else:
        sliced = range_buckets(df, order)
        ranked = rank_within(sliced, by, [order], F.col("_range"), "_rank", "_all").drop("_range")
    place = F.col("_rank") - 1
    batched = ranked.withColumns(
        {
            "batch_id": F.floor(place / size).cast("bigint"),
            "batch_pos": F.pmod(place, F.lit(size)).cast("int"),
        }
    )
    if drop_last:
        batched = batched.filter(F.col("_rank") <= F.floor(F.col("_all") / size) * size)
    return batched.drop("_rank", "_all")


def keep_folds(df: DataFrame, fold: int, split: str) -> DataFrame:
    """The train or valid rows of one fold."""
    own: Column = F.col("fold") == fold
    return df.filter(own if split == "valid" else ~own)
