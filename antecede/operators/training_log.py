"""Analytics over a loss log: one row (run, step, loss, n) per step, steps dense from 1.

A run may hold most of the log, so nothing here gathers or sorts a whole run in one task:
runs are cut into chunks of steps.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from antecede.session import written

CHUNK = 4096
#: Chunks of a run that are put together in one row.
FAN = 64


def weighted_eval_loss(log: DataFrame) -> DataFrame:
    """Batch losses averaged by batch size, per run."""
    total = F.sum(F.col("loss") * F.col("n")).cast("double")
    return log.groupBy("run").agg((total / F.nullif(F.sum("n"), F.lit(0)).cast("double")).alias("loss"))


def _with_halo(log: DataFrame, before: int, after: int, chunk: int) -> DataFrame:
    """Rows in their chunk, and again in the neighbours that look ``before`` or ``after``."""
    own = F.floor((F.col("step") - 1) / chunk).cast("bigint")
    first = F.floor((F.col("step") - 1 - after) / chunk).cast("bigint")
    last = F.floor((F.col("step") - 1 + before) / chunk).cast("bigint")
    return log.withColumn("_own", own).withColumn(
        "_chunk", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("bigint")), last))
    )


def rolling_train_loss(log: DataFrame, n: int = 300, chunk: int = CHUNK) -> DataFrame:
    """Average of the last ``n`` batch losses, weighted by batch size, at every step."""
    size = max(n, chunk)
    recent = Window.partitionBy("run", "_chunk").orderBy("step").rowsBetween(1 - n, 0)
    total = F.sum(F.col("loss") * F.col("n")).over(recent).cast("double")
    weight = F.sum("n").over(recent).cast("double")
    return (
        _with_halo(log, n - 1, 0, size)
        .withColumn("train_loss", total / F.nullif(weight, F.lit(0.0)))
        .filter(F.col("_chunk") == F.col("_own"))
        .select("run", "step", "train_loss")
    )


def best_snapshot(log: DataFrame) -> DataFrame:
    """The lowest loss of each run and its first step."""
    best = F.min(F.struct("loss", "step"))
    return log.groupBy("run").agg(best.alias("best")).select("run", "best.step", "best.loss")


def top_snapshots(log: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` lowest-loss steps of each run."""
    by_loss = Window.partitionBy("run").orderBy("loss", "step")
    ranked = log.select("run", "step", "loss", F.row_number().over(by_loss).alias("_place"))
    return ranked.filter(F.col("_place") <= k).drop("_place")


def early_stop_point(
    log: DataFrame, patience: int = 8, min_improv: float = 1e-4, chunk: int = CHUNK
) -> DataFrame:
    """Where training stops: the first step after more than ``patience`` misses in a row.

    A step is an improvement if the best loss so far is above its loss by more than
    ``min_improv``; otherwise it is a miss and the best stays. Gives ``stop_step``, null if
    the run never stops, and the step and loss of the best so far at that point.

    Improvements are at most ``patience + 1`` steps apart until the stop. So the improvement
    with which a run enters a chunk is one of the first ``patience + 1`` steps of the chunk, and each
    chunk is folded on its own once for each of them: a table from entry to exit. Such tables are
    composed, ``FAN`` neighbours at a time and in as many rounds as the longest run takes, so no row
    lists more than that and a run may be of any length.
    """
    reach = patience + 1
    size = max(chunk, reach)
    margin = F.lit(min_improv)
    rows = _with_halo(log.select("run", "step", F.col("loss").cast("double").alias("loss")), 0, reach, size)
    chunks = rows.groupBy("run", "_chunk").agg(
        F.array_sort(F.collect_list(F.struct("step", "loss"))).alias("_steps")
    )
    chunk_end = (F.col("_chunk") + 1) * size

    def follow(entry: Column) -> Column:
        """From an improvement in the chunk to the next chunk's first, or to the end."""
        start = F.struct(
            entry["loss"].alias("loss"),
            entry["step"].cast("bigint").alias("step"),
            F.lit(None).cast("bigint").alias("stop"),
            F.lit(None).cast("int").alias("next"),
        )

        def advance(state: Column, row: Column) -> Column:
            running = state["stop"].isNull() & state["next"].isNull() & (row["step"] > state["step"])
            better = running & (state["loss"] > row["loss"] + margin)
            leaves = better & (row["step"] > chunk_end)
            stays = better & (row["step"] <= chunk_end)
            stops = running & ~better & (row["step"] - state["step"] > patience)
            return F.struct(
                F.when(stays, row["loss"]).otherwise(state["loss"]).alias("loss"),
                F.when(stays, row["step"].cast("bigint")).otherwise(state["step"]).alias("step"),
                F.when(stops, row["step"].cast("bigint")).otherwise(state["stop"]).alias("stop"),
                F.when(leaves, (row["step"] - chunk_end - 1).cast("int"))
                .otherwise(state["next"])
                .alias("next"),
            )

        return F.aggregate("_steps", start, advance)

    entries = F.slice("_steps", 1, reach)
    tables = chunks.select("run", "_chunk", F.transform(entries, follow).alias("_paths"))
    tables = written(tables, "chunk-tables")
    last = tables.agg(F.max("_chunk")).first()[0] or 0
    while last > 0:
        tables, last = _composed(tables), last // FAN
    end = F.get("_paths", F.lit(0))
    return tables.withColumn("_last", end).select(
        "run",
        F.col("_last.stop").cast("int").alias("stop_step"),
        F.col("_last.step").cast("int").alias("best_step"),
        F.col("_last.loss").alias("best_loss"),
    )


def _composed(tables: DataFrame) -> DataFrame:
    """One table for each ``FAN`` neighbours: where an exit leads on, it is an entry of the next."""
    parts = F.array_sort(F.collect_list(F.struct("_chunk", "_paths")))
    listed = tables.groupBy("run", F.floor(F.col("_chunk") / FAN).cast("bigint").alias("_above")).agg(parts.alias("_parts"))

    def chain(state: Column, part: Column) -> Column:
        return F.when(state["next"].isNull(), state).otherwise(F.get(part["_paths"], state["next"]))

    rest = F.slice("_parts", 2, F.size("_parts"))
    paths = F.transform(F.get("_parts", F.lit(0))["_paths"], lambda p: F.aggregate(rest, p, chain))
    return listed.select("run", F.col("_above").alias("_chunk"), paths.alias("_paths"))
