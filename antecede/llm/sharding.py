"""Consistent placement of rows in shards by a permutation-filled lookup table."""

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from antecede.llm.columns import unused

#: Shards of the registered query, and slots of its table: a prime of over 100 slots a shard,
#: so that shares differ by less than one per cent.
SHARDS, SLOTS = 128, 16381


def _preference(name: str, slots: int) -> tuple[int, int]:
    """Where a shard's walk over the slots begins and how far each step goes."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:15], 16) % slots, int(digest[15:30], 16) % (slots - 1) + 1


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number of every slot.

    Each shard walks all slots in an order of its own, as the step is prime to the number of
    slots. Shards take turns; in its turn a shard claims the next free slot of its walk. Hence
    shares differ by one slot at most, and without a shard few other slots change hands. The
    table depends on the names and the size alone, not on data: ``slots`` steps on the driver.
    Shard names must differ and ``slots`` must be a prime no smaller than their number.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be given and differ")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime, and at least one for each shard")
    walks = [_preference(name, slots) for name in shards]
    at = [begin for begin, _ in walks]
    table, free = [-1] * slots, slots
    while True:
        for shard, (_, step) in enumerate(walks):
            slot = at[shard]
            while table[slot] >= 0:
                slot = (slot + step) % slots
            table[slot] = shard
            at[shard] = (slot + step) % slots
            free -= 1
            if not free:
                return table


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The filled table as rows (slot, shard number, shard name)."""
    numbers = ",".join(map(str, fill_table(shards, slots)))
    names = F.array(*[F.lit(name) for name in shards])
    return (
        spark.range(1)
        .select(F.posexplode(F.split(F.lit(numbers), ",")).alias("slot", "shard"))
        .select("slot", F.col("shard").cast("int").alias("shard"))
        .withColumn("shard_name", F.element_at(names, F.col("shard") + 1))
    )


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of the md5 of its text, modulo the table size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """All columns and ``slot``, ``shard``, ``shard_name`` of every row.

    The table has ``slots`` rows whatever the data, so it is broadcast: one probe per row, no
    shuffle, and no dependence on hot keys. A null key is placed as the empty text; equal keys
    go to the same shard, repeated rows each. Columns of these three names (in any case) are
    replaced, unless the key is one of them: then an error tells so. Texts are not looked at, so
    their length plays no part. An empty table gives an empty table.
    """
    added = ("slot", "shard", "shard_name")
    if key.lower() in added:
        raise ValueError(f"the key can't be called like a column that is added: {key}")
    kept = df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in added])
    table = lookup(df.sparkSession, shards, slots)
    own, filled = unused(kept, "_slot", "_table_slot")
    placed = kept.withColumn(own, slot_of(F.col(f"`{key}`"), slots))
    table = F.broadcast(table.withColumnRenamed("slot", filled))
    out = placed.join(table, F.col(own) == F.col(filled), "left")
    return out.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(own).alias("slot"), "shard", "shard_name")


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, slots: int = SLOTS, files: int = 8) -> None:
    """Rows written by shard, each shard in up to ``files`` files.

    The shuffle is by shard and part of the key hash, so that no task holds a whole shard.
    """
    placed = place(df, key, shards, slots)
    part = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string"), F.lit("file")), F.lit(files))
    placed.repartition(len(shards) * files, "shard", part).write.partitionBy("shard").parquet(path)
