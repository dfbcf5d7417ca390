"""Session settings the library relies on, and the shared scratch folder."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("antecede")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Only where the session names none and is local (tests, a laptop) is a folder made: on a
    cluster each executor would write to a disk of its own.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="run-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for one intermediate table, unique per call."""
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


def bucketed(df: DataFrame, by: str, name: str, buckets: int | None = None, **options: str) -> DataFrame:
    """The same rows read from a written table that is bucketed by a column.

    Joins and groups by that column read it in place: only what is joined to it is shuffled. Hand over
    rows that are partitioned by the column already, so that a task writes few files. By default
    there are as many buckets as shuffle partitions. ``options`` are the writer's.
    """
    spark = df.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    options = {"path": scratch_path(spark, name), **options}
    df.write.options(**options).bucketBy(count, by).saveAsTable(table)
    return spark.table(table)


#: Characters of text that go to a bucket on average, so that a task's share does not grow with the input.
BUCKET_CHARS = 1 << 20


def text_buckets(df: DataFrame, text: str = "text") -> int:
    """How many buckets a table made from these texts takes: as many as shuffle partitions, or more for many texts."""
    spark = df.sparkSession
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The same rows read from a written table, for plans that use them more than once.

    Unlike a cache it outlives lost executors, and unlike a checkpoint it is columnar. With ``by``, the last
    column, its values have a folder each, so that a filter by it reads no other rows.
    """
    path = scratch_path(df.sparkSession, name)
    if by is None:
        df.write.parquet(path)
        return df.sparkSession.read.parquet(path)
    df.write.partitionBy(by).parquet(path)
    # Without rows there are no folders to tell the types from.
    return df.sparkSession.read.schema(df.schema).parquet(path)
