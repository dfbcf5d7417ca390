"""A persistent store of sequence vectors that batches of new ones are appended to.

A row per key holds all vectors of a sequence: the vectors themselves, or, from an encoder that has them packed,
references to a table of the batch's vectors, of which each is stored once. Files are laid out by batch and by the first
digits of the key, and bucketed by key. A lookup therefore reads the key column of the prefixes it
asks for, in place: what is looked up is shuffled to the buckets, and the store never is.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from antecede.operators.joins import salted_join, sequence_key
from antecede.session import scratch_path, written


# Vectors of one token are alike wherever it stands, so pages of thousands of vectors, which a value dictionary
# would only scatter, shrink by what repeats.
PACKED = "'compression' = 'zstd', 'parquet.enable.dictionary' = 'false', 'parquet.page.size' = '8388608'"


class VectorStore:
    """A folder of vectors by sequence key. Opening it anew, in any session, finds all batches."""

    def __init__(
        self, spark: SparkSession, path: str, vector: str = "array<float>", digits: int = 1, buckets: int = 16
    ):
        """``digits`` of the key make the partitions; these and ``buckets`` are fixed when a store is made."""
        self.spark, self.path = spark, path
        self.table = "store_" + "".join(c if c.isalnum() else "_" for c in path.split("/")[-1]).lower()
        shape = spark.createDataFrame([(digits, buckets, vector)], "digits int, buckets int, vector string")
        if not self._exists():
            shape.coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")
        found = spark.read.parquet(f"{path}/shape").first()
        self.digits, self.buckets = found.digits, found.buckets
        for part in ("rows", "referred"):
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        spark.sql(
            f"CREATE TABLE {self.table} (key STRING, vectors ARRAY<STRUCT<pos: INT, vector: {found.vector}>>, "
            f"pos ARRAY<INT>, ref ARRAY<BIGINT>, source STRING, batch STRING, prefix STRING) USING parquet OPTIONS ({PACKED}) "
            f"PARTITIONED BY (batch, prefix) "
            f"CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{path}/rows'"
        )
        spark.catalog.recoverPartitions(self.table)
        self.referred = f"{self.table}_referred"
        spark.sql(f"DROP TABLE IF EXISTS {self.referred}")
        spark.sql(
            f"CREATE TABLE {self.referred} (ref BIGINT, vector {found.vector}, source STRING) USING parquet "
            f"OPTIONS ({PACKED}) PARTITIONED BY (source) LOCATION '{path}/referred'"
        )
        spark.catalog.recoverPartitions(self.referred)

    def _exists(self) -> bool:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        done = jvm.org.apache.hadoop.fs.Path(f"{self.path}/shape/_SUCCESS")
        return done.getFileSystem(conf).exists(done)

    def prefix(self, key: Column) -> Column:
        return F.substr(key, F.lit(1), F.lit(self.digits))

    def rows(self) -> DataFrame:
        """(key, vectors, batch, prefix)."""
        held = self.spark.table(self.table)
        own = ["key", "batch", "prefix"]
        places = held.select(*own, "source", F.inline(F.arrays_zip("pos", "ref")))
        places = places.join(self.spark.table(self.referred), ["source", "ref"])
        packed = places.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("pos", "vector"))).alias("vectors"))
        return held.filter(F.col("ref").isNull()).select("key", "vectors", "batch", "prefix").unionByName(packed)

    def sizes(self) -> DataFrame:
        """(key, n_vectors): how many vectors of a sequence are stored. No vector is read."""
        number = F.when(F.col("ref").isNull(), F.size(F.col("vectors")["pos"])).otherwise(F.size("pos"))
        return self.spark.table(self.table).select("key", number.cast("long").alias("n_vectors"))

    def keys(self, prefixes: list[str], but: str | None = None) -> DataFrame:
        """The keys with these prefixes, without those of the batch ``but``."""
        held = self.spark.table(self.table)
        rows = held.filter(F.col("prefix").isin(*prefixes)) if prefixes else held.limit(0)
        return (rows if but is None else rows.filter(F.col("batch") != but)).select("key")

    def append(self, vectors: DataFrame, batch: str) -> None:
        """Adds (key, pos, vector) rows as a batch; a batch of that name is replaced.

        So an append that failed is simply repeated, and one that is repeated after it
        succeeded leaves the same rows.
        """
        dealt = vectors.repartition(self.buckets, "key")  # the only time that vectors move
        listed = dealt.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "vector"))).alias("vectors"))
        kinds = {"pos": "array<int>", "ref": "array<bigint>", "source": "string"}
        self._put(listed.select("key", "vectors", *[F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()]), batch)

    def append_packed(self, rows: DataFrame, vectors: DataFrame, batch: str) -> None:
        """As ``append``, of (key, pos, ref) rows, one for each key, and the vectors (ref, vector) they refer to.

        The vectors are stored first, under a name of their own, so that rows always find what they refer to:
        those of a batch that is replaced have theirs until the new rows are there.
        """
        source, held = uuid.uuid4().hex, self.spark.table(self.table)
        replaced = held.filter((F.col("batch") == batch) & F.col("source").isNotNull()).select("source").distinct().collect()
        vectors.select("ref", "vector").createOrReplaceTempView(f"new_{self.table}")
        self.spark.sql(f"INSERT INTO {self.referred} PARTITION (source = '{source}') SELECT ref, vector FROM new_{self.table}")
        own = [F.lit(None).cast(held.schema["vectors"].dataType).alias("vectors"), "pos", "ref", F.lit(source).alias("source")]
        self._put(rows.repartition(self.buckets, "key").select("key", *own), batch)
        for row in replaced:
            self.spark.sql(f"ALTER TABLE {self.referred} DROP IF EXISTS PARTITION (source = '{row.source}')")
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/referred/source={row.source}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _put(self, listed: DataFrame, batch: str) -> None:
        listed.withColumn("prefix", self.prefix(F.col("key"))).createOrReplaceTempView(f"new_{self.table}")
        self.spark.sql(
            f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch = '{batch}', prefix) "
            f"SELECT key, vectors, pos, ref, source, prefix FROM new_{self.table}"
        )
        self.spark.catalog.dropTempView(f"new_{self.table}")


def encode_missing(df: DataFrame, store: VectorStore, encoder, batch: str) -> tuple[DataFrame, int]:
    """Encode each distinct sequence the store lacks, once, and append it to the store as ``batch``.

    ``df`` has ``id`` and ``ids``; the encoder maps (key, ids) rows to (key, pos, vector) rows, or has ``packed``,
    which maps them to rows of references and the vectors referred to (``vectors.lookup_encoder``). Returns the
    rows with their key and whether the store had it before this batch, and how many sequences were
    encoded. Keys are looked up alone; only the ids of missing ones move, and these are made distinct before their
    shuffle, so copies of a text cost one row each
    task, and a frequent sequence is spread when its row meets the rows it stands for. What an
    earlier run of the same batch has stored does not count as known, so a repeated run encodes and
    stores the same again, whether or not the first one failed half-way.
    """
    keyed = df.withColumn("key", sequence_key(F.col("ids")))
    distinct = written(keyed.select("key").distinct(), "distinct")
    wanted = distinct.select(store.prefix(F.col("key")).alias("p")).distinct()  # 16 to the number of digits at most
    known = store.keys(sorted(r.p for r in wanted.collect()), but=batch).withColumn("_known", F.lit(True))
    looked = distinct.join(known, "key", "left").withColumn("hit", F.coalesce("_known", F.lit(False)))
    looked = written(looked.drop("_known"), "looked-up")
    lacking = looked.filter(~F.col("hit")).select("key")
    added = lacking.count()
    rows = keyed if added else keyed.limit(0)  # no ids are read to find none of them
    missing = rows.groupBy("key").agg(F.first("ids").alias("ids")).join(lacking, "key")  # a semi-join would go in front
    if hasattr(encoder, "packed"):
        store.append_packed(*encoder.packed(missing), batch)
    else:
        store.append(encoder(missing).select("key", "pos", "vector"), batch)
    return salted_join(keyed, looked.select("key", "hit"), "key"), added


def new_store(spark: SparkSession, name: str, **options) -> VectorStore:
    """An empty store in the shared scratch folder, whose own name may hold any character."""
    return VectorStore(spark, scratch_path(spark, name), **options)
