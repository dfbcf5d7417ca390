import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from antecede.operators import joins, vector_store as vs, vectors
from antecede.session import scratch_path


@pytest.fixture()
def rows(spark):
    """Three sequences, one of which holds most rows; padding does not tell them apart."""
    data = [(i, [101, 5, 6, 0, 0][: 3 + i % 3]) for i in range(40)] + [(100, [101, 7]), (101, [101])]
    return spark.createDataFrame(data, "id long, ids array<int>")


def encoder(seen):
    def encode(df):
        seen.append(df.count())
        return df.select("key", F.posexplode("ids").alias("pos", "t")).filter("t > 0").select(
            "key", "pos", F.array(F.col("t").cast("float")).alias("vector")
        )

    return encode


def held(store):
    return sorted((r.key, [(v.pos, v.vector) for v in r.vectors]) for r in store.rows().collect())


def test_a_second_run_encodes_nothing(spark, rows):
    store, seen = vs.new_store(spark, "store"), []
    hits, added = vs.encode_missing(rows.filter("id < 100"), store, encoder(seen), "one")
    assert added == 1 and not any(r.hit for r in hits.collect())
    hits, added = vs.encode_missing(rows, store, encoder(seen), "two")
    assert added == 2 and {(r.id, r.hit) for r in hits.collect()} == {(i, i < 100) for i in [*range(40), 100, 101]}
    before = held(store)
    hits, added = vs.encode_missing(rows, store, encoder(seen), "three")
    assert added == 0 and all(r.hit for r in hits.collect()) and seen == [1, 2, 0] and held(store) == before
    assert [v for _, v in before if len(v) == 3] == [[(0, [101.0]), (1, [5.0]), (2, [6.0])]]


def test_a_repeated_batch_leaves_the_same_rows(spark, rows):
    store, seen = vs.new_store(spark, "store"), []
    vs.encode_missing(rows.filter("id < 100"), store, encoder(seen), "one")

    def failing(df):
        return encoder(seen)(df).withColumn("pos", F.when(F.col("pos") == 1, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("pos")))

    before = held(store)
    with pytest.raises(Exception, match="lost"):
        vs.encode_missing(rows, store, failing, "two")
    assert held(store) == before
    for _ in range(2):
        hits, added = vs.encode_missing(rows, store, encoder(seen), "two")
        assert added == 2 and sum(r.hit for r in hits.collect()) == 40
        assert len(held(store)) == 3


def test_a_store_is_found_again(spark, rows):
    path = scratch_path(spark, "kept").replace("-", "_")
    vs.encode_missing(rows, vs.VectorStore(spark, path, digits=2, buckets=4), encoder([]), "one")
    again = vs.VectorStore(spark, path)
    assert (again.digits, again.buckets) == (2, 4) and again.rows().count() == 3
    assert vs.encode_missing(rows, again, encoder([]), "two")[1] == 0
    assert vs.encode_missing(rows.limit(0), again, encoder([]), "three")[1] == 0 and again.rows().count() == 3


def test_a_new_store_lies_in_the_scratch_folder(spark, rows, tmp_path, monkeypatch):
    """The name of the folder is the session's: changed by a character, it is another folder."""
    root = tmp_path / "exec-1_a"
    monkeypatch.setattr("antecede.session.scratch_root", lambda spark: str(root))
    store = vs.new_store(spark, "store-2")
    vs.encode_missing(rows, store, encoder([]), "one")
    assert os.path.dirname(store.path) == str(root) and store.rows().count() == 3
    assert os.listdir(tmp_path) == ["exec-1_a"]


def test_the_store_is_not_shuffled(spark, rows):
    """The key column of the prefixes asked for is read in its buckets; only what is looked up moves."""
    store = vs.new_store(spark, "store")
    vs.encode_missing(rows, store, encoder([]), "one")
    wanted = rows.select(joins.sequence_key(F.col("ids")).alias("key")).distinct()
    known = store.keys(["0", "a"], but="two").withColumn("_known", F.lit(True))
    looked = wanted.hint("merge").join(known, "key", "left")
    looked.collect()
    plan = looked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    scan = plan[plan.index("Scan parquet") :]
    assert "Bucketed: true" in scan and "PartitionFilters" in scan and "prefix" in scan and "ReadSchema: struct<key:string>" in scan
    joined = plan[plan.index("Join") :].splitlines()
    at = next(i for i, line in enumerate(joined) if "Scan parquet" in line)
    above = [line for line in joined[:at] if "Exchange" in line]
    assert all("Range" not in line for line in above) and sum("Exchange" in line for line in joined[at - 4 : at]) == 0


def test_vectors_that_repeat_are_stored_once_or_so(spark):
    """A token's vector stands wherever the token does: a store of long texts takes a fraction of the bytes of its vectors."""
    dims, rng = 64, np.random.default_rng(1)
    table = spark.createDataFrame([(i, rng.random(dims).tolist()) for i in range(1, 301)], "token_id int, vector array<float>")
    rows = spark.range(40).select("id", F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: (F.pmod(F.xxhash64("id", i), F.lit(300)) + 1).cast("int")).alias("ids"))
    store = vs.new_store(spark, "store", digits=0, buckets=2)
    vs.encode_missing(rows, store, vectors.lookup_encoder(table), "one")
    held = [os.path.join(at, f) for at, _, files in os.walk(f"{store.path}/rows") for f in files if f.endswith(".parquet")]
    assert sum(map(os.path.getsize, held)) < 40_000 * dims * 4 / 8
    assert store.rows().select(F.sum(F.size("vectors"))).first()[0] == 40_000


def size(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files if not f.endswith(".crc"))


def test_a_vector_is_stored_once_in_a_batch(spark):
    """Whatever the number of files that sequences are spread over, and with the same rows as from an encoder that is not packed."""
    dims, rng = 64, np.random.default_rng(2)
    table = spark.createDataFrame([(i, rng.random(dims).tolist()) for i in range(200)], "vec_id int, vector array<float>")
    names = spark.createDataFrame([(i, i * 7 % 200) for i in range(-5, 1001) if i % 50] + [(7, 3)], "token_id int, vec_id int")
    ids = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(1100)).cast("int"))
    rows = spark.range(500).select("id", F.when(F.col("id") < 498, ids).otherwise(F.array(F.lit(0), F.lit(None).cast("int"))).alias("ids"))
    encoder = vectors.lookup_encoder(table, names)
    packed, plain = vs.new_store(spark, "store"), vs.new_store(spark, "store")
    vs.encode_missing(rows.filter("id < 100"), packed, encoder, "one")
    assert vs.encode_missing(rows, packed, encoder, "two")[1] == 399
    vs.encode_missing(rows, plain, lambda df: encoder(df), "one")
    assert held(packed) == held(plain) and packed.rows().count() == 498
    assert sorted(map(tuple, packed.sizes().collect())) == sorted(map(tuple, plain.sizes().collect()))
    assert {(r.key, r.n_vectors) for r in packed.sizes().collect()} == {(k, len(v)) for k, v in held(packed)}
    assert spark.read.parquet(f"{packed.path}/referred").groupBy("source").count().filter("count <= 200").count() == 2
    assert size(packed.path) < size(plain.path) / 4
    read = lambda folder: spark.read.parquet(f"{folder}/rows").agg(F.count("vectors")).first()[0]
    assert (read(packed.path), read(plain.path)) == (0, 498)


def test_a_store_of_before_is_read(spark, rows):
    """Batches that were written before there were references stay as they are."""
    path = scratch_path(spark, "old").replace("-", "_")
    spark.createDataFrame([(1, 4, "array<float>")], "digits int, buckets int, vector string").write.parquet(f"{path}/shape")
    spark.sql(
        "CREATE TABLE old_store (key STRING, vectors ARRAY<STRUCT<pos: INT, vector: ARRAY<FLOAT>>>, batch STRING, prefix STRING) "
        f"USING parquet PARTITIONED BY (batch, prefix) CLUSTERED BY (key) SORTED BY (key) INTO 4 BUCKETS LOCATION '{path}/rows'"
    )
    keyed = rows.filter("id < 100").select(joins.sequence_key(F.col("ids")).alias("key")).distinct()
    old = keyed.selectExpr("key", "array(named_struct('pos', 0, 'vector', array(9f))) vectors", "'one' batch", "left(key, 1) prefix")
    old.write.insertInto("old_store")
    spark.sql("DROP TABLE old_store")
    table = spark.createDataFrame([(i, [float(i)]) for i in (5, 6, 7, 101)], "token_id int, vector array<float>")
    store = vs.VectorStore(spark, path)
    before = held(store)
    assert [v for _, v in before] == [[(0, [9.0])]]
    assert vs.encode_missing(rows, store, vectors.lookup_encoder(table), "two")[1] == 2
    assert before[0] in held(store) and sorted(len(v) for _, v in held(store)) == [1, 1, 2]
    assert sorted(r.n_vectors for r in store.sizes().collect()) == [1, 1, 2]


def test_a_run_that_lacks_nothing_writes_no_ids(spark, tmp_path, monkeypatch):
    """A second run over the same rows looks up keys: the ids of what is known are not written again."""
    monkeypatch.setattr("antecede.session.scratch_root", lambda spark: str(tmp_path))
    ids = F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda i: (F.pmod(F.xxhash64("id", i), F.lit(1 << 28)) + 1).cast("int"))
    rows = spark.range(100).select("id", ids.alias("ids"))
    store = vs.new_store(spark, "store")
    vs.encode_missing(rows, store, encoder([]), "one")
    before = size(tmp_path)
    hits, added = vs.encode_missing(rows, store, encoder([]), "two")
    assert added == 0 and hits.filter("hit").count() == 100
    assert size(tmp_path) - before < 100 * 2000 * 3 / 4


def test_a_repeated_packed_batch_that_fails_leaves_the_same_rows(spark, rows, monkeypatch):
    """Also where its vectors are stored already; what it replaces goes when it succeeds."""
    table = spark.createDataFrame([(i, [float(i)]) for i in (5, 6, 7, 101)], "token_id int, vector array<float>")
    store = vs.new_store(spark, "store")
    vs.encode_missing(rows, store, vectors.lookup_encoder(table), "one")
    before = held(store)
    other = vectors.lookup_encoder(table.repartition(3, "token_id"))  # its vectors have other numbers
    with monkeypatch.context() as patch:
        patch.setattr(vs.VectorStore, "_put", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            vs.encode_missing(rows, store, other, "one")
    assert held(store) == before and len(before) == 3
    vs.encode_missing(rows, store, other, "one")
    assert held(store) == before and held(vs.VectorStore(spark, store.path)) == before
    vs.encode_missing(rows, store, other, "two")
    assert held(store) == before
