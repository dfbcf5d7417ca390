import random

import pytest
from pyspark.sql import Window, functions as F

from antecede.operators import folds, joins, ranks, sequences, vector_store
from antecede.operators.ranks import rank_within, range_buckets


@pytest.fixture(scope="module")
def skewed(spark):
    """One target holds most rows; another fewer rows than there are folds."""
    target = F.when(F.col("id") < 3, 2).when(F.col("id") % 10 == 0, 1).otherwise(0)
    return spark.range(3000).withColumn("target", target)


def test_cuts_equal_ntile(skewed):
    scalable = folds.stratified_folds(skewed, 5)
    plain = folds.stratified_folds(skewed, 5, scalable=False)
    assert scalable.exceptAll(plain).count() == 0 and scalable.count() == 3000


def test_ordered_cuts_equal_ntile(skewed):
    got = folds.stratified_folds_ordered(skewed, 7)
    window = Window.partitionBy("target").orderBy("id")
    want = skewed.withColumn("fold", F.ntile(7).over(window) - 1)
    assert got.exceptAll(want).count() == 0 and got.count() == 3000


def test_folds_are_balanced(skewed):
    sizes = folds.stratified_folds(skewed, 5).groupBy("target", "fold").count().collect()
    for target in range(3):
        counts = [r["count"] for r in sizes if r["target"] == target]
        assert max(counts) - min(counts) <= 1


def test_fold_seeds_differ(skewed):
    other = folds.stratified_folds(skewed, 5, seed=7)
    assert other.exceptAll(folds.stratified_folds(skewed, 5)).count() > 0


def test_fold_assignment_shuffles_no_text(skewed):
    texts = skewed.withColumn("text", F.repeat(F.lit("x"), 50))
    plan = folds.stratified_folds(texts, 5)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and not any("text" in line for line in windows)


def test_two_level_rank(spark):
    df = spark.range(2000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("g"),
        (F.col("id") * 7919 % 2003).alias("v"),
    )
    got = rank_within(df, ["g"], ["v"], F.floor(F.col("v") / 100), "r")
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("v")).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and got.count() == 2000


@pytest.mark.parametrize("rows_a_slice, slices", [(100, 50), (1 << 16, 16)])
def test_range_buckets_grow_with_the_key(spark, monkeypatch, rows_a_slice, slices):
    """The number of slices follows from that of rows; null keys are in the first."""
    monkeypatch.setattr(ranks, "SLICE_ROWS", rows_a_slice)
    for kind in ("bigint", "string"):
        df = spark.range(5000).select((F.col("id") * F.col("id")).cast(kind).alias("v"))
        nulls = spark.createDataFrame([(None,)], f"v {kind}")
        slots = [r["_range"] for r in range_buckets(df.unionByName(nulls), "v").orderBy("v").collect()]
        assert slots == sorted(slots) and slots[0] == 0 and 0.7 * slices < len(set(slots)) < 1.4 * slices
        assert max(slots.count(s) for s in set(slots)) < 3 * 5000 / slices


def test_range_buckets_take_one_pass(spark):
    """Edges come from one aggregate whose tasks keep a key for each slot at most; no rows are sorted."""
    plan = range_buckets(spark.range(1000), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" in plan and "Distinct" not in plan and "Sort [" not in plan


@pytest.mark.parametrize("order", ["v", "name"])
def test_rank_of_a_whole_table(spark, monkeypatch, order):
    monkeypatch.setattr(ranks, "SLICE_ROWS", 64)
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("v"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    got = rank_within(range_buckets(df, order), [], [order], F.col("_range"), "r", "all").drop("_range")
    want = df.withColumn("r", F.row_number().over(Window.orderBy(order)).cast("bigint")).withColumn("all", F.lit(3000).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and got.count() == 3000
    assert rank_within(range_buckets(df.limit(0), order), [], [order], F.col("_range"), "r", "all").count() == 0


def test_vocabulary_has_no_task_with_all_words(spark):
    """Words seen once with one beginning are spread; only sums of at most ``SLOTS`` slices meet in one task."""
    words = spark.range(4000).select(F.concat(F.lit("zz"), F.col("id")).alias("token"))
    vocab = sequences.build_vocab(words)
    node = vocab._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in node.splitlines() if "Window " in line or "Window [" in line]
    assert windows and all("_range" in line or "_bucket" in line for line in windows)
    ids = {r.token: r.token_id for r in vocab.collect()}
    ordered = sorted((t for t in ids if t.startswith("zz")))
    assert [ids[t] for t in ordered] == list(range(ids[ordered[0]], ids[ordered[0]] + 4000))


def test_string_ids_in_order(spark):
    df = spark.range(500).select(F.concat(F.lit("development-"), F.col("id")).alias("id"), (F.col("id") % 3).alias("target"))
    folds_of = folds.stratified_folds_ordered(df, 4)
    want = df.withColumn("fold", F.ntile(4).over(Window.partitionBy("target").orderBy("id")) - 1)
    assert folds_of.exceptAll(want.select(folds_of.columns)).count() == 0 and folds_of.count() == 500
    batches = folds.batch_assign(df, 32, shuffle=False, drop_last=False).collect()
    names = sorted(r.id for r in batches)
    assert all((r.batch_id, r.batch_pos) == divmod(names.index(r.id), 32) for r in batches)


def test_dropping_the_last_batch_adds_no_shuffle(spark):
    """Counted in the plan that ran, where the sums of slices are one subquery that is used again."""

    def exchanges(drop):
        batches = folds.batch_assign(spark.range(101), 32, drop_last=drop)
        batches.collect()
        ran = batches._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        return ran.count("ShuffleQueryStage")

    assert exchanges(True) == exchanges(False)


def test_batches(spark):
    df = spark.range(101)
    ordered = folds.batch_assign(df, 32, shuffle=False, drop_last=False).orderBy("id").collect()
    assert [(r.batch_id, r.batch_pos) for r in ordered] == [(i // 32, i % 32) for i in range(101)]
    kept = folds.batch_assign(df, 32)
    assert kept.count() == 96 and {r["count"] for r in kept.groupBy("batch_id").count().collect()} == {32}
    next_epoch = folds.batch_assign(df, 32, epoch=1)
    assert kept.exceptAll(next_epoch).count() > 0


def test_fold_expand(skewed):
    runs = joins.fold_expand(folds.stratified_folds(skewed, 5), 5)
    counts = runs.groupBy("id").agg(
        F.count("*").alias("n"), F.sum((F.col("split") == "valid").cast("int")).alias("v")
    )
    assert counts.filter("n <> 5 or v <> 1").count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("shares", [1, 4, 10**6])
def test_salted_join_is_a_join(spark, how, shares, monkeypatch):
    monkeypatch.setattr(joins, "SHARES", shares)
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 8 + ["x", "y", None]), [i]) for i in range(500)]
    left = spark.createDataFrame(rows, "id long, k string, extra array<int>")
    right = spark.createDataFrame([("hot", 1), ("x", 2), ("z", 3)], "k string, v int")
    got = joins.salted_join(left, right, "k", how, salts=4)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, left.join(right, "k", how).collect()))


def test_hot_keys_are_spread(spark):
    left = spark.range(2000).withColumn("k", F.lit("hot"))
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    got = joins.salted_join(left, right.hint("merge"), "k", "inner", salts=8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan and got.count() == 2000


def test_encode_missing_encodes_each_sequence_once(spark):
    rows = [(i, [101, 5 + i % 4, 0, 0][: 2 + i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, ids array<int>")
    seen = []

    def encoder(missing):
        seen.append(missing.count())
        unpadded = missing.select("key", F.posexplode("ids").alias("pos", "t")).filter("t > 0")
        return unpadded.select("key", "pos", F.array(F.col("t").cast("float")).alias("vector"))

    store = vector_store.new_store(spark, "store")
    vector_store.encode_missing(df.filter("id = 0"), store, encoder, "first")
    hits, added = vector_store.encode_missing(df, store, encoder, "rest")
    # Padding does not change a key: four sequences, of which the store has one.
    assert seen == [1, 3] and added == 3
    assert hits.filter("hit").count() == 10 and hits.count() == 40
    assert store.rows().filter("batch = 'rest'").select("key").distinct().count() == 3


def test_union_keeps_sources(spark):
    out = joins.union_splits(spark.range(3), spark.range(2))
    assert sorted((r.source, r.id) for r in out.collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
