import os
import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F, types as T

from antecede.operators import features, folds, labels, metrics, scoring
from antecede.plans import catalog, fixtures as fx
from antecede.session import scratch_path, written
from antecede.sources import scans, sinks

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def split(spark):
    rows = []
    for i in range(240):
        target = i % 3
        x = [float(target == c) + ((i * 37 % 11) - 5) / 40 for c in range(3)]
        rows.append((i, target, i % 5, Vectors.dense(x)))
    df = spark.createDataFrame(rows, ["id", "target", "fold", "features"])
    return df.filter("id < 180").cache(), df.filter("id >= 180").cache()


def test_fit_save_load_predict(spark, split):
    train, test = split
    model = scoring.fit_scorer(train, fold=0)
    path = scoring.save_scorer(model, scratch_path(spark, "scorer"))
    ours = scoring.predict(model, test)
    again = scoring.predict(scoring.load_scorer(path), test)
    assert [r.logits for r in ours.orderBy("id").collect()] == [r.logits for r in again.orderBy("id").collect()]
    assert "target" in ours.columns
    loss = scoring.evaluate_single_fold(path, test).first()
    assert loss.n == 60 and loss.loss < 0.3


def test_names_that_change_places_change_probabilities(spark):
    """Fitted on rows in which A is right more often than B, the scorer still treats both names alike."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        target = rng.choices([0, 1, 2], [6, 2, 1])[0]
        a, b = [[(target == c) * 1.0 + rng.gauss(0, 0.4), rng.gauss(0, 1)] for c in (0, 1)]
        rows.append((i, target, i % 5, Vectors.dense(a + b), Vectors.dense(b + a)))
    df = spark.createDataFrame(rows, ["id", "target", "fold", "features", "swapped"])
    model = scoring.fit_scorer(df, fold=0, reg=0.001)
    turned = df.select("id", "target", "fold", F.col("swapped").alias("features"), F.col("features").alias("swapped"))
    ours = {r.id: r for r in scoring.with_probabilities(scoring.predict(model, df)).collect()}
    for r in scoring.with_probabilities(scoring.predict(model, turned)).collect():
        own = ours[r.id]
        assert (r.pr_a, r.pr_b) == pytest.approx((own.pr_b, own.pr_a), abs=1e-12)
        assert r.pr_neither == pytest.approx(own.pr_neither, abs=1e-12)
    scored = scoring.with_probabilities(scoring.predict(model, df))
    assert metrics.log_loss(scored, by=None).first().loss < 0.8
    oof, ensemble, losses, _ = scoring.cross_validate(df, df, 2, max_iter=10)
    assert ensemble.columns == ["id", *scoring.CLASSES] and "swapped" not in oof.columns and losses.count() == 4


def test_cross_validation(split):
    train, test = split
    oof, ensemble, losses, models = scoring.cross_validate(train, test, 5, max_iter=15)
    assert len(models) == 5
    assert oof.count() == oof.select("id").distinct().count() == 180
    assert ensemble.count() == 60
    rows = losses.collect()
    assert {(r.split, r.fold) for r in rows} == {("valid", f) for f in (0, 1, 2, 3, 4, None)} | {("test", None)}
    assert all(r.loss < 1.0 for r in rows)


@needs_data
def test_scorer_beats_the_prior(spark):
    train, test = catalog.train_and_test(spark, DATA)
    _, _, losses, _ = scoring.cross_validate(train, test, 5)
    fitted = losses.filter("split = 'test'").first().loss
    prior = labels.positional_prior(fx.rule_target(fx.mentions(spark, DATA)))
    baseline = metrics.log_loss(fx.splits(prior)[2], by=None).first().loss
    assert fitted < baseline


def test_log_loss(spark):
    rows = [(0, 0, 0.5, 0.25, 0.25), (0, 1, 1.0, 2.0, 1.0), (1, 2, 0.0, 1.0, 0.0), (1, None, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "fold int, target int, pr_a double, pr_b double, pr_neither double")
    got = {r.fold: (r.n, r.loss) for r in metrics.log_loss(df).collect()}
    assert abs(got[0][1] - 0.693147180560) < 1e-9
    assert got[1][0] == 1 and got[1][1] > 30 and got[None][0] == 3


def test_narrow_types(spark):
    schema = "a long, b int, c long, d double, e double, f string, g decimal(10,2), h short"
    df = spark.createDataFrame(
        [(1, 300, 2**40, 1.5, 1e6, "x", None, 127), (126, -300, 0, 2.0, 0.0, "y", None, 0)], schema
    )
    kinds = {f.name: f.dataType for f in metrics.narrow_types(df).schema}
    assert kinds["a"] == T.ByteType() and kinds["b"] == T.ShortType() and kinds["c"] == T.LongType()
    assert kinds["d"] == T.FloatType() and kinds["e"] == T.DoubleType()
    assert kinds["f"] == T.StringType() and kinds["g"] == T.DecimalType(10, 2)
    # 127 is not strictly inside the byte range.
    assert kinds["h"] == T.ShortType()
    assert metrics.narrow_types(df).filter("a = 126 and b = -300").count() == 1


def test_mention_file_round_trip(spark, one):
    odd = one.withColumn("text", F.concat("text", F.lit('\n"quoted"\ttab, \\ and #')))
    odd = odd.withColumn("id", F.lit("development-1"))
    for labeled in (True, False):
        rows = odd if labeled else odd.drop("a_coref", "b_coref")
        path = sinks.write_mentions(rows, scratch_path(spark, "mentions"))
        back = scans.scan_mentions(spark, path, labeled=labeled, multiline=True)
        assert back.select(rows.columns).collect() == rows.collect()


def test_mention_file_as_published(spark, tmp_path):
    file = tmp_path / "m.tsv"
    header = "ID\tText\tPronoun\tPronoun-offset\tA\tA-offset\tA-coref\tB\tB-offset\tB-coref\tURL\n"
    file.write_text(header + 'x-1\t"He said ""hi"", Bo"\tHe\t0\tBo\t17\tTRUE\tAl\t3\tFalse\thttp://u/T\n')
    row = scans.scan_mentions(spark, str(file)).first()
    assert row.text == 'He said "hi", Bo' and row.a_coref is True and row.b_coref is False and row.p_off == 0


def test_name_list(spark, tmp_path):
    file = tmp_path / "names.txt"
    file.write_text("# a comment\n# another\n\nAda\n Bo \n   \nCy\n")
    assert sorted(r.name for r in scans.scan_names(spark, str(file)).collect()) == ["Ada", "Bo", "Cy"]


def test_token_vector_file(spark, tmp_path):
    file = tmp_path / "v.jsonl"
    file.write_text(
        '{"row_key": "x-1", "linex_index": 4, "features": [{"token": "[CLS]", "layers": [{"index": -1, "values": [1.5, 2]}]},'
        ' {"token": "he", "layers": [{"index": -1, "values": [3, 4]}, {"index": -2, "values": [5, 6]}]}]}\n'
    )
    got = [tuple(r) for r in scans.scan_token_vectors(spark, str(file)).collect()]
    assert got == [("x-1", 4, 0, "[CLS]", [1.5, 2.0]), ("x-1", 4, 1, "he", [3.0, 4.0])]


def test_prediction_file_name(spark, tmp_path):
    df = spark.createDataFrame([("x", 0.1, 0.2, 0.7)], "id string, pr_a double, pr_b double, pr_neither double")
    path = sinks.write_predictions(df, str(tmp_path), "v2", [0.51234567, 0.4])
    assert path.endswith("v2_0.512346_0.400000")
    assert scans.scan_predictions(spark, path).collect()[0].pr_neither == 0.7
    text = "".join(f.read_text() for f in (tmp_path / os.path.basename(path)).glob("*.csv"))
    assert text.splitlines()[0] == "A,B,NEITHER,ID"


def test_fold_pruning(spark, split):
    path = sinks.write_folds(split[0].select("id", "target", "fold"), scratch_path(spark, "folds"))
    train = spark.read.parquet(path).filter("fold <> 2")
    assert "PartitionFilters: [isnotnull(fold" in plan_of(train)
    assert train.count() == split[0].filter("fold <> 2").count()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_fit_reads_the_rows_of_its_folds_once(spark, split, monkeypatch):
    rows = split[0].select("id", "target", "features", F.col("features").alias("swapped"), F.col("fold").cast("int"))
    table = written(rows, "train", by="fold")
    assert table.schema == rows.schema and sorted(table.collect()) == sorted(rows.collect())
    seen = []
    monkeypatch.setattr(scoring.Pipeline, "fit", lambda self, df: seen.append(df))
    scoring.fit_scorer(table, fold=1)
    assert plan_of(seen[0]).count("FileScan") == 1 and "PartitionFilters: [isnotnull(fold" in plan_of(seen[0])
    got = sorted((tuple(r.features), r.target) for r in seen[0].collect())
    kept = [r for r in rows.collect() if r.fold != 1]
    both = [(tuple(r.features), float(t)) for r in kept for t in (r.target, {0: 1, 1: 0, 2: 2}[r.target])]
    assert got == sorted(both)
    empty = written(rows.filter("id < 0"), "none", by="fold")
    assert empty.schema == rows.schema and empty.count() == 0


def test_folds_move_no_row(spark):
    """Rows stay in their partitions, however few targets there are and whatever Spark thinks of the size of the cuts."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    rows = spark.range(0, 600, 1, 12).withColumn("target", (F.col("id") % 2).cast("int"))
    try:
        spark.conf.set(key, "-1")
        dealt = folds.stratified_folds(rows, 5).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(key, before)
    assert {r.id: r.part for r in dealt} == {r.id: r.part for r in rows.withColumn("part", F.spark_partition_id()).collect()}
    assert len({r.part for r in dealt}) == 12 and len(dealt) == 600


def test_target_finds_each_token_offset_once(spark, one):
    rows = fx.rule_target(one)
    assert rows.columns == [*one.columns, "target"]
    # Twice by each of the three offsets: for a mention on the last token and for any other.
    assert plan_of(rows.select("target")).count("regexp_extract_all") <= 6
    known = one.withColumns({f"{m}_tok": F.lit(n) for m, n in (("p", 9), ("a", 2), ("b", 8))})
    assert features.token_offsets(known).select("p_tok", "a_tok", "b_tok").first() == (9, 2, 8)
    assert fx.rule_target(known).columns == [*known.columns, "target"]
    assert fx.rule_target(known).first().target == 1
