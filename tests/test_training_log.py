import random

import pytest
from pyspark.sql import functions as F

from antecede.operators import training_log as tl
from brute import stop_point


def make_log(spark, runs):
    rows = [(run, step, loss, 1 + (step * 7) % 5) for run, losses in runs.items() for step, loss in enumerate(losses, 1)]
    return spark.createDataFrame(rows, "run int, step int, loss double, n int")


@pytest.fixture(scope="module")
def runs():
    rng = random.Random(5)
    out = {0: [1.0, 0.99995, 0.99991], 1: [1.0, 0.99995, 0.99988], 2: [3.0]}
    out[3] = [1 / (i + 1) for i in range(400)]
    out[4] = [2.0] * 60
    for run in range(5, 40):
        level, losses = 1.0, []
        for _ in range(rng.randint(1, 150)):
            level *= rng.choice([0.9, 1.0, 1.1, 0.9999])
            losses.append(round(level, 6))
        out[run] = losses
    return out


def test_golden_stop_points(spark, runs):
    got = {r.run: r for r in tl.early_stop_point(make_log(spark, {k: runs[k] for k in (0, 1)}), patience=1).collect()}
    assert got[0].stop_step == 3 and got[0].best_step == 1
    assert got[1].stop_step is None and got[1].best_loss == 0.99988


@pytest.mark.parametrize("patience, chunk", [(1, 2), (3, 4), (8, 9), (8, 32), (2, 4096)])
def test_stop_points_match_a_walk(spark, runs, patience, chunk):
    log = make_log(spark, runs)
    got = {r.run: (r.stop_step, r.best_step, r.best_loss) for r in tl.early_stop_point(log, patience, 1e-4, chunk).collect()}
    assert got == {run: stop_point(losses, patience, 1e-4) for run, losses in runs.items()}


def test_a_long_run_has_no_long_row(spark, monkeypatch):
    """300,000 steps in 9,375 chunks: no row lists more than 64 of them."""
    seen = []
    compose = tl._composed

    def watched(tables):
        out = compose(tables)
        listed = tables.groupBy("run", F.floor(F.col("_chunk") / tl.FAN)).count().agg(F.max("count")).first()[0]
        seen.append((listed, out.count()))
        return out

    monkeypatch.setattr(tl, "_composed", watched)
    steps = spark.range(1, 300_001).select(F.lit(1).alias("run"), F.col("id").cast("int").alias("step"))
    falling = steps.withColumn("loss", F.when(F.col("step") <= 200_000, 400_000 - F.col("step")).otherwise(F.lit(1e6)).cast("double"))
    got = tl.early_stop_point(falling.withColumn("n", F.lit(1)), 8, 1e-4, 32).first()
    assert (got.stop_step, got.best_step, got.best_loss) == (200_009, 200_000, 200_000.0)
    assert [n for _, n in seen] == [147, 3, 1] and max(n for n, _ in seen) <= 64


@pytest.mark.parametrize("n, chunk", [(1, 1), (5, 2), (40, 64), (300, 4096)])
def test_rolling_loss_across_chunks(spark, runs, n, chunk):
    log = make_log(spark, runs)
    got = {(r.run, r.step): r.train_loss for r in tl.rolling_train_loss(log, n, chunk).collect()}
    assert len(got) == sum(map(len, runs.values()))
    for run, losses in runs.items():
        weights = [1 + (s * 7) % 5 for s in range(1, len(losses) + 1)]
        for step in range(1, len(losses) + 1):
            lo = max(0, step - n)
            pairs = list(zip(losses[lo:step], weights[lo:step]))
            want = sum(l * w for l, w in pairs) / sum(w for _, w in pairs)
            assert abs(got[run, step] - want) < 1e-9


def test_best_and_weighted(spark):
    log = make_log(spark, {1: [2.0, 1.0, 1.0], 2: [0.5]})
    assert {(r.run, r.step, r.loss) for r in tl.best_snapshot(log).collect()} == {(1, 2, 1.0), (2, 1, 0.5)}
    got = {r.run: r.loss for r in tl.weighted_eval_loss(log).collect()}
    assert abs(got[1] - (2 * 3 + 1 * 5 + 1 * 2) / 10) < 1e-12
    top = tl.top_snapshots(log, 2)
    assert {(r.run, r.step) for r in top.collect()} == {(1, 2), (1, 3), (2, 1)}
