"""Fitting, applying and combining scorers."""

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from antecede.functions.numeric import EDGES13, softmax_clamp
from antecede.operators.folds import keep_folds
from antecede.operators.joins import salted_join
from antecede.operators.metrics import log_loss

CLASSES = ("pr_a", "pr_b", "pr_neither")
N_BINS = len(EDGES13) + 1
#: Fits of a cross-validation that run side by side. Each holds a copy of its rows in memory, so there are just
#: enough of them to fill the gaps between the short stages of one.
FITS = 3


def scorer_features(df: DataFrame) -> DataFrame:
    """``features``: pair vectors of both names, one-hot distance bins and URL cues.

    ``swapped`` has the same with the names in the other order, for a scorer that treats both alike.
    """

    def of(first: str, second: str) -> Column:
        names = (first, second)
        bins = [F.when(F.col(f"d_p{s}") == i, 1.0).otherwise(0.0) for s in names for i in range(N_BINS)]
        cues = [F.col(f"{s}_in_url").cast("double") for s in names]
        return array_to_vector(F.concat(*[f"pair_{s}" for s in names], F.array(*bins, *cues)))

    return df.withColumns({"features": of("a", "b"), "swapped": of("b", "a")})


def fit_scorer(
    df: DataFrame,
    fold: int | None = None,
    reg: float = 0.02,
    l1_share: float = 0.5,
    max_iter: int = 60,
) -> PipelineModel:
    """A three-way classifier over ``features`` and ``target``, fitted by Spark ML.

    With a fold, only the rows of the other folds are fitted. The penalty does the work of
    dropout: vectors are wide, and few of their values tell. Rows with ``swapped`` features are
    fitted in both orders, A's target being B's in the other one, so that the weights by which A
    and B are scored, each by its own values and by the other's, are the same ones.
    """
    rows = df if fold is None else keep_folds(df, fold, "train")
    scorer = LogisticRegression(
        featuresCol="features",
        labelCol="target",
        family="multinomial",
        regParam=reg,
        elasticNetParam=l1_share,
        maxIter=max_iter,
        rawPredictionCol="raw",
    )
    own = F.struct("features", F.col("target").cast("double").alias("target"))
    orders = [own]
    if "swapped" in rows.columns:
        other = F.when(F.col("target") < 2, 1 - F.col("target")).otherwise(F.col("target")).cast("double")
        orders.append(F.struct(F.col("swapped").alias("features"), other.alias("target")))
    # Both orders come from one read of the rows.
    labelled = rows.select(F.inline(F.array(*orders)))
    return Pipeline(stages=[scorer]).fit(labelled)


def save_scorer(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_scorer(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with ``logits``; whatever labels they have stay in the row.

    Rows with ``swapped`` features are scored in both orders and get the mean, so names that change
    places change logits, exactly.
    """
    out = model.transform(df).withColumn("logits", vector_to_array("raw")).select(*df.columns, "logits")
    if "swapped" not in df.columns:
        return out
    turned = out.withColumnsRenamed({"features": "_own", "swapped": "features", "logits": "_logits"})
    both = model.transform(turned).withColumn("_other", vector_to_array("raw"))
    mean = [(F.col("_logits")[i] + F.col("_other")[j]) / 2 for i, j in enumerate((1, 0, 2))]
    both = both.withColumnsRenamed({"features": "swapped", "_own": "features"})
    return both.withColumn("logits", F.array(*mean)).select(*df.columns, "logits")


def with_probabilities(df: DataFrame, lo: float = 1e-4, hi: float = 1 - 1e-4) -> DataFrame:
    """Clamped softmax of ``logits`` as three columns."""
    clamped = df.withColumn("_clamped", softmax_clamp(F.col("logits"), lo, hi))
    return clamped.withColumns(
        {name: F.col("_clamped")[i] for i, name in enumerate(CLASSES)}
    ).drop("_clamped", "logits")


def _score(model: PipelineModel, df: DataFrame, fold: int) -> DataFrame:
    scored = with_probabilities(predict(model, df))
    return scored.drop("features", "swapped").withColumn("model_fold", F.lit(fold))


def fold_mean_ensemble(pred: DataFrame) -> DataFrame:
    """Mean of the predictions of all fold models per row."""
    return pred.groupBy("id").agg(*[F.avg(c).alias(c) for c in CLASSES])


def topk_snapshot_ensemble(snapshots: DataFrame, pred: DataFrame, k: int = 8) -> DataFrame:
    """Mean prediction of the k lowest-loss snapshots of each run.

    Rows are kept per run and id. A run with fewer than k snapshots is an error.
    """
    by_loss = Window.partitionBy("run").orderBy("loss", "step")
    best = (
        snapshots.select("run", "step", F.row_number().over(by_loss).alias("place"))
        .filter(F.col("place") <= k)
        .select("run", "step")
    )
    means = (
        salted_join(pred, best, ["run", "step"], "inner")
        .groupBy("run", "id")
        .agg(F.count(F.lit(1)).alias("_used"), *[F.avg(c).alias(c) for c in CLASSES])
    )
    short = F.raise_error(F.concat(F.lit(f"fewer than {k} snapshots in run "), F.col("run").cast("string")))
    checked = [F.when(F.col("_used") >= k, F.col(c)).otherwise(short).alias(c) for c in CLASSES]
    return means.select("run", "id", *checked)


def oof_assemble(pred: DataFrame) -> DataFrame:
    """The prediction of each row by the model that did not see it."""
    return pred.filter(F.col("model_fold") == F.col("fold")).drop("model_fold")


def cross_validate(
    train: DataFrame, test: DataFrame, k: int = 5, max_iter: int = 60
) -> tuple[DataFrame, DataFrame, DataFrame, list[PipelineModel]]:
    """Fit per fold; out-of-fold rows, ensembled test rows, losses and the models.

    The training rows are read by every fit, so hand over a table written by fold. Each fit runs on the
    cluster, ``FITS`` at a time, so that one's last tasks do not idle it; the driver holds only the models. Test rows are read once: the models follow
    each other as columns, and their mean is taken in the row.
    """
    fit = inheritable_thread_target(train.sparkSession)(lambda fold: fit_scorer(train, fold, max_iter=max_iter))
    with ThreadPool(min(k, FITS)) as pool:
        models = pool.map(fit, range(k))
    oof = _union(
        [_score(m, keep_folds(train, f, "valid"), f) for f, m in enumerate(models)]
    )
    tested = test.select("id", "target", *[c for c in ("features", "swapped") if c in test.columns])
    for f, m in enumerate(models):
        scored = with_probabilities(predict(m, tested))
        tested = scored.withColumnsRenamed({c: f"_{c}_{f}" for c in CLASSES})
    means = [reduce(Column.__add__, [F.col(f"_{c}_{f}") for f in range(k)]) / k for c in CLASSES]
    ensemble = tested.select("id", "target", *[m.alias(c) for m, c in zip(means, CLASSES)])
    losses = (
        log_loss(oof)
        .select(F.lit("valid").alias("split"), "fold", "n", "loss")
        .unionByName(
            log_loss(ensemble, by=None).select(
                F.lit("test").alias("split"), F.lit(None).cast("int").alias("fold"), "n", "loss"
            )
        )
    )
    return oof, ensemble.drop("target"), losses, models


def evaluate_single_fold(path: str, test: DataFrame, fold: int = 0) -> DataFrame:
    """Loss on the test rows of one saved fold model alone."""
    scored = _score(load_scorer(path), test, fold)
    return log_loss(scored, by=None).select(F.lit(fold).alias("fold"), "n", "loss")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
