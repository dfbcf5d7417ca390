"""Mention-shaped views of the driver tables (see FIXTURES.md)."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from antecede.functions.numeric import EDGES9
from antecede.operators.features import token_offsets
from antecede.operators.labels import positional_prior
from antecede.operators.ranks import rank_within

# Word boundaries are spelled out over ASCII, as \b means different things per engine. The
# first look-ahead turns most places away early.
_OPEN, _CLOSE = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_PRONOUN = rf"(?=[HhSs]){_OPEN}(?:[Hh]e|[Ss]he|[Hh]im|[Hh]is|[Hh]er|[Hh]ers){_CLOSE}"
_NAME = rf"(?=[A-Z]){_OPEN}[A-Z][a-z]{{2,}}{_CLOSE}"
_NAME_REVERSED = rf"{_OPEN}[a-z]{{2,}}+[A-Z]{_CLOSE}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keep_found(df: DataFrame, found: Column, test) -> DataFrame:
    """Adds the fields of a struct, for the rows whose struct passes a test.

    A plain filter on a match would be pushed below other steps, each of which would then
    search the text once more.
    """
    return df.select("*", F.inline(F.filter(F.array(found), test)))


def _with_first(df: DataFrame, name: str, off: str, text: Column, pattern: str, shift=0) -> DataFrame:
    """First match in a text and its offset, from one search that splits the text in two."""
    halves = F.struct(F.split(text, pattern, 2).alias("_halves"))
    before, after = F.col("_halves")[0], F.col("_halves")[1]
    length = F.length(text) - F.length(before) - F.length(after)
    return (
        _keep_found(df, halves, lambda m: F.size(m["_halves"]) == 2)
        .withColumns({name: F.substr(text, F.length(before) + 1, length), off: F.length(before) + shift})
        .drop("_halves")
    )


def _with_last(df: DataFrame, name: str, off: str, text: Column, reversed_pattern: str) -> DataFrame:
    """Last match and its offset: the first one of the reversed text, so the search is short."""
    mirrored = _with_first(df, "_mirrored", "_behind", F.reverse(text), reversed_pattern)
    start = F.length(text) - F.col("_behind") - F.length("_mirrored")
    return mirrored.withColumns({name: F.reverse("_mirrored"), off: start}).drop("_mirrored", "_behind")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that English pronouns are looked for in."""
    docs = table(spark, sf_dir, "documents").filter(F.col("lang") == "en")
    return docs.select(F.col("doc_id").alias("id"), "text")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, after_pronoun = F.col("text"), F.col("p_off") + F.length("pronoun")
    found = _with_first(english(spark, sf_dir), "pronoun", "p_off", text, _PRONOUN)
    found = _with_last(found, "a", "a_off", F.substr(text, F.lit(1), F.col("p_off")), _NAME_REVERSED)
    shift = F.when(F.col("id") % 2 == 0, after_pronoun).otherwise(0)
    found = _with_first(found, "b", "b_off", F.substr(text, shift + 1), _NAME, shift)
    found = found.filter(F.col("a_off") != F.col("b_off"))
    digit = F.substr(F.md5(F.col("id").cast("string")), F.lit(1), F.lit(1))
    planted = F.when(digit < "5", 0).when(digit < "a", 1).otherwise(2)
    pages = table(spark, sf_dir, "pages")
    n_pages = pages.agg(F.count("page_id")).scalar()
    urls = pages.select(F.col("page_id").alias("page"), "url")
    return (
        found.withColumn("target_planted", planted)
        .withColumn("page", F.col("id") % n_pages)
        .join(urls, "page")
        .select(
            "id", "text", "pronoun", "p_off", "a", "a_off", "b", "b_off",
            (F.col("target_planted") == 0).alias("a_coref"),
            (F.col("target_planted") == 1).alias("b_coref"),
            "url", "target_planted",
        )
    )


def rule_target(df: DataFrame) -> DataFrame:
    """``target`` that the distances explain: the nearer name, or neither.

    Token offsets are a column each, so that a text is searched once for each of them.
    """
    near_a = F.abs(F.col("p_tok") - F.col("a_tok"))
    near_b = F.abs(F.col("p_tok") - F.col("b_tok"))
    far = F.lit(EDGES9[-1])
    target = (
        F.when((near_a > far) | (near_b > far) | (near_a == near_b), 2)
        .when(near_a < near_b, 0)
        .otherwise(1)
    )
    placed = token_offsets(df)
    return placed.withColumn("target", target).drop(*[c for c in placed.columns if c not in df.columns])


def splits(df: DataFrame) -> list[DataFrame]:
    """The three source files: two for training, one for testing. Every row is in one."""
    return [df.filter(F.col("id") % 3 == part) for part in range(3)]


def fold_predictions(df: DataFrame, k: int = 5) -> DataFrame:
    """One prediction per row and fold model: the prior, moved a little by fold."""
    shifted = F.col("model_fold") / F.lit(100.0)
    return (
        positional_prior(df)
        .withColumn("model_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .withColumn("pr_a", F.col("pr_a") + shifted)
    )


def loss_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One loss per step of a run, from the events of a user in time order."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        "ts",
        "event_id",
        F.col("value").cast("decimal(12,2)").alias("loss"),
        F.get_json_object("props", "$.k").cast("int").alias("n"),
    )
    ranked = rank_within(events, ["run"], ["ts", "event_id"], F.date_trunc("hour", "ts"), "step")
    return ranked.select("run", F.col("step").cast("int").alias("step"), "loss", "n")


def vector_ids(token: Column, n_vectors: Column) -> Column:
    """The row of ``embeddings`` that stands for a token."""
    return F.conv(F.substr(F.md5(token), F.lit(1), F.lit(6)), 16, 10).cast("bigint") % n_vectors


def vocab_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))


def n_vectors(spark: SparkSession, sf_dir: str) -> Column:
    return table(spark, sf_dir, "embeddings").agg(F.count("vec_id")).scalar()
