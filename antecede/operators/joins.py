"""Key joins, and a salted form for keys that hold a large share of the rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Pronoun -> gender, 1 male and 0 female.
PRONOUN_GENDER = {"his": 1, "him": 1, "he": 1, "her": 0, "she": 0, "hers": 0}


# A key with one row in so many is hot.
SHARES = 1024


def salted_join(
    left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left", salts: int = 32
) -> DataFrame:
    """Join a table on a key that is unique in ``right`` and may be very frequent in ``left``.

    Keys that hold at least one row in ``SHARES`` of ``left``, of which there cannot be more
    than ``SHARES``, are spread over ``salts`` tasks and their one row of ``right`` is repeated as
    often. Other keys are joined without a salt; the result is that of a plain join.
    """
    keys = [on] if isinstance(on, str) else list(on)
    counts = (
        left.dropna(subset=keys)
        .groupBy(*[F.col(k).alias(f"_hot_{k}") for k in keys])
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    total = left.agg(F.count(F.lit(1))).scalar()
    hot = counts.filter(F.col("_rows") * SHARES >= total).withColumn("_is_hot", F.lit(True)).drop("_rows")
    same = [F.col(k) == F.col(f"_hot_{k}") for k in keys]
    hot_columns = ["_is_hot", *[f"_hot_{k}" for k in keys]]
    others = [F.col(c).cast("string") for c in left.columns if not _nested(left, c)]
    spread = F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int")
    salted_left = (
        left.join(F.broadcast(hot), same, "left")
        .withColumn("_salt", F.when(F.col("_is_hot"), spread).otherwise(0))
        .drop(*hot_columns)
    )
    copies = F.when(F.col("_is_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    salted_right = (
        right.join(F.broadcast(hot), same, "left")
        .withColumn("_salt", F.explode(copies))
        .drop(*hot_columns)
    )
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def _nested(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("array", "map", "struct")


def join_sentence_columns(df: DataFrame, sent: DataFrame, on: str = "id") -> DataFrame:
    return df.join(sent, on, "left")


def pronoun_gender(df: DataFrame) -> DataFrame:
    """Gender of the pronoun; null, to be reported, where the pronoun is not a known one."""
    known = F.create_map(*[F.lit(x) for pair in PRONOUN_GENDER.items() for x in pair])
    return df.withColumn("gender", known[F.lower("pronoun")])


def name_gender_lookup(df: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Gender of both names of a row, where the lexicon has them.

    A name with two genders gets the lower one. Only ids and names are shuffled.
    """
    genders = lexicon.groupBy("name").agg(F.min("gender").alias("gender"))
    both = F.array(
        *[F.struct(F.lit(m.upper()).alias("slot"), F.lower(m).alias("name")) for m in ("a", "b")]
    )
    return salted_join(df.select("id", F.inline(both)), genders, "name").select(
        "id", "slot", "name", "gender"
    )


def attach_ids(pred: DataFrame, df: DataFrame, on: str = "row_key") -> DataFrame:
    """Ids onto predictions through a shared row key, never by row position."""
    return pred.join(df.select(on, "id"), on)


def fold_expand(df: DataFrame, k: int = 5) -> DataFrame:
    """Each row once per fold: valid in its own, train in the others."""
    runs = df.withColumn("run_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    split = F.when(F.col("fold") == F.col("run_fold"), "valid").otherwise("train")
    return runs.withColumn("split", split)


def union_splits(*dfs: DataFrame) -> DataFrame:
    """All rows of several sources, with the number of their source."""
    tagged = [df.withColumn("source", F.lit(i)) for i, df in enumerate(dfs)]
    return reduce(DataFrame.unionByName, tagged)


def sequence_key(ids: Column) -> Column:
    """Key of a token sequence, the same however far it is padded with zeros."""
    unpadded = F.filter(ids, lambda t: t > 0)
    return F.sha2(F.array_join(unpadded.cast("array<string>"), ","), 256)
