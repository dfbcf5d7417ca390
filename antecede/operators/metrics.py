"""Cross-entropy, label counts and column ranges."""

from pyspark.sql import DataFrame, functions as F, types as T

# Smallest probability a logarithm is taken of.
EPSILON = 2.220446049250313e-16
# Largest finite half-precision float.
HALF_MAX = 65504.0
INTEGER_TYPES = (
    ("tinyint", 2**7),
    ("smallint", 2**15),
    ("int", 2**31),
    ("bigint", 2**63),
)


def target_counts(df: DataFrame) -> DataFrame:
    """Rows per target, most frequent first."""
    return df.groupBy("target").count().orderBy(F.desc("count"), "target")


def log_loss(df: DataFrame, by: str | None = "fold") -> DataFrame:
    """Mean cross-entropy per group and, in the row without a group, over all labelled rows.

    Probabilities are normalised first. Addends are decimals, so that the sum does not
    depend on how rows are partitioned.
    """
    classes = F.array("pr_a", "pr_b", "pr_neither")
    total = F.col("pr_a") + F.col("pr_b") + F.col("pr_neither")
    share = F.greatest(F.get(classes, F.col("target")) / F.nullif(total, F.lit(0.0)), F.lit(EPSILON))
    loss = F.when(F.col("target").isNotNull(), -F.log(share))
    scored = df.withColumn("_loss", loss.cast("decimal(28,12)"))
    measures = [
        F.count("_loss").alias("n"),
        (F.sum("_loss").cast("double") / F.nullif(F.count("_loss"), F.lit(0))).alias("loss"),
    ]
    return scored.rollup(by).agg(*measures) if by else scored.agg(*measures)


def column_ranges(df: DataFrame) -> DataFrame:
    """Smallest and largest value of every numeric column, in one pass: one row per column."""
    numeric = [f for f in df.schema.fields if isinstance(f.dataType, (T.IntegralType, T.FractionalType))]
    measures = [g(F.col(f.name)).alias(f"{f.name}_{s}") for f in numeric for g, s in ((F.min, "min"), (F.max, "max"))]
    rows = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("from_type"),
                F.col(f"{f.name}_min").cast("double").alias("min_value"),
                F.col(f"{f.name}_max").cast("double").alias("max_value"),
                _narrowest(f).alias("to_type"),
            )
            for f in numeric
        ]
    )
    return df.agg(*measures).select(F.inline(rows))


def _narrowest(field: T.StructField):
    """The smallest type whose range strictly encloses a column."""
    low, high = F.col(f"{field.name}_min"), F.col(f"{field.name}_max")
    if isinstance(field.dataType, T.IntegralType):
        choice = F.lit(field.dataType.simpleString())
        for name, limit in reversed(INTEGER_TYPES[:-1]):
            choice = F.when((low > -limit) & (high < limit - 1), name).otherwise(choice)
        return choice
    if isinstance(field.dataType, T.DecimalType):
        return F.lit(field.dataType.simpleString())
    return F.when((low > -HALF_MAX) & (high < HALF_MAX), "float").otherwise("double")


def narrow_types(df: DataFrame) -> DataFrame:
    """Numeric columns cast to the smallest type that holds them.

    The types are needed to plan the cast, so one row per column comes to the driver.
    """
    chosen = {r["column"]: r["to_type"] for r in column_ranges(df).collect()}
    return df.select(*[F.col(c).cast(chosen[c]).alias(c) if chosen.get(c) else F.col(c) for c in df.columns])
