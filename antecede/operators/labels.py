"""Labels, titles, masks and the closed-form prior."""

from pyspark.sql import DataFrame, functions as F

from antecede.functions.text import title_of


def project_rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The columns of ``mapping``, under their new names."""
    return df.select(*[F.col(old).alias(new) for old, new in mapping.items()])


def extract_target(df: DataFrame) -> DataFrame:
    """0 = A, 1 = B, 2 = neither; B where both are marked; null where neither mark is known."""
    a, b = F.col("a_coref"), F.col("b_coref")
    known = a.isNotNull() | b.isNotNull()
    return df.withColumns(
        {
            "neither": F.when(a | b, 0).when(known, 1),
            "target": F.when(b, 1).when(a, 0).when(known, 2),
        }
    )


def coref_label(df: DataFrame) -> DataFrame:
    """The label as a word; null where neither mark is known."""
    a, b = F.col("a_coref"), F.col("b_coref")
    label = F.when(b, "B").when(a, "A").when(a.isNotNull() | b.isNotNull(), "Neither")
    return df.withColumn("label", label)


def extract_title(df: DataFrame) -> DataFrame:
    return df.withColumn("title", title_of(F.col("url")))


def mention_mask(df: DataFrame) -> DataFrame:
    """A string as long as the text with runs of P, A and B over the mentions."""
    mask = F.repeat(F.lit("*"), F.length("text"))
    for mention, off, letter in (("pronoun", "p_off", "P"), ("a", "a_off", "A"), ("b", "b_off", "B")):
        mask = F.overlay(mask, F.repeat(F.lit(letter), F.length(mention)), F.col(off) + 1)
    return df.withColumn("mask", mask)


def mention_section(df: DataFrame) -> DataFrame:
    """The part of text and mask from the first mention to the end of the last one."""
    ends = {
        "p_end": F.col("p_off") + F.length("pronoun"),
        "a_end": F.col("a_off") + F.length("a"),
        "b_end": F.col("b_off") + F.length("b"),
    }
    spans = mention_mask(df).withColumns(ends).withColumns(
        {
            "section_min": F.least("p_off", "a_off", "b_off"),
            "section_max": F.greatest("p_end", "a_end", "b_end"),
        }
    )
    start, length = F.col("section_min") + 1, F.col("section_max") - F.col("section_min")
    return spans.withColumns(
        {
            "section_text": F.substr("text", start, length),
            "section_mask": F.substr("mask", start, length),
        }
    )


# The probabilities of the prior, first mention or not, for A and for B.
def positional_prior(
    df: DataFrame,
    a: tuple[float, float] = (0.45, 0.4),
    b: tuple[float, float] = (0.3, 0.45),
) -> DataFrame:
    """Baseline probabilities from which mention comes first.

    Columns are case-insensitive in Spark and ``a``, ``b`` are the names, so probabilities
    are ``pr_a``, ``pr_b`` and ``pr_neither`` in every table.
    """
    first = F.least("p_off", "a_off", "b_off")
    return df.withColumns(
        {
            "pr_a": F.when(F.col("a_off") == first, a[0]).otherwise(a[1]),
            "pr_b": F.when(F.col("b_off") == first, b[0]).otherwise(b[1]),
        }
    ).withColumn("pr_neither", F.lit(1.0) - (F.col("pr_a") + F.col("pr_b")))
