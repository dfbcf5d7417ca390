"""Checks that return the offending rows instead of stopping the job."""

from pyspark.sql import Column, DataFrame, functions as F

MENTIONS = (("P", "pronoun", "p_off"), ("A", "a", "a_off"), ("B", "b", "b_off"))


def check_mentions(df: DataFrame) -> DataFrame:
    """Mentions that the text does not have at their offset."""
    found = F.array(
        *[
            F.struct(
                F.lit(which).alias("mention"),
                F.col(name).alias("expected"),
                F.substr("text", F.col(off) + 1, F.length(name)).alias("found"),
            )
            for which, name, off in MENTIONS
        ]
    )
    wrong = F.filter(found, lambda m: ~m["expected"].eqNullSafe(m["found"]))
    return df.select("id", F.inline(wrong))


def check_single_token_pronoun(df: DataFrame, spans: str = "spans") -> DataFrame:
    """Rows whose pronoun span is not exactly one token."""
    start, end = F.col(spans)["p_start"], F.col(spans)["p_end"]
    return df.filter(start != end).select("id", start.alias("p_start"), end.alias("p_end"))


def check_template(df: DataFrame, template: DataFrame) -> DataFrame:
    """Ids that only one of the two tables has, from one join over both."""
    ids = df.select("id", F.lit(True).alias("_in_table"))
    wanted = template.select("id", F.lit(True).alias("_in_template"))
    missing = F.when(F.col("_in_table").isNull(), "table").when(
        F.col("_in_template").isNull(), "template"
    )
    both = ids.join(wanted, "id", "full").select("id", missing.alias("missing_from"))
    return both.filter(F.col("missing_from").isNotNull())


def marker_filter(df: DataFrame, col: str | Column, marker: str = "#") -> DataFrame:
    column = F.col(col) if isinstance(col, str) else col
    return df.filter(column.contains(marker))
