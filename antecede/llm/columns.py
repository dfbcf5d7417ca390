"""Names for helper columns that no column of a table has."""

from pyspark.sql import DataFrame


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores behind it until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
