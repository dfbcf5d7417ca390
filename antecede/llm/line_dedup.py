"""Repeated passages removed by overlapping windows of three lines."""

from pyspark.sql import Column, DataFrame, functions as F

from antecede.llm.columns import unused
from antecede.session import written

#: Lines of a window.
SPAN = 3
# A line counts if it has a character other than white space.
_WORD = r"[^\x20\x09-\x0D]"


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, though functions of elements refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _numbered(lines: Column) -> Column:
    """Number and hash of the lines that have a word."""
    every = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.rlike(_WORD).alias("full"), F.xxhash64(x).alias("h")))
    return F.filter(every, lambda s: s["full"])


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(key, first, last, a, b, again) of every run of ``span`` lines with a word.

    ``first`` and ``last`` are numbers of lines in the text, from 0; ``a`` and ``b`` are a
    128-bit hash; ``again`` tells that the document has the same run further up.
    """
    def window(lines: Column, at: Column) -> Column:
        parts = [F.get(lines, (at + k).cast("int")) for k in range(span)]
        hashes = [p["h"] for p in parts]
        return F.struct(
            parts[0]["i"].alias("first"),
            parts[-1]["i"].alias("last"),
            F.xxhash64(*hashes).alias("a"),
            F.xxhash64(F.lit(span), *reversed(hashes)).alias("b"),
        )

    def all_windows(lines: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(lines) - span, F.lit(0)))
        return F.when(F.size(lines) >= span, F.transform(starts, lambda at: window(lines, at)))

    lines = _numbered(F.split(F.col(f"`{text}`"), "\n"))
    rows = docs.select(F.col(f"`{key}`").alias("key"), _bound(lines, all_windows).alias("w")).filter("w is not null")
    # The first place of each hash in the document, from a map of distinct hashes.
    marks = F.transform("w", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b")))
    rows = rows.withColumn("repeats", F.size(F.array_distinct(marks)) < F.size("w"))
    marked = rows.select("key", "repeats", F.inline("w"))
    plain = marked.filter("not repeats").withColumn("again", F.lit(False))
    # Only documents that repeat a window need their windows ordered among themselves.
    within = marked.filter("repeats").groupBy("key", "a", "b").agg(F.min("first").alias("top"))
    repeated = marked.filter("repeats").join(within, ["key", "a", "b"]).withColumn("again", F.col("first") > F.col("top"))
    columns = ["key", "first", "last", "a", "b", "again"]
    return plain.select(columns).unionByName(repeated.select(columns))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(key, gone): the numbers of the lines that a later occurrence of some window covers.

    Occurrences are ordered by key and place; all but the first one of a window are later.
    Windows are grouped by hash with a partial minimum, so a window that stands in a third of
    all documents is one row per task, and the join back is split by Spark where it is skewed.
    """
    all_windows = written(windows(docs.filter(F.col(f"`{key}`").isNotNull()), key, text, span), "windows")
    seen = all_windows.groupBy("a", "b").agg(
        F.min("key").alias("owner"), F.max("key").alias("newest"), F.max("again").alias("twice")
    )
    seen = seen.filter("owner < newest or twice").select("a", "b", "owner")
    later = all_windows.join(seen, ["a", "b"]).filter("key > owner or again")
    lines = later.select("key", F.explode(F.sequence("first", "last")).alias("line"))
    return lines.groupBy("key").agg(F.collect_set("line").alias("gone"))


def drop_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """All columns, ``text`` without the lines that repeat, and ``n_removed`` lines.

    A window is ``span`` lines in a row, lines without a word left aside; covered positions of
    all later occurrences of repeated windows are merged and removed, along with blank lines
    between them. The earliest place of a line always stays, so no content is lost. Texts are
    split at ``\\n`` alone and compare as written. A text with fewer lines has no window and stays;
    a null text stays null; a text may become empty. Rows of one key count as one document;
    rows without a key stay as they are and take no part. A column ``n_removed`` (in any case)
    is replaced; others keep their names and values whatever they are called. A text of any
    length is one row. An empty table gives an empty table.
    """
    key_, gone_ = unused(docs, "_key", "_gone")
    gone = repeated_lines(docs, key, text, span).select(F.col("key").alias(key_), F.col("gone").alias(gone_))
    kept = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() != "n_removed"])
    joined = kept.join(gone, F.col(f"`{key}`") == F.col(key_), "left")
    lines = F.split(F.col(f"`{text}`"), "\n")

    def without(lines: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_))
        return F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")

    left = _bound(lines, without)
    joined = joined.withColumn(text, F.when(F.col(gone_).isNotNull(), left).otherwise(F.col(f"`{text}`")))
    removed = F.when(F.col(gone_).isNull(), F.lit(0).cast("long")).otherwise(F.size(gone_).cast("long"))
    return joined.withColumn("n_removed", removed).drop(key_, gone_)
