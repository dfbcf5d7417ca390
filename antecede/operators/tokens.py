"""Token and sentence tables, and the token sequence of a mention row."""

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from antecede.functions import text as tx
from antecede.functions.stopwords import STOPWORDS
from antecede.functions.text import between


def word_tokens(df: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """One row per token with its position and start offset.

    Both arrays come from the text in its own row, so nothing is shuffled.
    """
    pairs = F.arrays_zip(
        tx.tokens(F.col(text)).alias("token"), tx.token_starts(F.col(text)).alias("start")
    )
    return df.select(F.col(id), F.posexplode(pairs).alias("pos", "t")).select(
        id, "pos", "t.start", "t.token"
    )


def sentence_split(df: DataFrame) -> DataFrame:
    """One row per sentence with its token count."""
    rows = df.select("id", F.posexplode(tx.sentences(F.col("text"))).alias("sent", "sentence"))
    return rows.withColumn("n_tokens", F.regexp_count("sentence", F.lit(tx.TOKEN)))


def token_table(df: DataFrame, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """Tokens with shape, alphabetic and stop-word flags.

    Shapes keep at most four equal classes in a row, so a pattern looks at longer ones only. Stop words are
    in lower case. Starts are looked up by place: they cost nothing where they are not asked for.
    """
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    classes = F.translate("token", lower + upper + digits, "x" * 26 + "X" * 26 + "d" * 10)
    text = F.col("text")
    rows = df.select("id", tx.token_starts(text).alias("_starts"), tx.tokens(text).alias("_tokens"))
    # A plain explode would check that there are tokens by making them twice.
    rows = rows.select("id", "_starts", F.posexplode_outer("_tokens").alias("pos", "token")).filter(F.col("pos").isNotNull())
    rows = rows.select("id", "pos", F.get("_starts", F.col("pos")).alias("start"), "token", classes.alias("shape"))
    cut = F.regexp_replace("shape", r"([xXd])\1{4,}", "$1$1$1$1")
    letters = F.substr("shape", F.lit(1), F.lit(1)).isin("x", "X") & ~F.contains("shape", F.lit("d"))
    return rows.withColumn("shape", F.when(F.octet_length("shape") > 4, cut).otherwise(F.col("shape"))).withColumns(
        {"is_alpha": letters, "is_stop": F.lower("token").isin(list(stopwords))}
    )


def sentence_markers(df: DataFrame) -> DataFrame:
    """``[CLS] s1 [SEP] s2 [SEP]``; a single sentence is followed by one more space."""
    found = df.withColumn("_sentences", tx.sentences(F.col("text")))
    n = F.size("_sentences")
    marked = F.concat(F.lit("[CLS] "), F.array_join("_sentences", " [SEP] "), F.lit(" [SEP]"))
    value = F.when(n == 0, "").when(n == 1, F.concat(marked, F.lit(" "))).otherwise(marked)
    return found.withColumn("marked", value).drop("_sentences")


def _pieces(text: Column, markers: bool, tail: bool = False) -> Column:
    clean = tx.normalise_text(text)
    if not markers:
        return tx.tokens(clean)
    marked = clean
    for end in tx.TERMINATORS:
        marked = F.replace(marked, F.lit(end), F.lit(f"{end} [SEP] "))
    if tail:
        # The last sentence of the tail is closed even without a terminator.
        last = F.substr(F.rtrim(clean, F.lit(tx.WHITE_SPACE)), F.lit(-1))
        unended = ~last.isin("", *tx.TERMINATORS)
        marked = F.when(unended, F.concat(marked, F.lit(" [SEP]"))).otherwise(marked)
    return tx.marked_tokens(marked)


def mention_segments(
    df: DataFrame, order: str = "offset", markers: bool = False
) -> DataFrame:
    """Tokens of a row cut at its mentions, followed by its title, and inclusive spans.

    ``markers`` adds ``[SEP]`` after each ended sentence in front of a mention and after
    every sentence behind the last one. ``order="name"`` cuts in the order A, B, P, and
    ends at the last offset: it repeats or loses text and is kept for old token files only.
    """
    points = F.array(
        *[
            F.struct(F.col(off).alias("off"), F.lit(i).alias("which"), F.length(name).alias("len"))
            for i, (name, off) in enumerate((("a", "a_off"), ("b", "b_off"), ("pronoun", "p_off")))
        ]
    )
    text = F.col("text")
    cut = df.withColumn("_points", F.array_sort(points) if order == "offset" else points)
    offs = [F.col("_points")[i]["off"] for i in range(3)]
    ends = [F.col("_points")[i]["off"] + F.col("_points")[i]["len"] for i in range(3)]
    parts = {}
    for i in range(3):
        start = ends[i - 1] if i else F.lit(0)
        parts[f"_context{i}"] = _pieces(between(text, start, offs[i]), markers)
        parts[f"_mention{i}"] = _pieces(between(text, offs[i], ends[i]), False)
    tail_end = F.length(text) if order == "offset" else offs[2]
    parts["_tail"] = _pieces(between(text, ends[2], tail_end), markers, tail=True)
    title = tx.title_of(F.col("url")) if "title" not in df.columns else F.col("title")
    parts["_title"] = tx.tokens(F.lower(F.coalesce(title, F.lit(""))))
    cut = cut.withColumns(parts)

    starts, total = {}, F.lit(0)
    for i in range(3):
        total = total + F.size(f"_context{i}")
        starts[f"_start{i}"] = total
        total = total + F.size(f"_mention{i}")
        starts[f"_end{i}"] = total - 1
    starts["_url_start"] = total + F.size("_tail")
    starts["_url_end"] = starts["_url_start"] + F.size("_title") - 1
    cut = cut.withColumns(starts)

    def at(which: int, side: str) -> Column:
        hit = [F.col("_points")[i]["which"] == which for i in range(3)]
        return F.coalesce(*[F.when(hit[i], F.col(f"_{side}{i}")) for i in range(3)])

    spans = F.struct(
        at(0, "start").alias("a_start"),
        at(0, "end").alias("a_end"),
        at(1, "start").alias("b_start"),
        at(1, "end").alias("b_end"),
        at(2, "start").alias("p_start"),
        at(2, "end").alias("p_end"),
        F.col("_url_start").alias("url_start"),
        F.col("_url_end").alias("url_end"),
    )
    order_of_parts = [f"_{kind}{i}" for i in range(3) for kind in ("context", "mention")]
    all_tokens = F.concat(*[F.col(c) for c in (*order_of_parts, "_tail", "_title")])
    return cut.select(*df.columns, all_tokens.alias("tokens"), spans.alias("spans"))
