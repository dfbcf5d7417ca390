"""Token distance, URL cue and sentence position features. No shuffle in any of them."""

from pyspark.sql import Column, DataFrame, functions as F

from antecede.functions import text as tx
from antecede.functions.numeric import (
    EDGES13,
    EDGES9,
    POSITION_EDGES,
    bucket_onehot,
    distance_bin,
)

MENTION_KEYS = ("p", "a", "b")


def token_offsets(df: DataFrame) -> DataFrame:
    """``p_tok``, ``a_tok`` and ``b_tok``, of which those that the rows have already are kept."""
    missing = [m for m in MENTION_KEYS if f"{m}_tok" not in df.columns]
    found = {f"{m}_tok": tx.char_to_token(F.col("text"), F.col(f"{m}_off")) for m in missing}
    return df.withColumns(found) if found else df


def mention_distance(df: DataFrame) -> DataFrame:
    """Signed token distances from each name to the pronoun."""
    return token_offsets(df).withColumns(
        {
            "dist_pa": F.col("p_tok") - F.col("a_tok"),
            "dist_pb": F.col("p_tok") - F.col("b_tok"),
        }
    )


def distance_bins(df: DataFrame, edges: list[int] = EDGES13) -> DataFrame:
    return mention_distance(df).withColumns(
        {
            "d_pa": distance_bin(F.col("dist_pa"), edges),
            "d_pb": distance_bin(F.col("dist_pb"), edges),
        }
    )


def _cue(name: Column, mode: str) -> Column:
    word = F.replace(F.regexp_extract(name, r"\S+", 0), F.lit("*"), F.lit(""))
    return F.substr(word, F.lit(1), F.lit(1)) if mode == "char" else word


def _in_url(name: str, mode: str) -> Column:
    cue = _cue(F.col(name), mode)
    return F.coalesce((cue != "") & F.contains(F.col("url"), cue), F.lit(False))


def url_contains(df: DataFrame, mode: str = "char") -> DataFrame:
    """Whether the first word of a name is in the URL; B counts only where A does not.

    ``mode="char"`` looks for the first character of the word, ``"word"`` for all of it.
    """
    a, b = _in_url("a", mode), _in_url("b", mode)
    return df.withColumns(
        {
            "a_in_url": F.when(a, 1).otherwise(0),
            "b_in_url": F.when(~a & b, 1).otherwise(0),
        }
    )


def url_contains3(df: DataFrame, mode: str = "char") -> DataFrame:
    """The same test as one code: 0 = A, 1 = B, 2 = none."""
    code = F.when(_in_url("a", mode), 0).when(_in_url("b", mode), 1).otherwise(2)
    return df.withColumn("in_url", code)


def distance_features(df: DataFrame, url_mode: str = "char") -> DataFrame:
    """``d_pa``, ``d_pb``, ``a_in_url`` and ``b_in_url`` on every row."""
    return url_contains(distance_bins(df), url_mode).drop(
        "p_tok", "a_tok", "b_tok", "dist_pa", "dist_pb"
    )


def sentence_position(df: DataFrame, **offsets: str) -> DataFrame:
    """Sentence, position in it, positions left and their ratio for offset columns.

    ``sentence_position(df, p="p_off")`` adds ``p_tok``, ``p_sent``, ``p_len``, ``p_pos``,
    ``p_inv`` and ``p_ratio``. Positions count from 1 in the first sentence and from 0 in
    later ones.
    """
    return _positions(df, offsets).drop("_sentences")


def _positions(df: DataFrame, offsets: dict[str, str]) -> DataFrame:
    text = F.col("text")
    out = df.withColumns(
        {
            "_sentences": tx.sentences(text),
            **{f"_prefix_{m}": tx.tokens(tx.before(text, F.col(off) + 1)) for m, off in offsets.items()},
        }
    )
    out = out.withColumns(
        {
            f"{m}_tok": tx.clamped_index(F.size(f"_prefix_{m}"), tx.more_tokens(text, F.col(off)))
            for m, off in offsets.items()
        }
    )
    out = out.withColumns(
        {
            f"_prefix_{m}": F.slice(f"_prefix_{m}", F.lit(1), F.greatest(F.col(f"{m}_tok"), F.lit(0)))
            for m in offsets
        }
    )
    out = out.withColumns(
        {
            name: value
            for m in offsets
            for name, value in (
                (f"{m}_sent", tx.count_sentences(F.col(f"_prefix_{m}"))),
                (f"_done_{m}", tx.completed_tokens(F.col(f"_prefix_{m}"))),
            )
        }
    )
    placed = {}
    for m in offsets:
        sent, tok = F.col(f"{m}_sent"), F.col(f"{m}_tok")
        size = F.regexp_count(F.get("_sentences", sent), F.lit(tx.TOKEN))
        placed[f"{m}_len"] = F.coalesce(size, F.lit(0))
        placed[f"{m}_pos"] = F.when(sent == 0, tok + 1).otherwise(tok - F.col(f"_done_{m}"))
    out = out.withColumns(placed)
    left = {}
    for m in offsets:
        pos, length = F.col(f"{m}_pos"), F.col(f"{m}_len")
        left[f"{m}_inv"] = length - pos
        left[f"{m}_ratio"] = pos / F.nullif(length, F.lit(0))
    return out.withColumns(left).drop(*[f"{c}_{m}" for m in offsets for c in ("_prefix", "_done")])


def positional_features(df: DataFrame, off1: str, *off2: str) -> DataFrame:
    """45 floats per pair of the first offset and each other one, in ``features_<name>``.

    They are one-hot distance, both positions and both inverse positions.
    """
    names = [off.removesuffix("_off") for off in off2]
    both = _positions(df, {"_m1": off1, **{f"_m2{n}": off for n, off in zip(names, off2)}})
    features = {}
    for n in names:
        parts = [
            bucket_onehot(F.col(f"_m2{n}_tok") - F.col("_m1_tok"), EDGES9),
            bucket_onehot(F.col("_m1_pos"), POSITION_EDGES),
            bucket_onehot(F.col(f"_m2{n}_pos"), POSITION_EDGES),
            bucket_onehot(F.col("_m1_inv"), POSITION_EDGES),
            bucket_onehot(F.col(f"_m2{n}_inv"), POSITION_EDGES),
        ]
        features[f"features_{n}"] = F.concat(*parts).cast("array<float>")
    return both.withColumns(features).select(*df.columns, *features)


def mention_sentence_window(df: DataFrame, max_len: int = 50) -> DataFrame:
    """The sentence of each mention, cut around the mention where it is too long."""
    out = _positions(df, {m: f"{m}_off" for m in MENTION_KEYS})
    out = out.withColumns(
        {
            f"_toks_{m}": tx.tokens(F.coalesce(F.get("_sentences", F.col(f"{m}_sent")), F.lit("")))
            for m in MENTION_KEYS
        }
    )
    columns = [F.col("id")]
    for m in MENTION_KEYS:
        pos, toks = F.col(f"{m}_pos"), F.col(f"_toks_{m}")
        front = (F.size(toks) <= max_len) | (pos < max_len - 1)
        cut = F.when(front, F.slice(toks, 1, max_len)).otherwise(
            F.slice(toks, F.greatest(pos - max_len + 3, F.lit(1)), max_len)
        )
        columns.append(F.array_join(cut, " ").alias(f"{m}_window"))
        columns.append(F.when(front, pos).otherwise(max_len - 2).alias(f"{m}_window_pos"))
    return out.select(*columns)


def nonspace_counts(df: DataFrame) -> DataFrame:
    """Non-space characters in front of each mention and in each name."""
    text = F.col("text")
    starts = {
        f"{m}_start": tx.nonspace_length(tx.before(text, F.col(f"{m}_off"))) for m in MENTION_KEYS
    }
    lengths = {
        "p_length": tx.nonspace_length(F.col("pronoun")),
        "a_length": tx.nonspace_length(F.col("a")),
        "b_length": tx.nonspace_length(F.col("b")),
    }
    return df.withColumns({**starts, **lengths})
