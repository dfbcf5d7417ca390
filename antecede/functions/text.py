"""Column expressions over text. None of them explodes or shuffles.

A token is a run of ASCII letters and digits or one other non-space character. A sentence
ends with a token ``.``, ``!`` or ``?``. Offsets are 0-based code points.
"""

from pyspark.sql import Column, functions as F

# Where the first branch fails, \S is any other non-space character. Spelled out as a negated
# class it costs several times as much.
TOKEN = r"[A-Za-z0-9]++|\S"
MARKED_TOKEN = r"[A-Za-z0-9]++|\[SEP\]|\S"
TERMINATORS = (".", "!", "?")
_SENTENCE = r"[^.!?]*+[.!?]|[^.!?]++"
_TOKEN_START = r"[A-Za-z0-9]([A-Za-z0-9]*+)|\S"
WHITE_SPACE = " \t\n\x0b\f\r"
_MORE_AFTER_WORD = r"^[A-Za-z0-9]*+\s*+\S"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def marked_tokens(text: Column) -> Column:
    """Tokens of a text in which ``[SEP]`` stands for one token."""
    return F.regexp_extract_all(text, F.lit(MARKED_TOKEN), F.lit(0))


def is_terminator(token: Column) -> Column:
    return token.isin(*TERMINATORS)


def before(text: Column, off: Column) -> Column:
    """The ``off`` characters in front of an offset."""
    return F.substr(text, F.lit(1), F.greatest(off, F.lit(0)))


def between(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]``; empty where the end is not after the start."""
    return F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))


def token_starts(text: Column) -> Column:
    """Start offset of every token, in order.

    The text is rewritten to a string of the same length with a dot at each token start, so
    offsets come from one pass over characters instead of a running sum over token rows.
    """
    marked = F.regexp_replace(text, _TOKEN_START, ".$1")
    starts = F.transform(F.split(marked, ""), lambda c, i: F.when(c == ".", i))
    return F.filter(starts, lambda i: i.isNotNull())


def more_tokens(text: Column, off: Column) -> Column:
    """Whether a token starts behind the one at an offset."""
    rest = F.substr(text, off + 2)
    in_word = F.rlike(between(text, off, off + 1), F.lit(r"[A-Za-z0-9]"))
    return F.when(in_word, F.rlike(rest, F.lit(_MORE_AFTER_WORD))).otherwise(
        F.rlike(rest, F.lit(r"\S"))
    )


def clamped_index(started: Column, more: Column) -> Column:
    """Token index from the number of tokens that started and whether more follow.

    The search this stands for never tests the last token, so a mention on the last token
    gets the index before it, and a one-token text gives -1.
    """
    return F.greatest(F.when(more, started).otherwise(started - 1), F.lit(0)) - 1


def char_to_token(text: Column, off: Column) -> Column:
    """Index of the token at an offset, from a count of tokens in the prefix."""
    started = F.regexp_count(before(text, off + 1), F.lit(TOKEN))
    return clamped_index(started, more_tokens(text, off))


def sentences(text: Column) -> Column:
    """Sentence strings with at least one token, outer whitespace removed."""
    pieces = F.regexp_extract_all(text, F.lit(_SENTENCE), F.lit(0))
    trimmed = F.transform(pieces, lambda s: F.btrim(s, F.lit(WHITE_SPACE)))
    return F.filter(trimmed, lambda s: s != "")


def tokens_before(text: Column, off: Column) -> Column:
    """The tokens in front of the token that ``char_to_token`` reports for an offset."""
    index = F.greatest(char_to_token(text, off), F.lit(0))
    return F.slice(tokens(before(text, off + 1)), F.lit(1), index)


def count_sentences(preceding: Column) -> Column:
    """Sentences completed within a token array."""
    return F.size(F.filter(preceding, is_terminator))


def completed_tokens(preceding: Column) -> Column:
    """Tokens that belong to the completed sentences of a token array."""
    ends = F.transform(preceding, lambda t, i: F.when(is_terminator(t), i + 1))
    return F.coalesce(F.array_max(ends), F.lit(0))


def token_to_sentence(text: Column, off: Column) -> Column:
    """0-based sentence of the token at an offset."""
    return count_sentences(tokens_before(text, off))


def normalise_text(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("#"), F.lit("*"))


def title_of(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def nonspace_length(text: Column) -> Column:
    return F.length(F.replace(text, F.lit(" "), F.lit("")))


def piece_length(token: Column) -> Column:
    """Length of a token without piece markers and spaces; tokens that mark structure have none."""
    return F.when(token.isin("[CLS]", "[SEP]", "[PAD]"), 0).otherwise(F.length(F.replace(F.replace(token, F.lit("#"), F.lit("")), F.lit(" "), F.lit(""))))
