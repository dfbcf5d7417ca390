"""Tokens of whole documents, counted by the sections or fields they stand in."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from antecede.llm.bpe import encode_text, encoder

#: What becomes of a token that reaches over the edge of a section.
RULES = ("first", "last", "split")
_SECTIONS = "array<struct<name:string,start:int,end:int>>"


def join_fields(fields: dict[str, Column], separator: str = "\n") -> tuple[Column, Column]:
    """Several text columns as one document, and the sections they make of it.

    Null fields count as empty. Positions are in characters; a section does not hold the
    separator after it.
    """
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in fields.values()]
    sections, begin = [], F.lit(0)
    for name, text in zip(fields, texts):
        end = begin + F.char_length(text)
        sections.append(F.struct(F.lit(name).alias("name"), begin.alias("start"), end.alias("end")))
        begin = end + len(separator)
    return F.concat_ws(separator, *texts), F.array(*sections)


def _line_spans(data: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with the line break that ends them, in characters."""
    edges = np.concatenate([[0], np.flatnonzero(data == 10) + 1, [len(data)]])
    return chars[edges[:-1]], chars[edges[1:]]


def _overlap(starts: np.ndarray, ends: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every edge: whether a token reaches over it, and the share of that token before it."""
    at = np.searchsorted(starts, edge, side="left") - 1
    safe = np.maximum(at, 0)
    if not len(starts):
        return np.zeros(len(edge), bool), np.zeros(len(edge))
    over = (at >= 0) & (ends[safe] > edge)
    return over, np.where(over, (edge - starts[safe]) / np.maximum(ends[safe] - starts[safe], 1), 0)


def count_in(starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens allotted to each section by the rule, and how many of its tokens cross an edge.

    Token spans are in order of the text; neither their starts nor their ends go back.
    """
    empty = end <= begin
    begins_in = np.searchsorted(starts, end) - np.searchsorted(starts, begin)
    ends_in = np.searchsorted(ends, end, side="right") - np.searchsorted(ends, begin, side="right")
    touching = np.searchsorted(starts, end) - np.searchsorted(ends, begin, side="right")
    inside = np.maximum(np.searchsorted(ends, end, side="right") - np.searchsorted(starts, begin), 0)
    crossing = np.where(empty, 0, touching - inside)
    if rule == "first":
        counts = begins_in.astype(float)
    elif rule == "last":
        counts = ends_in.astype(float)
    else:
        _, before_begin = _overlap(starts, ends, begin)
        over_end, before_end = _overlap(starts, ends, end)
        # Tokens that begin before an edge, less the part of the last one beyond it.
        upto = lambda edge, over, part: np.searchsorted(starts, edge) - over * (1 - part)
        over_begin, _ = _overlap(starts, ends, begin)
        counts = upto(end, over_end, before_end) - upto(begin, over_begin, before_begin)
    return np.where(empty, 0, counts), crossing


def token_counts(
    docs: DataFrame,
    ranks: bytes,
    pattern: str,
    sections: Column | None = None,
    rule: str = "first",
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, section, name, start, end, n_tokens, n_crossing, doc_tokens), a row per section.

    Every text is encoded once, as a whole, and each token keeps the span of characters it
    stands for; one that holds part of a character spans that character. Spans are joined with
    the sections of the row, an array of (name, start, end) in characters, or with the lines
    (each with its line break) where none are given. A token that crosses an edge goes by ``rule``:
    to the section of its ``first`` or ``last`` character, or ``split`` by characters.
    ``n_crossing`` counts the tokens that are partly in a section; ``section`` is its number from
    0, ``n_tokens`` a double, ``doc_tokens`` the tokens of the text.

    With disjoint sections that cover a text, ``n_tokens`` adds up to ``doc_tokens``. Sections
    may overlap, and each then counts for itself; one that is empty, null or beyond the text
    has no tokens. A null text counts as empty and has one empty line. Rows with null or
    repeated keys are counted each. A null array of sections, and an empty table, give no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    chosen = F.lit(None).cast(_SECTIONS) if sections is None else sections.cast(_SECTIONS)
    source = docs.select(
        F.col(f"`{key}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        chosen.alias("sections"),
    )
    by_line = sections is None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, pattern)
        widths = np.zeros(enc.n_vocab, np.int64)
        for token in range(enc.n_vocab):
            try:
                widths[token] = len(enc.decode_single_token_bytes(token))
            except KeyError:
                pass
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, all_names, cells = [], [], [[] for _ in range(6)]
                given = [None] * part.num_rows if by_line else part.column(2).to_pylist()
                for i, (x, spans) in enumerate(zip(part.column(1).to_pylist(), given)):
                    ids = np.array(encode_text(enc, x), np.int64)
                    data = np.frombuffer(x.encode(), np.uint8)
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    edges = np.concatenate([[0], np.cumsum(widths[ids])])
                    starts, ends = chars[np.minimum(edges[:-1] + 1, len(data))] - 1, chars[edges[1:]]
                    if by_line:
                        begin, end = _line_spans(data, chars)
                        names = [None] * len(begin)
                    else:
                        whole = [s or {"name": None, "start": None, "end": None} for s in spans or []]
                        begin = np.array([s["start"] or 0 for s in whole], np.int64)
                        end = np.array([s["end"] or 0 for s in whole], np.int64)
                        names = [s["name"] for s in whole]
                    counts, crossing = count_in(starts, ends, begin, end, rule)
                    rows.append(np.full(len(begin), i))
                    own = (np.arange(len(begin)), begin, end, counts, crossing, np.full(len(begin), len(ids)))
                    for cell, value in zip(cells, own):
                        cell.append(value)
                    all_names += names
                if rows:
                    columns = [part.column(0).take(pa.array(np.concatenate(rows).astype(np.int64)))]
                    number, begin, end, counts, crossing, total = [np.concatenate(c) for c in cells]
                    columns += [pa.array(number.astype(np.int64)), pa.array(all_names, pa.string())]
                    columns += [pa.array(x.astype(np.int64)) for x in (begin, end)]
                    columns += [pa.array(counts.astype(np.float64))]
                    columns += [pa.array(x.astype(np.int64)) for x in (crossing, total)]
                    yield pa.RecordBatch.from_arrays(columns, names=names_out)

    names_out = ["doc_id", "section", "name", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        work,
        f"doc_id {kind}, section long, name string, start long, `end` long, n_tokens double, "
        "n_crossing long, doc_tokens long",
    )
