"""Byte-level BPE encoding and decoding with a local rank file."""

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from antecede.llm.columns import unused

#: A text is handed to the encoder in pieces of about so many characters.
PIECE_CHARS = 1 << 16
# Between a character that is not white space and one that is, every match of a pattern whose
# alternatives hold white space only at their beginning must end.
_SAFE = regex.compile(r"(?<=\S)(?=\s)")


@functools.lru_cache(maxsize=4)
def encoder(rank_file: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file's content, made once per worker."""
    ranks = {}
    for line in rank_file.split(b"\n"):
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def read_ranks(path: str) -> bytes:
    """A rank file, read on the driver; its size is that of one vocabulary."""
    with open(path, "rb") as file:
        return file.read()


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """A text cut at the first safe boundary after each ``size`` characters.

    Encoding the pieces one by one gives the tokens of the whole. A text without such a
    boundary, one endless word, stays in one piece.
    """
    begin = 0
    while len(text) - begin > size:
        cut = _SAFE.search(text, begin + size)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text):
        ids += enc.encode_ordinary(piece)
    return ids


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns and, in ``out``, the token ids of ``text`` (array of int).

    Special tokens are not recognised: their names are ordinary text. A null text counts as
    empty and has an empty array. Row order, ties and copies play no part; an empty table
    gives an empty table. A column named ``out`` (names ignore case) is replaced.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, pattern)
        for batch in batches:
            names = batch.schema.names[:-1]
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids = [encode_text(enc, x or "") for x in part.column(part.num_columns - 1).to_pylist()]
                columns = [*part.columns[:-1], pa.array(ids, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, out])

    (held,) = unused(df, "_bpe_text")
    source = df.select(*kept, F.col(f"`{text}`").cast("string").alias(held))
    schema = source.drop(held).withColumn(out, F.lit(None).cast("array<int>")).schema
    return source.mapInArrow(work, schema)


def decode(df: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and, in ``out``, the bytes that the token ids stand for (binary).

    A token may hold part of a character, so only the bytes of a whole sequence need be valid
    UTF-8. Null ids decode to no bytes; an id that is not in the rank file raises.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, pattern)
        for batch in batches:
            names = batch.schema.names[:-1]
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                data = [enc.decode_bytes(x or []) for x in part.column(part.num_columns - 1).to_pylist()]
                columns = [*part.columns[:-1], pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, out])

    (held,) = unused(df, "_bpe_ids")
    source = df.select(*kept, F.col(f"`{ids}`").cast("array<int>").alias(held))
    schema = source.drop(held).withColumn(out, F.lit(None).cast("binary")).schema
    return source.mapInArrow(work, schema)


def round_trip(df: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, number of tokens, and hashes of the ids and of the bytes they decode to.

    Encodes and decodes in one task, so that ids of a whole corpus need not be held or moved:
    ``n_tokens`` long, ``ids_sha256`` of the decimal ids joined by a space, ``decoded_sha256``,
    ``same`` whether the decoded bytes are those of the text. A null text counts as empty; a
    text of any length is encoded piece by piece. Rows with null or repeated keys have a row
    each; an empty table gives an empty table. A key called like one of the four makes an error.
    """
    if key.lower() in ("n_tokens", "ids_sha256", "decoded_sha256", "same"):
        raise ValueError(f"the key can't be called like a column that is made: {key}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, pattern)
        written = list(map(str, range(enc.n_vocab))).__getitem__
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                counts, of_ids, of_bytes, same = [], [], [], []
                for x in part.column(1).to_pylist():
                    x = x or ""
                    ids = encode_text(enc, x)
                    back = enc.decode_bytes(ids)
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(" ".join(map(written, ids)).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(back).hexdigest())
                    same.append(back == x.encode())
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string())]
                columns += [pa.array(of_bytes, pa.string()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(
                    columns, names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "same"]
                )

    source = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("_bpe_text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(
        work,
        f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean",
    )
