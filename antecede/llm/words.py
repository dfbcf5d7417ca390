"""Words, word hashes and word shingles of Arrow batches, as NumPy arrays.

Used inside tasks, on one Arrow batch at a time. A word is a run of bytes other than space and
``\\t \\n \\v \\f \\r``; A-Z count as a-z. Null texts count as empty. Hashes are 64 bits, made of
bijective mixing steps, and the same in every task and session.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE = 5
#: Texts of a batch are worked on in runs of about so many bytes, to bound the arrays.
RUN_BYTES = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MUL1, _MUL2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LONG_WORD = 1 << 10


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64: a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MUL1
    x = (x ^ (x >> np.uint64(27))) * _MUL2
    return x ^ (x >> np.uint64(31))


def chain(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hash of a sequence hashed to ``h`` and one more value."""
    return mix(h * _ODD + x)


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.array([seed], np.uint64) * _MUL2)


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, one after the other, and where each begins and ends."""
    texts = column.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def runs(batch: pa.RecordBatch, column: str, max_bytes: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``max_bytes`` of text; a longer text is a slice of its own."""
    _, at = raw_texts(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(at, at[begin] + max_bytes, side="right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


class Words:
    """The words of the texts of a column.

    ``starts`` and ``ends`` are byte positions of words in ``data``; text ``i`` has the words
    ``first[i]`` up to ``first[i + 1]`` and the bytes ``at[i]`` up to ``at[i + 1]``.
    """

    def __init__(self, column: pa.Array, lower: bool = True):
        data, self.at = raw_texts(column)
        self.data = _LOWER[data] if lower else data
        size = len(data)
        word = ~SPACE[data]
        full = self.at[1:] > self.at[:-1]
        opens, closes = word.copy(), word.copy()
        if size:
            opens[1:] &= ~word[:-1]
            closes[:-1] &= ~word[1:]
            begin, end = self.at[:-1][full], self.at[1:][full] - 1
            opens[begin] = word[begin]
            closes[end] = word[end]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, self.at)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        return hash_spans(self.data, self.starts, self.ends)

    def text_of(self) -> np.ndarray:
        """For every word, the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte span of ``data``."""
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) * _ODD)
    if not len(data):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    long = np.flatnonzero(lengths > _LONG_WORD)
    todo, at, left = np.flatnonzero((lengths <= _LONG_WORD) & (lengths > 0)), starts.copy(), lengths.copy()
    while todo.size:
        piece = wide[at[todo]] & _KEEP[np.minimum(left[todo], 8)]
        out[todo] = chain(out[todo], piece)
        at[todo] += 8
        left[todo] -= 8
        todo = todo[left[todo] > 0]
    for i in long:
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a text, and each run's first word."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[: n - width + 1]
    for k in range(1, width):
        out = chain(out, hashes[k : n - width + 1 + k])
    last = np.repeat(first[1:], np.diff(first))[: n - width + 1]
    keep = np.flatnonzero(np.arange(n - width + 1) + width <= last)
    return out[keep], keep


def shingles(words: Words, hashes: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of every text, in order and with repeats, and their bounds.

    A text of fewer words than ``width`` has its whole sequence as one; one without words has none.
    """
    counts = words.counts()
    runs_, at = windows(hashes, words.first, width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if short.size:
        whole = []
        for i in short:
            own = hashes[words.first[i] : words.first[i + 1]]
            h = np.full(1, len(own), np.uint64) * _ODD
            for w in own:
                h = chain(h, w)
            whole.append(h[0])
        at = np.concatenate([at, words.first[short]])
        order = np.argsort(at, kind="stable")
        runs_ = np.concatenate([runs_, np.array(whole, np.uint64)])[order]
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    return runs_, np.concatenate([[0], np.cumsum(sizes)])


def map_runs(
    work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
    column: str = "text",
    max_bytes: int = RUN_BYTES,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: a function of a bounded slice of rows, applied to all of a partition."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, column, max_bytes):
                yield from work(part)

    return apply
