"""Benchmark items found inside documents: MinHash containment search in size partitions."""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from antecede.llm import words as W
from antecede.llm.columns import unused

#: Share of an item's distinct shingles that a document must hold.
CONTAINMENT = 0.8
#: MinHash functions; each is a band of one row.
BANDS = 32
#: Items are broadcast in blocks of at most so many; more items take more passes.
BLOCK_ITEMS = 20_000
_SEED = 10
_LOW = np.uint64(0xFFFF)


def ordered(hashes: np.ndarray, constant: np.uint64) -> np.ndarray:
    """Values of one ordering: products with an odd number, as exclusive or would give related orderings."""
    return hashes * constant


class Index:
    """One block of items: their shingle sets, and MinHash values by size class.

    Class ``c`` holds items of 2^c up to 2^(c+1) - 1 distinct shingles. A document is cut into
    blocks of 2^c shingles; a window is three blocks in a row, so any run of 2^(c+1) shingles
    lies in one. An item of which 0.8 stand in such a run then has a Jaccard similarity of at
    least 0.8 * 2^c / (3 * 2^c + 0.2 * 2^c) = 0.25 with the window, and 32 bands miss it with a
    probability of at most 0.75^32 = 0.0001; one that is there in full, with 3e-6.
    """

    def __init__(self, item_ids: list[int], texts: list[str | None]):
        parsed = W.Words(pa.array(texts, pa.string()))
        flat, bounds = W.shingles(parsed, parsed.hashes())
        self.constants = W.constants(BANDS, _SEED) | np.uint64(1)
        self.ids, self.sets = [], []
        by_class: dict[int, list[int]] = {}
        for i, item_id in enumerate(item_ids):
            own = np.unique(flat[bounds[i] : bounds[i + 1]])
            if own.size and item_id is not None:
                by_class.setdefault(int(own.size).bit_length() - 1, []).append(len(self.ids))
                self.ids.append(item_id)
                self.sets.append(own)
        #: Per class and band: sorted MinHash values, the items that have them, and which low
        #: 16 bits occur, to turn most windows away at once.
        self.classes = {}
        for c, members in sorted(by_class.items()):
            bands = []
            for k in self.constants:
                low = np.array([ordered(self.sets[m], k).min() for m in members], np.uint64)
                order = np.argsort(low, kind="stable")
                bits = np.zeros(1 << 16, bool)
                bits[(low & _LOW).astype(np.int64)] = True
                bands.append((low[order], np.array(members)[order], bits))
            self.classes[c] = bands

    def candidates(self, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Pairs (text, item) whose MinHash values agree in a band of some window."""
        pairs = []
        full = np.flatnonzero(np.diff(bounds) > 0)
        if not full.size:
            return np.zeros((0, 2), np.int64)
        grids, sizes, done = {}, np.diff(bounds)[full], 0
        for c in self.classes:  # blocks of a class are made of those of the class before
            grids[c] = _grid(sizes, 1 << (c - done))
            sizes, done = np.bincount(grids[c][0], minlength=full.size), c
        for band, constant in enumerate(self.constants):
            low = ordered(flat, constant)
            for c, bands in self.classes.items():
                values, members, bits = bands[band]
                text, begin, following, after = grids[c]
                low = np.minimum.reduceat(low, begin)
                window = np.minimum(np.minimum(low, low[following]), low[after])
                near = np.flatnonzero(bits[(window & _LOW).astype(np.int64)])
                lo = np.searchsorted(values, window[near], side="left")
                hi = np.searchsorted(values, window[near], side="right")
                for n, a, z in zip(near[hi > lo], lo[hi > lo], hi[hi > lo]):
                    own = members[a:z]
                    pairs.append(np.stack([np.full(own.size, full[text[n]]), own], axis=1))
        return np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)

    def search(self, flat: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item id, shared shingles, shingles of the item), confirmed on the full sets."""
        out, last, distinct = [], -1, None
        for i, m in self.candidates(flat, bounds).tolist():
            if i != last:
                last, distinct = i, np.unique(flat[bounds[i] : bounds[i + 1]])
            item = self.sets[m]
            at = np.minimum(np.searchsorted(distinct, item), distinct.size - 1)
            shared = int((distinct[at] == item).sum())
            if 5 * shared >= 4 * item.size:
                out.append((i, self.ids[m], shared, int(item.size)))
        return out


def _grid(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of ``width`` units of texts of so many units: text, first unit, and the next two blocks.

    At the end of a text the last block stands for those that follow.
    """
    blocks = -(-sizes // width)
    text = np.repeat(np.arange(len(sizes)), blocks)
    first_block, first_unit = np.cumsum(blocks) - blocks, np.cumsum(sizes) - sizes
    number = np.arange(len(text))
    last = (first_block + blocks - 1)[text]
    begin = first_unit[text] + (number - first_block[text]) * width
    return text, begin, np.minimum(number + 1, last), np.minimum(number + 2, last)


def _indexes(items: DataFrame, item_key: str, item_text: str, block_items: int) -> Iterator[Index]:
    """The items in blocks; one partition of the benchmark is read at a time. At least one block."""
    asked = items.select(
        F.col(f"`{item_key}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text")
    )
    block, made = [], False
    for row in asked.toLocalIterator():
        block.append(row)
        if len(block) == block_items:
            yield Index([r[0] for r in block], [r[1] for r in block])
            block, made = [], True
    if block or not made:
        yield Index([r[0] for r in block], [r[1] for r in block])


def _hits(index: Index, texts: pa.Array) -> list[tuple[int, int, int, int]]:
    parsed = W.Words(texts)
    return index.search(*W.shingles(parsed, parsed.hashes()))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Pairs (doc_id, item_id, n_shared, n_item) where a document holds 0.8 of an item's shingles.

    Shingles are distinct runs of five words of the whole texts, in lower case (A-Z); an item
    or document of fewer words has its whole sequence as one. Candidates come from MinHash
    windows (see ``Index``) and each is confirmed on the full sets. Documents stay where they
    are: items are sent to them in blocks of ``block_items``, one pass over the documents per
    block, so the memory of a task does not grow with the benchmark. Null or blank texts and
    null item ids match nothing; a document may match many items, and repeated rows are reported each;
    a text of any length is searched as one slice; empty tables give an empty result. Item ids
    must be integers; document keys may be any type.
    """
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, n_shared long, n_item long"
    context = docs.sparkSession.sparkContext

    def scan(index: Broadcast) -> DataFrame:
        def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if hits := _hits(index.value, part.column(1)):
                rows, *found = zip(*hits)
                columns = [part.column(0).take(pa.array(rows))]
                columns += [pa.array(c, pa.int64()) for c in found]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "n_shared", "n_item"])

        return source.mapInArrow(W.map_runs(work), schema)

    passes = [scan(context.broadcast(i)) for i in _indexes(items, item_key, item_text, block_items)]
    return reduce(DataFrame.unionByName, passes)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns and in place.

    The verdict is taken row by row in the task, as ``contained_items`` would find it, so rows with
    null or repeated keys go by their own text and nothing is shuffled; each block of items is one
    more pass over the rows that are left. A null or blank text holds nothing and stays; columns may
    have any names; without items all rows stay, and an empty table gives an empty table.
    """
    (held,) = unused(docs, "_searched_text")
    left = docs.select("*", F.col(f"`{text}`").cast("string").alias(held))
    context, tagged = docs.sparkSession.sparkContext, left.schema

    def scan(rows: DataFrame, index: Broadcast) -> DataFrame:
        def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            clean = np.ones(part.num_rows, bool)
            clean[[hit[0] for hit in _hits(index.value, part.column(part.num_columns - 1))]] = False
            yield part.take(pa.array(np.flatnonzero(clean)))

        return rows.mapInArrow(W.map_runs(work, held), tagged)

    for index in _indexes(items, item_key, item_text, block_items):
        left = scan(left, context.broadcast(index))
    return left.drop(held)
