"""Arrays met with a table by their elements, without moving an element for each place it stands at.

Rows are written in chunks, each with a list of its distinct elements, and hold numbers in that list in place
of elements. Only the lists meet a table, and go back to their chunks; the rows are read where they lie.
"""

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from antecede.session import bucketed, scratch_path

#: Elements, and rows, that share a list of distinct elements, unless one row has more.
CHUNK = 1 << 20


class Chunks(NamedTuple):
    rows: DataFrame  #: The rows, with id_chunk and, for the elements of the array, numbers in the list of the chunk.
    lists: DataFrame  #: (id_chunk, _listed), a list for each chunk.


def coded(df: DataFrame, column: str, name: str = "coded") -> Chunks:
    """The rows of a table in written chunks, bucketed by chunk, that hold numbers for an array's elements."""
    rest = df.drop(column)
    fields = [StructField(f.name, f.dataType) for f in rest.schema.fields]
    fields += [StructField("id_chunk", LongType()), StructField("_codes", ArrayType(IntegerType()))]
    made = StructType([*fields, StructField("_listed", ArrayType(df.schema[column].dataType.elementType))])
    chunks = df.select(*rest.columns, column).mapInArrow(_chunks, made)
    path = scratch_path(df.sparkSession, name)
    held = bucketed(chunks, "id_chunk", name, path=path, compression="zstd")  # a task writes a file for each chunk
    lists = df.sparkSession.read.schema(held.schema).parquet(path).filter(F.col("_listed").isNotNull())
    return Chunks(held.filter(F.col("_codes").isNotNull()).drop("_listed"), lists.select("id_chunk", "_listed"))


def listed(chunks: Chunks, element: str) -> DataFrame:
    """The distinct elements of each chunk: (id_chunk, _code, element)."""
    return chunks.lists.select("id_chunk", F.posexplode("_listed").alias("_code", element))


def placed(chunks: Chunks, known: DataFrame, default: int | None = None) -> DataFrame:
    """The rows with arrays ``_pos`` and, for each column of ``known`` behind id_chunk and _code, its values there.

    ``known`` has rows of ``listed`` with what was found for them. An element without a row has no place in the
    arrays, or with ``default`` that value; one with several rows has as many places. A task holds a chunk at a time.
    """
    values = known.columns[2:]
    kept = [f for f in chunks.rows.schema.fields if f.name not in ("id_chunk", "_codes")]
    arrays = [StructField("_pos", ArrayType(IntegerType()))]
    arrays += [StructField(c, ArrayType(known.schema[c].dataType)) for c in values]
    filled = _filled([f.name for f in kept], values, default)
    return chunks.rows.groupBy("id_chunk").cogroup(known.groupBy("id_chunk")).applyInArrow(filled, StructType([*kept, *arrays]))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is an array, and behind those of a chunk one row with its list."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        ends = (batch.columns[-1].value_lengths().fill_null(0).to_numpy().astype(np.int64) + 1).cumsum()
        first = 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            last = int(np.searchsorted(ends, done + CHUNK - size, "right"))
            last = max(last, first if held else first + 1)
            if last > first:
                held.append(batch.slice(first, last - first))
                size += int(ends[last - 1] - done)
            first = last
            if first < batch.num_rows:
                yield from _chunk(held, number)
                number, held, size = number + 1, [], 0
    if held:
        yield from _chunk(held, number)


def _chunk(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held).combine_chunks()
    *rest, lists = [c.combine_chunks() for c in table.columns]
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    elements = lists.flatten()
    if elements.null_count and pa.types.is_string(elements.type):
        elements = elements.fill_null("")
    found = elements.dictionary_encode()
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    starts = pa.array(np.append(0, sizes.cumsum()).astype(np.int32))
    codes = pa.ListArray.from_arrays(starts, found.indices.cast(pa.int32()))
    names, kind = [*table.schema.names[:-1], "id_chunk", "_codes", "_listed"], pa.list_(elements.type)
    own = pa.array(np.full(table.num_rows, number))
    yield pa.RecordBatch.from_arrays([*rest, own, codes, pa.nulls(table.num_rows, kind)], names=names)
    ends = pa.array([0, len(found.dictionary)], pa.int32())
    distinct = pa.ListArray.from_arrays(ends, found.dictionary)
    none = [pa.nulls(1, c.type) for c in (*rest, codes)]
    yield pa.RecordBatch.from_arrays([*none[:-1], pa.array([number]), none[-1], distinct], names=names)


def _filled(kept: list[str], values: list[str], default: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Puts what is known of a chunk's elements in the places of its rows."""

    def fill(rows: pa.Table, known: pa.Table) -> pa.Table:
        lists = rows["_codes"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        codes, by = lists.flatten().fill_null(-1).to_numpy(), known["_code"].to_numpy()
        none = int(max(codes.max(initial=-1), by.max(initial=-1))) + 1
        codes = np.where(codes < 0, none, codes)
        order = by.argsort(kind="stable")
        counts = np.bincount(by, minlength=none + 1)
        begin = counts.cumsum() - counts
        if default is not None:
            begin[counts == 0], counts[counts == 0] = len(by), 1
        each = counts[codes]  # how many values a place has
        ends = np.append(0, each.cumsum())
        at = np.repeat(begin[codes] - ends[:-1], each) + np.arange(ends[-1])
        row_ends = np.append(0, sizes.cumsum())
        pos = np.arange(len(codes)) - np.repeat(row_ends[:-1], sizes)
        starts = pa.array(ends[row_ends].astype(np.int32))
        arrays = [pa.ListArray.from_arrays(starts, pa.array(np.repeat(pos, each).astype(np.int32)))]
        for c in values:
            found = known[c].combine_chunks()
            found = pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found
            found = found.take(pa.array(order))
            if default is not None:
                found = pa.concat_arrays([found, pa.array([default], found.type)])
            arrays.append(pa.ListArray.from_arrays(starts, found.take(pa.array(at))))
        return pa.table([*[rows[c] for c in kept], *arrays], names=[*kept, "_pos", *values])

    return fill
