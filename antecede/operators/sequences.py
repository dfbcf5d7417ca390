"""Vocabulary, token ids and padding."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from antecede.functions.numeric import hash_key
from antecede.operators import lookup
from antecede.operators.folds import SEED
from antecede.operators.ranks import range_buckets, rank_within
from antecede.session import written

# Reserved token ids. 0 pads.
RESERVED = {
    "[PAD]": 0,
    "[A]": 1,
    "[B]": 2,
    "[MALENAME]": 3,
    "[FEMALENAME]": 4,
    "[NAME]": 5,
    "[UNK]": 100,
    "[CLS]": 101,
    "[SEP]": 102,
    "[MASK]": 103,
}
#: Tokens that are made postings, or postings that are put in place, at a time.
CHUNK = 1 << 18


def build_vocab(
    tokens: DataFrame, size: int | None = None, reserved: dict[str, int] = RESERVED
) -> DataFrame:
    """``token`` and ``token_id``: reserved tokens, then those of a corpus, most frequent first.

    All tokens get an id, or the first ``size`` of them. Counts are combined before the
    shuffle, and ranks are taken in slices of (count, token), cut at sampled keys: words that are
    seen once are spread over as many slices as they fill, and no task gets a whole vocabulary.
    """
    spark = tokens.sparkSession
    special = spark.createDataFrame(list(reserved.items()), "token string, token_id int")
    counts = tokens.filter(~F.col("token").isin(*reserved)).groupBy("token").count()
    counts = written(counts, "token-counts")
    keyed = counts.select("token", F.struct((-F.col("count")).alias("n"), "token").alias("_place"))
    ranked = rank_within(range_buckets(keyed, "_place"), [], ["_place"], F.col("_range"))
    if size is not None:
        ranked = ranked.filter(F.col("rank") <= size)
    first = max(reserved.values()) + 1
    return special.unionByName(
        ranked.select("token", (F.col("rank") + (first - 1)).cast("int").alias("token_id"))
    )


def encode_tokens(
    df: DataFrame, vocab: DataFrame, sep: bool = False, reserved: dict[str, int] = RESERVED
) -> DataFrame:
    """``tokens`` to ``ids`` behind ``[CLS]``; ``sep`` also appends ``[SEP]``.

    Every row stays; null tokens count as none, and rows with an id that comes again are one row, filled up with
    zeros. Rows are written in chunks, with numbers for their tokens; the distinct tokens of a chunk meet the
    vocabulary by token, which Spark broadcasts if its bytes are few and else joins, splitting frequent tokens, and
    their ids go back to the chunk. So no row moves, and a token moves twice for each chunk that has it. A task holds
    one chunk at a time (``lookup.CHUNK`` tokens, or the longest row).
    """
    rest = [c for c in df.columns if c not in ("id", "tokens")]
    framed = F.concat(
        F.array(F.lit("[CLS]")), F.coalesce("tokens", F.array().cast("array<string>")), F.array(F.lit("[SEP]")) if sep else F.array()
    )
    chunks = lookup.coded(df.select("id", *rest, framed.alias("_tokens")), "_tokens")
    ids = vocab.select("token", F.coalesce(F.col("token_id").cast("int"), F.lit(reserved["[UNK]"])).alias("ids"))
    known = lookup.listed(chunks, "token").join(ids, "token").select("id_chunk", "_code", "ids")
    found = lookup.placed(chunks, known, reserved["[UNK]"]).select("id", *rest, "ids")
    again = written(chunks.rows.groupBy(F.col("id").alias("_again")).count().filter("count > 1").select("_again"), "ids-again")
    if again.isEmpty():
        return found
    same = F.col("id").eqNullSafe(F.col("_again"))
    firsts = [F.first(c, ignorenulls=True).alias(c) for c in rest]
    zeros = F.array_repeat(F.lit(0), (F.sum(F.size("ids")) - F.max(F.size("ids"))).cast("int"))
    merged = found.join(again, same, "left_semi").groupBy("id")
    merged = merged.agg(*firsts, F.concat(F.max_by("ids", F.size("ids")), zeros).alias("ids"))
    return found.join(again, same, "left_anti").unionByName(merged)


# Postings, which `encode_tokens` was made of; it goes by chunks now.


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of rows whose last column is their tokens; other columns go with a row's first posting only."""
    for batch in batches:
        ends = batch.column(batch.num_columns - 1).value_lengths().to_numpy().cumsum()
        first = 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
            part, first = batch.slice(first, last - first), last
            sizes = part.column(part.num_columns - 1).value_lengths().to_numpy()
            tokens = part.column(part.num_columns - 1).flatten()
            if tokens.null_count:
                tokens = tokens.fill_null("")
            words = tokens.dictionary_encode()
            row = np.repeat(np.arange(len(sizes)), sizes)
            key = row * len(words.dictionary) + words.indices.to_numpy()
            order = key.argsort(kind="stable")
            key = key[order]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            own, place = row[order[begin]], order - (sizes.cumsum() - sizes)[row[order]]
            places = pa.ListArray.from_arrays(
                pa.array(np.concatenate([begin, [len(key)]]).astype(np.int32)), pa.array(place.astype(np.int32))
            )
            opens = np.concatenate([[True], own[1:] != own[:-1]])
            with_first = pa.array(own, mask=~opens)
            token = words.dictionary.take(pa.array(key[begin] % len(words.dictionary)))
            columns = [part.column(0).take(pa.array(own)), *[c.take(with_first) for c in part.columns[1:-1]], token, places]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], "token", "places"])


def _postings(tokens: Column) -> Column:
    """The distinct tokens of an array with their places, as an expression: what ``_posted`` makes of a row."""

    def runs(ordered: Column) -> Column:
        number = F.sequence(F.lit(0), F.size(ordered) - 1)
        begins = F.filter(
            number, lambda i: (i == 0) | (F.get(ordered, i)["token"] != F.get(ordered, i - 1)["token"])
        )
        return F.transform(F.array(begins), lambda b: F.transform(b, lambda i, k: posting(ordered, b, i, k)))[0]

    def posting(ordered: Column, begins: Column, i: Column, k: Column) -> Column:
        end = F.coalesce(F.get(begins, k + 1), F.size(ordered))
        own = F.transform(F.slice(ordered, i + 1, end - i), lambda t: t["place"])
        return F.struct(F.get(ordered, i)["token"].alias("token"), own.alias("places"))

    known = F.transform(tokens, lambda t, i: F.struct(F.coalesce(t, F.lit("")).alias("token"), i.alias("place")))
    return F.transform(F.array(F.sort_array(known)), runs)[0]


def _in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token ids at the places of their postings, which come sorted by the first column, the row they are of."""
    held: list[pa.RecordBatch] = []  # the postings of the last row so far
    for batch in batches:
        for first in range(0, batch.num_rows, CHUNK):
            part = batch.slice(first, CHUNK)
            runs = pc.run_end_encode(part.column(0))
            if held and held[0].column(0)[0] != part.column(0)[0]:
                yield _filled(held)
                held = []
            begin = int(runs.run_ends[-2].as_py()) if len(runs.run_ends) > 1 else 0
            if begin:
                yield _filled([*held, part.slice(0, begin)])
                held = []
            held.append(part.slice(begin))
    if held:
        yield _filled(held)


def _filled(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row of ids for each run of postings with an equal first column."""
    batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    ends = pc.run_end_encode(batch.column(0)).run_ends.to_numpy().astype(np.int64)
    begin = np.concatenate([[0], ends[:-1]])
    of, places = batch.column(batch.num_columns - 2).to_numpy(), batch.column(batch.num_columns - 1)
    counts = places.value_lengths().to_numpy().astype(np.int64)
    before = np.concatenate([[0], counts.cumsum()])
    sizes = before[ends] - before[begin]
    start = np.concatenate([[0], sizes.cumsum()])
    out = np.zeros(start[-1], np.int32)
    out[np.repeat(np.repeat(start[:-1], ends - begin), counts) + places.flatten().to_numpy()] = np.repeat(of, counts)
    ids = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(out))
    rest = []
    for column in batch.columns[1:-2]:
        valid = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        found = np.append(valid, len(column))[np.searchsorted(valid, begin)]
        rest.append(column.take(pa.array(np.where(found < ends, found, begin))))
    names = batch.schema.names[:-2]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(begin)), *rest, ids], names=[*names, "ids"])


def pad_truncate(
    df: DataFrame, batch: str | list[str] = "batch_id", max_len: int | None = None
) -> DataFrame:
    """Ids zero-padded to the longest row of the batch, and cut where ``max_len`` is given.

    Spans move by one for ``[CLS]``; ``truncated_span`` tells that one ends past the cut.
    """
    longest = F.max(F.size("ids")).over(Window.partitionBy(batch))
    width = longest if max_len is None else F.least(longest, F.lit(max_len))
    lacking = F.col("width") - F.size("ids")
    filled = F.concat("ids", F.array_repeat(F.lit(0), lacking))  # a slice boxes each value, so only rows that are cut take one
    padded = F.when(lacking >= 0, filled).otherwise(F.slice("ids", F.lit(1), F.col("width")))
    fields = df.schema["spans"].dataType.fieldNames()
    moved = F.struct(*[(F.col("spans")[f] + 1).alias(f) for f in fields])
    ends = F.array_max(F.array(*[F.col("spans")[f] for f in fields if f.endswith("_end")]))
    return (
        df.withColumn("width", width)
        .withColumn("ids", padded)
        .withColumn("spans", moved)
        .withColumn("truncated_span", ends >= F.col("width"))
    )


def length_batches(df: DataFrame, size: int = 32, seed: int = SEED) -> DataFrame:
    """``batch_id`` and ``batch_pos`` of (id, n) rows, so that the rows of a batch are about as long.

    Rows of equal length follow a seeded hash of the id; the batches ascend in length, and are dealt
    to a training run by ``batch_order``, the seeded hash of a batch.
    """
    place = F.struct("n", hash_key(seed, F.col("id")).alias("h"), "id")
    ranked = rank_within(range_buckets(df.withColumn("_place", place), "_place"), [], ["_place"], F.col("_range"))
    at = F.col("rank") - 1
    return ranked.select(
        *df.columns,
        F.floor(at / size).cast("bigint").alias("batch_id"),
        F.pmod(at, F.lit(size)).cast("int").alias("batch_pos"),
    ).withColumn("batch_order", hash_key(seed, F.col("batch_id")))


def padding(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows, tokens and padding of (batch_id, n) rows, for each value of ``by``: what a batch's widest row costs."""
    batches = df.groupBy(*by, "batch_id").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("_tokens"), F.max("n").alias("_width")
    )
    total = batches.groupBy(*by).agg(
        F.sum("_rows").alias("n_rows"),
        F.sum("_tokens").alias("n_tokens"),
        F.sum(F.col("_rows") * F.col("_width") - F.col("_tokens")).alias("n_padding"),
    )
    share = F.col("n_padding") / F.nullif(F.col("n_tokens") + F.col("n_padding"), F.lit(0))
    return total.withColumn("share", share)
