"""Near duplicates: MinHash signatures joined by a multi-index over their chunks.

A signature has 80 values of 16 bits, each the lowest bits of the hash of the shingle that is
first under one ordering of all shingles: by the product of its hash and an odd number. (Exclusive
or with a number would give orderings that follow one trie of the hashes.) Two sets of Jaccard
similarity s differ in each value with probability 1 - s. The distance of signatures is the
number of values that differ.

Pigeonhole: 80 values in 10 chunks of 8. Signatures at a distance of at most 19 have a chunk
with at most one differing value, so with every chunk and every choice of one value to leave
out (10 * 8 keys, each of the 7 values that are left) they share a key for sure. Beyond that
distance they mostly do: at s = 0.85 all 10 chunks have two or more differing values with
probability 0.343^10 = 2e-5, at s = 0.80 (the pipeline's stage) with 0.497^10 = 0.0009.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from antecede.llm import words as W
from antecede.llm.columns import unused
from antecede.llm.components import components
from antecede.session import written

VALUES, CHUNK = 80, 8
#: Buckets of more members than this are compared in blocks of about ``BLOCK`` nodes, not by pairs.
HOT, BLOCK = 32, 256
#: Documents are linked from this similarity on, in per cent.
SIMILARITY = 85
_SEED = 7
_ORDERS = W.constants(VALUES, _SEED) | np.uint64(1)


def signatures(flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The signature of every set of shingle hashes; a set begins at each of ``begin``."""
    low = np.zeros((len(begin), VALUES), np.uint16)
    if len(begin):
        for k, order in enumerate(_ORDERS):
            low[:, k] = W.mix(np.minimum.reduceat(flat * order, begin)).astype(np.uint16)
    return low


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, signature) of every row.

    ``set_a`` and ``set_b`` are a 128-bit hash of the set of shingles, whatever their order;
    a document without words has no shingles and a null signature.
    """
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parsed = W.Words(part.column(1))
        flat, bounds = W.shingles(parsed, parsed.hashes())
        full = np.flatnonzero(np.diff(bounds))
        sizes = np.zeros(part.num_rows, np.int64)
        marks = np.zeros((part.num_rows, 2), np.uint64)
        for i in full:
            own = np.unique(flat[bounds[i] : bounds[i + 1]])
            sizes[i] = own.size
            marks[i] = W.mix(own ^ _ORDERS[0]).sum(), W.mix(own ^ _ORDERS[1]).sum()
        low = signatures(flat, bounds[:-1][full])
        ends = np.zeros(part.num_rows + 1, np.int32)
        ends[1:][full] = VALUES
        signature = pa.ListArray.from_arrays(
            pa.array(np.cumsum(ends, dtype=np.int32), pa.int32(), mask=None),
            pa.array(low.ravel().astype(np.int32)),
        )
        columns = [part.column(0), pa.array(sizes), pa.array(marks[:, 0].view(np.int64))]
        columns += [pa.array(np.ascontiguousarray(marks[:, 1]).view(np.int64)), signature]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    schema = f"doc_id {kind}, n_shingles long, set_a long, set_b long, signature array<int>"
    return source.mapInArrow(W.map_runs(work), schema)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, packed): the sorted distinct shingle hashes of every row of (doc_id, text), as bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parsed = W.Words(part.column(1))
        flat, bounds = W.shingles(parsed, parsed.hashes())
        own = [np.unique(flat[a:z]).tobytes() for a, z in zip(bounds[:-1], bounds[1:])]
        columns = [part.column(0), pa.array(own, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "packed"])

    return docs.select("doc_id", "text").mapInArrow(W.map_runs(work), f"doc_id {kind}, packed binary")


def chunk_keys(representatives: DataFrame) -> DataFrame:
    """(key, node): the keys of every signature, one for each chunk and value left out.

    Keys are made in the Arrow step, as 80 hash expressions of a row are more than one method of
    generated code can hold.
    """
    kind = representatives.schema["node"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().astype(np.uint64).reshape(-1, VALUES)
            keys = np.zeros((len(values), VALUES), np.uint64)
            for skip in range(VALUES):
                begin = skip - skip % CHUNK
                own = np.full(len(values), skip + 1, np.uint64)
                for k in range(begin, begin + CHUNK):
                    if k != skip:
                        own = W.chain(own, values[:, k])
                keys[:, skip] = own
            bounds = pa.array(np.arange(len(values) + 1, dtype=np.int32) * VALUES)
            listed = pa.ListArray.from_arrays(bounds, pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), listed], names=["node", "keys"])

    keyed = representatives.select("node", "signature").mapInArrow(work, f"node {kind}, keys array<long>")
    return keyed.select(F.explode("keys").alias("key"), "node")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough."""
    first = sets.select(F.col("doc_id").alias("u"), F.col("packed").alias("a"))
    second = sets.select(F.col("doc_id").alias("v"), F.col("packed").alias("b"))
    kind = pairs.schema["u"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3))):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                shared = np.intersect1d(a, b, assume_unique=True).size
                if 100 * shared >= similarity * (a.size + b.size - shared):
                    near.append(i)
            yield batch.select([0, 1]).take(pa.array(near, pa.int64()))

    rows = pairs.join(second, "v").join(first, "u").select("u", "v", "a", "b")
    return rows.mapInArrow(work, f"u {kind}, v {kind}")


def _mixed(shared: DataFrame, links: DataFrame) -> DataFrame:
    """Bucket members (key, node, label, size) of the buckets that hold more than one component."""
    labels = components(links).select("node", F.col("component").alias("_component"))
    members = shared.join(labels, "node", "left").select(
        "key", "node", F.coalesce("_component", "node").alias("label")
    )
    spread = members.groupBy("key").agg(
        F.min("label").alias("_low"), F.max("label").alias("_high"), F.count(F.lit(1)).alias("size")
    )
    spread = spread.filter("_low < _high").select("key", "size")
    return written(members.join(spread, "key"), "mixed")


def _links_in_block(rows: pa.Table, similarity: int) -> pa.Table:
    """Links between the nodes of a block pair that have different labels, enough to connect them."""
    nodes, labels = rows.column("node"), rows.column("label").to_numpy()
    sets = [x.as_buffer() for chunk in rows.column("packed").chunks for x in chunk]
    sets = [np.frombuffer(x, np.uint64) for x in sets]
    sizes = np.array([len(x) for x in sets], np.float64)
    of = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(often > 1) - 1  # shingles of a single node are shared with none
    of, column = of[often[column] > 1], place[column[often[column] > 1]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for begin in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        a, z = np.searchsorted(column, [begin, begin + 4096])
        has = np.zeros((len(sets), 4096), np.float32)
        has[of[a:z], column[a:z] - begin] = 1
        shared += has @ has.T
    union = sizes[:, None] + sizes[None, :] - shared
    near = (100 * shared >= similarity * union) & (labels[:, None] != labels[None, :])
    names = labels.tolist()
    up = {x: x for x in names}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    first, second = [], []
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        a, z = root(names[i]), root(names[j])
        if a != z:
            up[a] = z
            first.append(i)
            second.append(j)
    at = [pa.array(x, pa.int64()) for x in (first, second)]
    return pa.table({"u": nodes.take(at[0]), "v": nodes.take(at[1])})


def _links_of_hot(hot: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links across components in buckets of many members, by blocks.

    Buckets with common nodes make one group, so a pair that shares many keys is met once. The
    nodes of a group are dealt into blocks by hash, a large component's into blocks of its own,
    and every two blocks that may hold different components are compared in one task, which
    gets at most about two blocks of sets and returns fewer links than it has nodes.
    """
    kind = hot.schema["node"].dataType.simpleString()
    lowest = hot.groupBy("key").agg(F.min("node").alias("u"))
    groups = components(hot.join(lowest, "key").select("u", F.col("node").alias("v")))
    members = hot.select("node", "label").distinct().join(groups.withColumnRenamed("component", "group"), "node")
    sizes = members.groupBy("group", "label").agg(F.count(F.lit(1)).alias("own"))
    large = F.col("own") >= BLOCK
    members = members.join(sizes, ["group", "label"]).select("group", "node", "label", F.when(large, F.col("label")).alias("pure"))
    counts = members.groupBy("group", "pure").agg(F.count(F.lit(1)).alias("all"))
    counts = counts.withColumnsRenamed({"group": "_group", "pure": "_pure"})
    dealt = F.pmod(F.xxhash64("node"), F.ceil(F.col("all") / BLOCK))
    members = members.join(
        counts, (F.col("group") == F.col("_group")) & F.col("pure").eqNullSafe(F.col("_pure"))
    ).select("group", "node", "label", "pure", F.xxhash64("pure", dealt).alias("block"))
    members = written(members, "hot")
    blocks = members.select("group", "pure", "block").distinct()
    others = blocks.select("group", F.col("pure").alias("_pure"), F.col("block").alias("_block"))
    differ = F.coalesce(F.col("pure") != F.col("_pure"), F.lit(True))
    pairs = blocks.join(others, "group").filter((F.col("block") <= F.col("_block")) & differ)
    both = F.array_distinct(F.array("block", "_block"))
    pairs = pairs.select("group", F.xxhash64("group", "block", "_block").alias("pair"), F.explode(both).alias("block"))
    packed = sets.groupBy(F.col("doc_id").alias("node")).agg(F.first("packed").alias("packed"))
    rows = members.join(pairs, ["group", "block"]).select("pair", "node", "label").join(packed, "node")
    return rows.groupBy("pair").applyInArrow(
        lambda t: _links_in_block(t, similarity), f"u {kind}, v {kind}"
    )


def near_links(docs: DataFrame, sketched: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Links (u, v) that connect just what all pairs at or over ``similarity`` connect.

    ``sketched`` has one row per distinct set: node and signature. First a node of every bucket
    (the nodes of a key), chosen by a hash of both, is compared with all others of it. A
    group of near copies has many buckets, and so as many nodes that all are compared with: it
    is mostly one component after this step, which takes one comparison a member and bucket.
    Nodes that are known to be connected need no further comparison; buckets that still hold
    several components have every two nodes of different ones compared, as pairs in buckets of up to
    ``HOT`` members and in blocks (``_links_of_hot``) beyond. So no pair is left out that
    shares a key.
    """
    keys = chunk_keys(sketched)
    chosen = keys.groupBy("key").agg(
        F.min_by("node", F.xxhash64("key", "node")).alias("leader"), F.count(F.lit(1)).alias("_n")
    )
    shared = written(keys.join(chosen.filter("_n > 1").drop("_n"), "key"), "buckets")
    members = shared.select(F.col("node").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(members, "doc_id", "left_semi")
    sets = written(shingle_sets(texts), "sets")

    pairs = shared.filter("node <> leader").select(
        F.least("leader", "node").alias("u"), F.greatest("leader", "node").alias("v")
    )
    links = written(confirmed(pairs.distinct(), sets, similarity), "links")

    mixed = _mixed(shared, links)
    few = mixed.filter(F.col("size") <= HOT)
    other = few.select("key", F.col("node").alias("v"), F.col("label").alias("other"))
    rest = few.withColumnRenamed("node", "u").join(other, "key").filter("u < v and label <> other")
    rest = rest.select("u", "v").distinct().join(pairs, ["u", "v"], "left_anti")
    links = links.unionByName(confirmed(rest, sets, similarity))
    hot = mixed.filter(F.col("size") > HOT)
    return links if hot.isEmpty() else links.unionByName(_links_of_hot(hot, sets, similarity))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: int = SIMILARITY
) -> DataFrame:
    """Per row (doc_id, n_shingles, component_id, kept), from links of ``similarity`` per cent.

    A document's set holds its distinct five-word shingles (words in lower case A-Z), or its
    whole word sequence if that is shorter. Documents are linked if the Jaccard similarity of
    their full sets is at least ``similarity`` per cent; ``component_id`` is the smallest key
    reachable over links, ``kept`` whether that is the row's own. Copies are joined by the hash
    of their set first, so that a group of any size counts as one node. Documents without words
    (or a null text) have no shingles and stand alone. Rows of one key are one document; a null
    key has a null component and is kept. A text of any length is worked on as one slice, in some
    50 bytes a byte of it. Other columns play no part. An empty table gives an empty table.
    """
    named = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = written(sketches(named), "sketches")
    identity = ["set_a", "set_b", "n_shingles"]
    sets = (
        rows.filter("n_shingles > 0 and doc_id is not null")
        .groupBy(*identity)
        .agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"))
    )
    nodes = written(sets, "nodes")
    links = near_links(named, nodes.select("node", "signature"), similarity)
    # A key with several rows ties their sets together.
    found = components(links).withColumnRenamed("component", "_component")
    of_sets = nodes.join(found, "node", "left").select(
        *identity, F.coalesce("_component", "node").alias("component_id")
    )
    out = rows.drop("signature").join(of_sets, identity, "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select(
        "doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept")
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """The documents whose key is the smallest of their component, with all their columns.

    Rows with a null key are kept, and so are all rows of a kept key. Null and blank texts are
    copies of nothing, a text of any length is one set, and an empty table gives an empty table.
    """
    (gone,) = unused(docs, "_gone")
    found = near_duplicates(docs, key, text, similarity).filter("not kept").select(F.col("doc_id").alias(gone))
    return docs.join(found.distinct(), F.col(f"`{key}`") == F.col(gone), "left_anti")
