"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Word pairs of the training texts are counted, and each count c is kept as its level
1 + floor(log2 c): a pair is put into a Bloom filter once for each level up to its own. Its
level is read back by probing for level 1, 2, ... until one is missing, so a count may come out
too high, at a rate the filter's bits for each entry fix, and never too low. A level stands for the mean
count of the training pairs that have it. Counts of single words are not quantised, as the base
score needs them exactly anyway: those of the most frequent words are broadcast, a table of bounded size, and
those of all others are joined.
"""

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from antecede.llm import words as W
from antecede.session import written

#: Bits and probes for each entry of the filter: a wrong hit in 2.4 per cent of the probes.
BITS, PROBES = 8, 4
LEVELS = 40
#: Word pairs of a shard of the filter, by the bytes of training text there are for one.
SHARD_BYTES = 8 << 20
#: Bytes of word-pair filter that are broadcast at a time; more are scored in further passes.
PART_BYTES = 96 << 20
#: Words whose counts are broadcast, the most frequent ones; those of others are joined.
HEAD_WORDS = 1 << 20
#: Weights of the single-word model against a pair's count, of which the best one is taken.
PRIORS = (1.0, 10.0, 100.0, 1e3, 1e4, 1e5, 1e6, 1e8)
_BUFFER = 1 << 20
#: Texts are scored in slices of about so many bytes, as each token takes some 200 bytes meanwhile.
_SLICE_BYTES = 1 << 20
_STEP = 16  # buckets of counts for each doubling
_END, _BEGIN = W.constants(2, 5)
_G1, _G2, _PAIR = W.constants(3, 55)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text with an end after it, and their bounds."""
    parsed = W.Words(column)
    counts = parsed.counts()
    bounds = parsed.first + np.arange(len(parsed.first))
    out = np.full(bounds[-1], _END, np.uint64)
    out[np.arange(len(parsed.starts)) + parsed.text_of()] = parsed.hashes()
    return out, bounds


def _contexts(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = _BEGIN
    return before


def _pairs(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return W.chain(W.chain(before, np.full(1, _PAIR)), tokens)


class Filter:
    """A log-frequency Bloom filter in shards, each with as many bits as its entries need."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes = sizes.astype(np.uint64)
        self.begin = (np.cumsum(sizes) - sizes).astype(np.uint64)
        self.bits = bits

    @staticmethod
    def places(hashes: np.ndarray, level: int) -> list[np.ndarray]:
        one, two = W.mix(hashes ^ _G1), W.mix(hashes ^ _G2) | np.uint64(1)
        return [one + np.uint64(level * PROBES + k) * two for k in range(PROBES)]

    @staticmethod
    def fill(hashes: np.ndarray, levels: np.ndarray, bits: float = BITS) -> tuple[int, np.ndarray]:
        """Size and bits of a shard that holds these n-grams with these levels."""
        size = max(64, math.ceil(int(levels.sum()) * bits / 64) * 64)
        flags = np.zeros(size, bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            for place in Filter.places(hashes[levels >= level], level):
                flags[(place % np.uint64(size)).astype(np.int64)] = True
        return size, np.packbits(flags, bitorder="little")

    def levels(self, hashes: np.ndarray, shards: np.ndarray) -> np.ndarray:
        """The level of every n-gram, 0 if the filter doesn't have it."""
        out = np.zeros(len(hashes), np.int8)
        if not len(self.bits):
            return out
        alive = np.flatnonzero(self.sizes[shards] > 0)
        for level in range(1, LEVELS + 1):
            if not alive.size:
                break
            size, begin = self.sizes[shards[alive]], self.begin[shards[alive]]
            there = np.ones(alive.size, bool)
            for place in self.places(hashes[alive], level):
                bit = place % size + begin
                there &= (self.bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
            alive = alive[there]
            out[alive] = level
        return out


def count_words(training: DataFrame) -> DataFrame:
    """(h, c): hash and count of every training token, the end of a text included."""

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        place, found = pd.factorize(_tokens(part.column(0))[0].view(np.int64))
        counts = np.bincount(place, minlength=len(found))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], names=["h", "c"])

    return training.select("text").mapInArrow(W.map_runs(work), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _packed_pairs(training: DataFrame, shards: int) -> DataFrame:
    """(shard, hashes, counts): word pairs with their counts, packed by shard in each task.

    A task adds up the pairs of about ``_BUFFER`` tokens before it hands them on.
    """

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        of = (found % np.uint64(shards)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        found, counts, of = found[order], counts[order].astype(np.uint32), of[order]
        used, first = np.unique(of, return_index=True)
        ends = np.append(first[1:], len(of))
        columns = [
            pa.array(used),
            pa.array([found[a:z].tobytes() for a, z in zip(first, ends)], pa.binary()),
            pa.array([counts[a:z].tobytes() for a, z in zip(first, ends)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "hashes", "counts"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in W.runs(batch, "text", _SLICE_BYTES):
                tokens, bounds = _tokens(part.column(0))
                held.append(_pairs(_contexts(tokens, bounds), tokens))
                size += len(tokens)
                if size >= _BUFFER:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return training.select("text").mapInArrow(work, "shard long, hashes binary, counts binary")


_SLICE = "shard long, size long, bits binary, level_n array<long>, level_c array<long>"


def _slice(shard: int, hashes: np.ndarray, counts: np.ndarray, bits: float) -> pa.Table:
    levels = np.minimum(np.floor(np.log2(counts)).astype(np.int64) + 1, LEVELS)
    size, filled = Filter.fill(hashes, levels, bits)
    n = np.bincount(levels, minlength=LEVELS + 1)
    c = np.bincount(levels, counts, LEVELS + 1).astype(np.int64)
    return pa.table(
        {
            "shard": pa.array([shard], pa.int64()),
            "size": pa.array([size], pa.int64()),
            "bits": pa.array([filled.tobytes()], pa.binary()),
            "level_n": pa.array([n], pa.list_(pa.int64())),
            "level_c": pa.array([c], pa.list_(pa.int64())),
        }
    )


def _pair_slices(training: DataFrame, shards: int, bits: float) -> DataFrame:
    """One row per shard: its part of the filter, and how many pairs and tokens each level has."""

    def build(rows: pa.Table) -> pa.Table:
        hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("counts").to_pylist()])
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        return _slice(rows.column("shard")[0].as_py(), hashes[first], np.add.reduceat(counts, first), bits)

    return _packed_pairs(training, shards).groupBy("shard").applyInArrow(build, _SLICE)


def _collected(slices: DataFrame, shards: int, low: int, high: int) -> Filter:
    """The shards from ``low`` up to ``high`` as one filter; the others are empty in it."""
    rows = slices.filter(F.col("shard").between(low, high - 1)).select("shard", "size", "bits").orderBy("shard").toArrow()
    sizes = np.zeros(shards, np.int64)
    sizes[rows.column("shard").to_numpy()] = rows.column("size").to_numpy()
    parts = [np.frombuffer(x.as_buffer(), np.uint8) for chunk in rows.column("bits").chunks for x in chunk]
    return Filter(sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint8))


def _level_means(slices: DataFrame) -> np.ndarray:
    """The mean count of each level's n-grams.

    A level that none has, read by error, stands for half as much again as its least count, but
    for no more than the highest level that some have.
    """
    sums = slices.select(F.posexplode(F.arrays_zip("level_n", "level_c")).alias("level", "s")).groupBy("level")
    means = np.concatenate([[0.0], 1.5 * 2.0 ** np.arange(LEVELS)])
    top = 0
    for level, n, c in sums.agg(F.sum("s.level_n"), F.sum("s.level_c")).collect():
        if n:
            means[level] = c / n
            top = max(top, level)
    means[top + 1 :] = means[top]
    return means


def _tails(docs: DataFrame, rare: DataFrame, head: Broadcast) -> DataFrame:
    """(mark, tail): the words of each text that are not in the head, with their counts.

    Texts are told apart by a hash, ``mark``, so copies of one are looked up once, and a row lists
    the words of one text at most. Words that training does not have are left out.
    """

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens, bounds = _tokens(part.column(1))
        held = head.value[0]
        place, found = pd.factorize(tokens.view(np.int64))
        found = found.view(np.uint64)
        at = np.minimum(np.searchsorted(held, found), max(len(held) - 1, 0))
        beyond = (held[at] != found) if len(held) else np.ones(len(found), bool)
        lists = [np.unique(tokens[a:z][beyond[place[a:z]]]).view(np.int64) for a, z in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["mark", "words"])

    found = docs.select("mark", "text").mapInArrow(W.map_runs(work, max_bytes=_SLICE_BYTES), "mark string, words array<long>")
    once = found.filter(F.size("words") > 0).groupBy("mark").agg(F.first("words").alias("words"))
    listed = once.select("mark", F.explode("words").alias("h")).join(rare, "h")
    return listed.groupBy("mark").agg(F.collect_list(F.struct("h", "c")).alias("tail"))


class Model:
    """What a task needs to score texts with one part of the filter."""

    def __init__(self, head: tuple[np.ndarray, np.ndarray], part: "Part"):
        self.head_hashes, self.head_counts = head
        self.part = part

    def _words(self, hashes: np.ndarray, tail: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Counts of distinct words, from the head and from what the texts bring along."""
        counts = np.zeros(len(hashes))
        for known, own in ((self.head_hashes, self.head_counts), tail):
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                counts += np.where(known[at] == hashes, own[at], 0)
        return counts

    def _single(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, (1 - self.part.unseen) * counts / max(self.part.n, 1), self.part.unseen)

    def score(self, column: pa.Array, held: np.ndarray, tails: pa.Array) -> dict[str, np.ndarray]:
        """Sums over the tokens of this part, for every text of a slice."""
        tokens, bounds = _tokens(column)
        before = _contexts(tokens, bounds)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        pairs = _pairs(before, tokens)
        part = self.part
        shards = (pairs % np.uint64(part.shards)).astype(np.int64)
        own = np.flatnonzero((shards >= part.low) & (shards < part.high))
        if own.size < len(tokens):
            tokens, before, text, pairs, shards = (x[own] for x in (tokens, before, text, pairs, shards))
        texts = len(bounds) - 1
        listed = tails.flatten()
        known, first = np.unique(listed.field("h").to_numpy().view(np.uint64), return_index=True)
        tail = known, listed.field("c").to_numpy()[first]
        place, distinct = pd.factorize(np.concatenate([tokens, before]).view(np.int64))
        distinct = distinct.view(np.uint64)
        counts = self._words(distinct, tail)
        context_counts = np.where(distinct == _BEGIN, part.ends, counts)
        word, context = place[: len(tokens)], place[len(tokens) :]
        c1, ch = counts[word], context_counts[context]
        c2 = np.minimum(part.means[part.pairs.levels(pairs, shards)], np.minimum(c1, ch))

        total = lambda x: np.bincount(text, x, texts).astype(np.float64)
        out: dict = {"n_tokens": np.bincount(text, minlength=texts)}
        floor = part.n + 0.1 * (part.v + 1)
        out["n_known"] = np.bincount(text[c1 > 0], minlength=texts)
        logs = np.log10((counts + 0.1) / floor) if floor > 0 else np.zeros(len(counts))
        out["base"] = total(logs[word])
        single = self._single(counts)[word]
        # Without this one occurrence, to choose the prior on training texts.
        trained = ~held[text]
        less_single = self._single(np.maximum(counts - 1, 0))[word]
        less_c2, less_ch = np.maximum(c2 - 1, 0), np.maximum(ch - 1, 0)
        for k, prior in enumerate(PRIORS):
            out[f"s{k}"] = total(np.log10((c2 + prior * single) / (ch + prior)))
            out[f"l{k}"] = total(np.where(trained, np.log10((less_c2 + prior * less_single) / (less_ch + prior)), 0))
        return out


class Part:
    """A part of the filter: its shards from ``low`` up to ``high``, and what the formula needs besides."""

    def __init__(self, pairs: Filter, means: np.ndarray, shards: int, low: int, high: int, n: int, v: int, n1: int, ends: int):
        self.pairs, self.means = pairs, means
        self.shards, self.low, self.high = shards, low, high
        self.n, self.v, self.ends = n, v, ends
        #: The chance of a word that was never seen: that of one seen once, by Good and Turing.
        self.unseen = min(max(n1 / n, 1e-9), 0.5) if n else 1.0


def score_documents(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score, prior.

    Texts are lower-cased (A-Z), their tokens are words and one end. Training texts are those
    that ``held_out`` is not true for. ``base_score`` is the sum of log10((c + 0.1) / (N + 0.1 (V + 1)))
    by exact training counts: the most frequent words' are broadcast (at most ``HEAD_WORDS``),
    those of all others come with the text, by a join. ``n_known`` counts tokens with c > 0.

    ``score`` is the sum of log10 (c(h, w) + prior * p(w)) / (c(h) + prior), where h is the word
    before (the begin of a text counts as often as its end); p(w) is the share of w less that of unseen
    words, which get the Good-Turing share together. c(h, w) is read from the filter, and is no more
    than c(h) or c(w). ``prior`` is the one of ``PRIORS`` that serves the training texts best when
    each token is left out of its own counts.

    The filter is built by shard, with ``BITS`` for each entry at every size, so it grows with the
    training texts; it is broadcast in parts of at most ``PART_BYTES``, one after the other, and each part scores the
    tokens whose pair it is in charge of, in one pass. Null texts count as empty (one end); a text
    of any length is scored in one slice, in some 200 bytes a token. Rows of one key are scored as one document; a
    null key is a key. Other columns play no part. An empty table gives an empty table; without training texts N
    and V are 0, nothing is known and scores are those of an unseen word each.
    """
    named = docs.select(
        F.col(f"`{key}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    training = named.filter(~F.col("held_out"))
    words = written(count_words(training), "words")
    context = docs.sparkSession.sparkContext

    # Frequent words: a threshold from the numbers of words by size of count.
    size = F.floor(F.log2("c") * _STEP)
    by_size = words.groupBy(size.alias("size")).agg(F.count(F.lit(1)), F.sum("c")).collect()
    n, v = sum(r[2] for r in by_size), sum(r[1] for r in by_size)
    n1 = sum(r[1] for r in by_size if r[0] == 0)
    ends = words.filter(F.col("h") == int(_END.view(np.int64))).agg(F.sum("c")).first()[0] or 0
    least, room = math.inf, HEAD_WORDS
    for at, count, _ in sorted(by_size, reverse=True):
        room -= count
        if room < 0:
            break
        least = at
    is_head = (size >= least) if least < math.inf else F.lit(False)
    top = words.filter(is_head).toArrow()
    order = np.argsort(top.column("h").to_numpy().view(np.uint64))
    head = context.broadcast((top.column("h").to_numpy().view(np.uint64)[order], top.column("c").to_numpy()[order]))
    rare = words.filter(~is_head)
    no_tail = F.lit(None).cast("array<struct<h:bigint,c:bigint>>")
    asked = named.withColumn("tail", no_tail)
    if top.num_rows < v:
        marked = named.withColumn("mark", F.md5("text"))
        asked = written(marked.join(_tails(marked, rare, head), "mark", "left").drop("mark"), "asked")

    volume = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-volume // SHARD_BYTES))
    slices = written(_pair_slices(training, shards, BITS), "pair-filter")
    means = _level_means(slices)
    filter_bytes = (slices.agg(F.sum("size")).first()[0] or 0) // 8
    parts = max(1, -(-filter_bytes // PART_BYTES))
    edges = [round(i * shards / parts) for i in range(parts + 1)]

    sums = ["n_tokens", "n_known", "base", *[f"{x}{k}" for k in range(len(PRIORS)) for x in "sl"]]
    kind = named.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, " + ", ".join(
        f"{c} double" for c in sums[2:]
    )
    passes = []
    for low, high in zip(edges, edges[1:]):
        part = Part(_collected(slices, shards, low, high), means, shards, low, high, n, v, n1, ends)
        shared = context.broadcast(part)
        del part

        def work(rows: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            held = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
            found = Model(head.value, shared.value).score(rows.column(1), held, rows.column(3))
            columns = [rows.column(0), rows.column(2), *[pa.array(found[c]) for c in sums]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", *sums])

        own = asked.select("doc_id", "text", "held_out", "tail")
        passes.append(written(own.mapInArrow(W.map_runs(work, max_bytes=_SLICE_BYTES), schema), "scored"))
        shared.destroy()
    scored = reduce(DataFrame.unionByName, passes)

    totals = scored.agg(*[F.sum(f"l{k}") for k in range(len(PRIORS))]).first()
    best = max(range(len(PRIORS)), key=lambda k: totals[k] if totals[k] is not None else 0.0)
    return scored.groupBy("doc_id").agg(
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        F.sum("base").alias("base_score"),
        F.sum(f"s{best}").alias("score"),
        F.lit(PRIORS[best]).alias("prior"),
    )
