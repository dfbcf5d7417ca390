"""Quality rules: word and line counts, and a calibrated logistic regression on hashed n-grams."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from antecede.llm import words as W
from antecede.llm.columns import unused

#: Documents fail the base rules below so many words, or from such a share (per cent) of words
#: in repeated eight-word windows on.
MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
#: Buckets of hashed n-grams: the first half for words, the second for characters.
BUCKETS = 1 << 18
#: The model is fitted on at most so many labelled documents of each class.
SAMPLE_PER_CLASS = 2000
#: Documents are kept from this calibrated probability of good quality on.
KEEP_FROM = 0.3
_ROUNDS, _RATE, _PENALTY = 120, 0.3, 1e-4
#: Rows of the sample that are worked on at a time while fitting.
_SLICE_ROWS = 512
# The symbols counted.
SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values between bounds, zero where there are none."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether each hash occurs twice or more in its group."""
    own = W.chain(hashes, group.astype(np.uint64))
    order = np.argsort(own)
    same = own[order][1:] == own[order][:-1]
    out = np.zeros(len(own), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def base_counts(parsed: W.Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The counts that the base rules look at, for every text of a slice."""
    data, at = parsed.data, parsed.at
    texts = len(at) - 1
    n_words = parsed.counts()
    in_word = ~W.SPACE[data]
    whole = (data & 0xC0) != 0x80  # not a later byte of a character

    # Lines: a text begins one, and so does the byte after every line break.
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([at[:-1], breaks + 1]))
    of_line = np.searchsorted(at, starts, side="right") - 1
    inside_text = starts <= at[-1]
    # A line break that ends a text opens an empty line, which has no word and does not count.
    starts, of_line = starts[inside_text], np.minimum(of_line[inside_text], texts - 1)
    ends = np.concatenate([starts[1:], at[-1:]])
    ends = np.minimum(ends, at[1:][of_line])
    ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10) if len(data) else 0)
    words_in = np.searchsorted(parsed.starts, ends) - np.searchsorted(parsed.starts, starts)
    full = np.flatnonzero(words_in > 0)
    line = W.chain(W.hash_spans(data, starts[full], ends[full]), of_line[full].astype(np.uint64))
    _, first = np.unique(line, return_index=True)
    later = np.ones(full.size, bool)
    later[first] = False
    n_dup_lines = np.bincount(of_line[full][later], minlength=texts)

    eight, begin = W.windows(hashes, parsed.first, WINDOW)
    text_of = np.searchsorted(parsed.first, begin, side="right") - 1
    twice = begin[_repeats(eight, text_of)]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    return {
        "n_words": n_words,
        "word_chars": _sums(in_word & whole, at),
        "n_symbols": _sums(_IS_SYMBOL[data], at),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": _sums(np.cumsum(cover[:-1]) > 0, parsed.first),
    }


def features(parsed: W.Words, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, word pairs and character triples: buckets in order, and their bounds by text."""
    half = BUCKETS // 2
    keep = np.uint64(half - 1)
    pairs, begin = W.windows(hashes, parsed.first, 2)
    pair_bounds = np.searchsorted(begin, parsed.first)
    whole = (parsed.data & 0xC0) != 0x80
    chars = np.frombuffer(parsed.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    chars = chars.astype(np.uint64)
    char_at = np.concatenate([[0], np.cumsum(whole)])[parsed.at]
    triples = np.zeros(0, np.uint64)
    if len(chars) >= 3:
        triples = W.mix(chars[:-2] | chars[1:-1] << np.uint64(21) | chars[2:] << np.uint64(42))
    # A text has its length less two triples; those that run into the next text do not count.
    triple_end = np.maximum(char_at[1:] - 2, char_at[:-1])
    number = np.arange(len(triples))
    inside = number < np.repeat(triple_end, np.diff(char_at))[: len(triples)]
    triple_bounds = np.concatenate([[0], np.cumsum(triple_end - char_at[:-1])])
    return [
        ((hashes & keep).astype(np.int64), parsed.first),
        ((pairs & keep).astype(np.int64), pair_bounds),
        ((triples[inside] & keep).astype(np.int64) + half, triple_bounds),
    ]


@dataclass
class Model:
    """Weights of the buckets and the line that turns a score into a log odds."""

    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def scores(self, parsed: W.Words, hashes: np.ndarray) -> np.ndarray:
        """Sum over the kinds of n-grams of the mean weight in a text."""
        out = np.zeros(len(parsed.at) - 1)
        for buckets, bounds in features(parsed, hashes):
            out += _sums(self.weights[buckets], bounds) / np.maximum(np.diff(bounds), 1)
        return out

    def probability(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * scores + self.offset, -50, 50)))


def _platt(scores: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log odds, by Newton's method, with smoothed targets."""
    n1, n0 = max(good.sum(), 1), max((~good).sum(), 1)
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([scores, np.ones_like(scores)], axis=1)
    line = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -50, 50)))
        gradient = x.T @ (weight * (p - target)) + 1e-6 * line
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        line -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(line[0]), float(line[1])


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(label, buckets, values) of the labelled documents that come first by a hash of their key."""
    marked = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("label"))
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    chosen = None
    for value in (0, 1):
        own = marked.filter(F.col("label") == value).orderBy(order, "doc_id").limit(per_class)
        chosen = own if chosen is None else chosen.unionByName(own)
    source = docs.join(F.broadcast(chosen), "doc_id").select("label", "doc_id", "text")

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parsed = W.Words(part.column(2), lower=False)
        kinds = features(parsed, parsed.hashes())
        buckets, values = [], []
        for i in range(part.num_rows):
            own, share = [], []
            for flat, bounds in kinds:
                if bounds[i + 1] > bounds[i]:
                    b, n = np.unique(flat[bounds[i] : bounds[i + 1]], return_counts=True)
                    own.append(b.astype(np.int32))
                    share.append((n / n.sum()).astype(np.float32))
            buckets.append(np.concatenate(own) if own else np.zeros(0, np.int32))
            values.append(np.concatenate(share) if share else np.zeros(0, np.float32))
        columns = [part.column(0), part.column(1), pa.array(buckets, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["label", "doc_id", "buckets", "vals"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(W.map_runs(work), f"label int, doc_id {kind}, buckets array<int>, vals array<float>")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    """A model of (doc_id, text) and labels (doc_id, quality); None without both classes.

    At most ``per_class`` documents of each class are used, chosen by a hash of their key; their
    n-gram shares are computed by tasks and the bounded result is fitted on the driver. A fifth of them
    calibrates the probabilities, weighted to the class ratio of all labels. Labels other than
    0 and 1, or without a document, are left out; of several labels of a document the best counts.
    """
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    totals = dict(labels.filter("quality in (0, 1)").groupBy("quality").count().collect())
    rows = _sample(docs, labels, per_class).toArrow()
    good = rows.column("label").to_numpy() == 1
    if good.all() or not good.any():
        return None
    # Rows in the order of their keys, a bounded slice of entries at a time: sums come out the same
    # in every run, and the driver holds the sample once.
    order = pc.sort_indices(rows, [("doc_id", "ascending")])
    good, rows = good[order.to_numpy()], rows.select(["buckets", "vals"])
    slices = []
    for begin in range(0, len(good), _SLICE_ROWS):
        part = rows.take(order[begin : begin + _SLICE_ROWS]).combine_chunks()
        buckets, values = part.column("buckets").combine_chunks(), part.column("vals").combine_chunks()
        row = np.repeat(np.arange(len(buckets), dtype=np.int32), np.diff(buckets.offsets.to_numpy()))
        slices.append((slice(begin, begin + len(buckets)), row, buckets.flatten().to_numpy(), values.flatten().to_numpy()))
    del rows, part, buckets, values
    held = np.zeros(len(good), bool)
    for own in (np.flatnonzero(good), np.flatnonzero(~good)):  # every fifth, if there are that many
        held[own[4::5]] = True
    train = ~held
    weight = np.where(good, 0.5 / max((good & train).sum(), 1), 0.5 / max((~good & train).sum(), 1)) * train
    seen = np.zeros(BUCKETS, bool)
    for _, _, index, _ in slices:
        seen[index] = True
    used = max(np.count_nonzero(seen), 1)

    def scores(w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(good))
        for rows_, row, index, value in slices:
            out[rows_] = np.bincount(row, value * w[index], rows_.stop - rows_.start)
        return out

    # Adam on the penalised mean log loss; both classes count alike.
    w, first, second = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    bias, bias_first, bias_second = 0.0, 0.0, 0.0
    for step in range(1, _ROUNDS + 1):
        error = weight * (1 / (1 + np.exp(-np.clip(scores(w) + bias, -50, 50))) - good)
        slope = _PENALTY / used * w
        for rows_, row, index, value in slices:
            slope += np.bincount(index, value * error[rows_][row], BUCKETS)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        rate = _RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w -= rate * first / (np.sqrt(second) + 1e-9)
        bias_slope = error.sum()
        bias_first, bias_second = 0.9 * bias_first + 0.1 * bias_slope, 0.99 * bias_second + 0.01 * bias_slope**2
        bias -= rate * bias_first / (np.sqrt(bias_second) + 1e-9)
    score = scores(w)
    check = held if (good & held).any() and (~good & held).any() else np.ones(len(good), bool)
    share = np.where(good, totals.get(1, 1) / (good & check).sum(), totals.get(0, 1) / (~good & check).sum())
    slope, offset = _platt(score[check], good[check], (share / share[check].sum())[check] * check.sum())
    return Model(w.astype(np.float32), slope, offset)


def quality(
    docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep_from: float = KEEP_FROM
) -> DataFrame:
    """Per row: key, base counts, ``base_failed``, ``probability`` of good quality, and ``kept``.

    Words are runs of characters other than white space, as written. ``n_words``;
    ``word_chars``, the characters in words; ``n_symbols``; ``n_dup_lines``, lines with a word
    that equal an earlier line; ``n_repeat_words``, words in eight-word windows that the text
    has twice or more. The base rules fail a text of under 20 words, or with over 30 per cent of repeated
    words. Others are kept if the model gives at least ``keep_from``, or if there is no model
    (null probability). A null text counts as empty; rows with null or repeated keys are judged
    each by itself; a text of any length is judged as a whole; an empty table gives an empty table.
    """
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parsed = W.Words(part.column(1), lower=False)
        hashes = parsed.hashes()
        counts = base_counts(parsed, hashes)
        failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED * counts["n_words"])
        if shared.value is None:
            probability, kept = pa.nulls(part.num_rows, pa.float64()), ~failed
        else:
            p = shared.value.probability(shared.value.scores(parsed, hashes))
            probability, kept = pa.array(p), ~failed & (p >= keep_from)
        columns = [part.column(0), *[pa.array(x.astype(np.int64)) for x in counts.values()]]
        columns += [pa.array(failed), probability, pa.array(kept)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *counts, "base_failed", "probability", "kept"])

    schema = (
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, probability double, kept boolean"
    )
    return source.mapInArrow(W.map_runs(work), schema)


def keep_good(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns and in place.

    The verdict is taken row by row within the task, so rows with null or repeated keys are
    judged by their own text and nothing is shuffled. A null text counts as empty (and so fails), a
    text of any length is judged as a whole, columns may have any names, and an empty table gives
    an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parsed = W.Words(part.column(part.num_columns - 1), lower=False)
        hashes = parsed.hashes()
        counts = base_counts(parsed, hashes)
        kept = (counts["n_words"] >= MIN_WORDS) & (100 * counts["n_repeat_words"] <= MAX_REPEATED * counts["n_words"])
        if shared.value is not None:
            kept &= shared.value.probability(shared.value.scores(parsed, hashes)) >= KEEP_FROM
        rows = part.take(pa.array(np.flatnonzero(kept)))
        yield pa.RecordBatch.from_arrays(rows.columns[:-1], names=names)

    names = docs.columns
    (held,) = unused(docs, "_quality_text")
    tagged = docs.select("*", F.col(f"`{text}`").cast("string").alias(held))
    return tagged.mapInArrow(W.map_runs(work, held), docs.schema)
