"""A quality classifier: perplexity under an n-gram model fitted on trusted text.

The model is interpolated modified Kneser-Ney over the bytes of UTF-8 texts, of order 5. An
n-gram is the 64-bit number of its bytes, so keys are exact, the history of an n-gram is its
number without the last byte and its lower-order part a mask. A text is read with four start
bytes before it and an end byte after it.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from antecede.llm import words as W
from antecede.session import written

ORDER = 5
#: One of so many trusted documents is held out of the fit, to set the thresholds.
HELD_OUT = 5
#: Documents are kept up to this quantile of the held-out perplexities of their language.
QUANTILE = 0.995
#: A language's own quantile, or a length band's, has half the weight at so many held-out documents.
LEAST_HELD = 100
#: Entries of the model that are sent to the tasks at a time.
SHARD_ENTRIES = 1 << 22
_START, _END, _SYMBOLS = 2, 3, 257


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 5-grams that end at every byte of every text and at its end, and their bounds."""
    data, at = W.raw_texts(column)
    texts, pad = len(at) - 1, ORDER - 1
    lengths = np.diff(at)
    begin = at[:-1] + np.arange(texts) * (pad + 1) + pad
    joined = np.full(len(data) + texts * (pad + 1), _START, np.uint64)
    joined[np.repeat(begin - at[:-1], lengths) + np.arange(len(data))] = data
    joined[begin + lengths] = _END
    keys = np.zeros(max(len(joined) - pad, 0), np.uint64)
    for k in range(ORDER):
        keys |= joined[k : len(joined) - pad + k] << np.uint64(8 * (pad - k))
    # The key at i ends at byte i + pad; a text has one for each byte and one for its end.
    bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
    own = np.repeat(begin - pad - bounds[:-1], lengths + 1) + np.arange(bounds[-1])
    return keys[own], bounds


def count_grams(docs: DataFrame) -> DataFrame:
    """(g, c): how often each 5-gram occurs in the texts of (..., text)."""

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        place, keys = pd.factorize(_grams(part.column(0))[0].view(np.int64))
        counts = np.bincount(place, minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["g", "c"])

    rows = docs.select(F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(W.map_runs(work), "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def _mask(k: int) -> int:
    return (1 << (8 * k)) - 1


def _code(kind: int, k: int):
    """Tag of a table of the model, above the bits of an n-gram."""
    return (2 * k + kind) << 48


def _discounts(grams: DataFrame) -> list[float]:
    """Discounts for counts of 1, 2, and 3 or more, from how many n-grams occur how often."""
    ns = dict(grams.filter("c <= 4").groupBy("c").count().collect())
    n1, n2, n3, n4 = (max(ns.get(i, 0), 1) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), (i + 1) * 0.95) for i, d in enumerate(found)]


def fit(trusted: DataFrame) -> DataFrame:
    """The model of the texts of ``trusted`` as (code, value), written to the shared folder.

    The highest order counts occurrences, lower orders the distinct bytes before an n-gram.
    Every order's n-grams are joined to their history (total, and how many follow it once,
    twice or more) and to their lower-order probability: joins of count tables, hash-partitioned by
    Spark. Values are in back-off form: under code (k, 0) what the n-gram adds to the log
    probability of the order below, under (k, 1) the logarithm of what its history leaves for
    the order below. The log probability of a byte is the sum of the values found for it.
    """
    grams = {ORDER: written(count_grams(trusted), "grams")}
    for k in range(ORDER - 1, 0, -1):
        lower = F.col("g").bitwiseAND(F.lit(_mask(k)))
        grams[k] = written(grams[k + 1].groupBy(lower.alias("g")).agg(F.count(F.lit(1)).alias("c")), "grams")
    entries, below = [], None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(grams[k])
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        own = grams[k].withColumn("h", F.shiftright("g", 8))
        left = F.sum(cut) / F.sum("c")
        histories = own.groupBy("h").agg(F.sum("c").alias("total"), left.alias("left"))
        rows = own.join(histories, "h").withColumn("s", F.col("g").bitwiseAND(F.lit(_mask(k - 1))))
        if below is None:
            rows = rows.withColumn("q", F.lit(1 / _SYMBOLS))
        else:
            rows = rows.join(below.select(F.col("g").alias("s"), F.col("p").alias("q")), "s")
        p = (F.col("c") - cut) / F.col("total") + F.col("left") * F.col("q")
        below = written(rows.select("g", p.alias("p"), "left", "q"), "probabilities")
        added = F.log("p") - F.log("left") - F.log("q")
        entries.append(below.select((F.col("g") + _code(0, k)).alias("code"), added.alias("value")))
        entries.append(histories.select((F.col("h") + _code(1, k)).alias("code"), F.log("left").alias("value")))
    model = entries[0]
    for part in entries[1:]:
        model = model.unionByName(part)
    return written(model, "model")


def _partial_scores(docs: DataFrame, codes: np.ndarray, values: np.ndarray) -> DataFrame:
    """(row_key, lang, n, part): symbols of every text and the values that these entries add to it."""
    shared = docs.sparkSession.sparkContext.broadcast((codes, values))

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codes, values = shared.value
        keys, bounds = _grams(part.column(1))
        place, distinct = pd.factorize(keys.view(np.int64))
        scores = np.zeros(len(distinct))
        for k in range(1, ORDER + 1):
            low = distinct & _mask(k)
            for wanted in (low + _code(0, k), (low >> 8) + _code(1, k)):
                at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1) if len(codes) else None
                if at is not None:
                    scores += np.where(codes[at] == wanted, values[at], 0)
        total = np.add.reduceat(scores[place], bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
        columns = [part.column(0), part.column(2), pa.array(np.diff(bounds)), pa.array(total)]
        yield pa.RecordBatch.from_arrays(columns, names=["row_key", "lang", "n", "part"])

    kind = docs.schema["row_key"].dataType.simpleString()
    rows = docs.select("row_key", "text", "lang")
    return rows.mapInArrow(W.map_runs(work), f"row_key {kind}, lang string, n long, part double")


def _shards(model: DataFrame, entries: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The model in shards of about ``entries`` entries, by a hash of the code, each sorted."""
    count = model.count()
    n = max(1, -(-count // entries))
    for shard in range(n):
        rows = model.filter(F.pmod(F.xxhash64("code"), F.lit(n)) == shard).toArrow()
        codes, values = rows.column("code").to_numpy(), rows.column("value").to_numpy()
        order = np.argsort(codes)
        yield codes[order], values[order].astype(np.float32)


def scores(docs: DataFrame, model: DataFrame, entries: int = SHARD_ENTRIES) -> DataFrame:
    """(row_key, lang, n, logp) of (row_key, text, lang): symbols of a text and its log probability.

    A shard of the model holds about ``entries`` entries whatever the size of the data, and is
    broadcast; each shard adds its part in one pass over the texts, which are not shuffled. A
    byte that no entry is found for has the uniform probability.
    """
    parts = None
    for codes, values in _shards(model, entries):
        own = _partial_scores(docs, codes, values)
        parts = own if parts is None else parts.unionByName(own)
    summed = parts.groupBy("row_key").agg(
        F.min("lang").alias("lang"), F.max("n").alias("n"), F.sum("part").alias("logp")
    )
    return summed.withColumn("logp", F.col("logp") - F.col("n") * float(np.log(_SYMBOLS)))


def classify(docs: DataFrame, labels: DataFrame, held_out: int = HELD_OUT, quantile: float = QUANTILE) -> DataFrame:
    """Per document (doc_id, lang, n_bytes, perplexity, threshold, kept).

    ``docs`` has doc_id, text and lang, ``labels`` doc_id and quality; documents with quality 1
    are trusted. Four fifths of them fit the model, the others (by a hash of the key, and the
    first by that hash of every language) set the thresholds: a quantile of the log perplexity per byte,
    by language and length band (the power of two below the number of bytes). With n held-out documents
    a language's own quantile has the weight n / (n + ``LEAST_HELD``) and its median, with the
    quantile of all documents' distances from the medians of their languages (times sqrt(1 + 1 / n)), the rest; a band's own quantile is
    blended with its language's threshold likewise. A language without trusted text has the
    quantile over all. A document is kept up to its threshold. There is none from below: texts that
    the model was fitted on lie lower than others, and junk was not found to.
    Without trusted text all is kept and perplexity is that of even odds. Null
    texts count as empty, a null language is a language. Rows with the same key are scored as
    one document (the longest's symbols, all their bytes), rows with a null key likewise.
    """
    named = docs.select(
        F.col("doc_id").alias("row_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "lang"
    )
    trusted_ids = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("row_key")).distinct()
    place = F.xxhash64(F.col("row_key").cast("string"), F.lit("held out"))
    # Every language with trusted text has a held-out document.
    of_languages = named.select("row_key", "lang").join(trusted_ids, "row_key", "left_semi").groupBy("lang")
    firsts = of_languages.agg(F.min_by("row_key", place).alias("row_key")).select("row_key")
    dealt = trusted_ids.filter(F.pmod(place, F.lit(held_out)) == 0)
    out_ids = written(dealt.unionByName(firsts).distinct(), "held-out")
    # One plan at every size: texts are dealt by key once, however few the labels are.
    fit_ids = trusted_ids.join(out_ids, "row_key", "left_anti")
    trusted = named.join(fit_ids.hint("merge"), "row_key", "left_semi")
    model = fit(trusted)

    rows = scores(named, model).select(
        "row_key",
        "lang",
        "n",
        F.exp(-F.col("logp") / F.col("n")).alias("perplexity"),
        F.floor(F.log2("n")).alias("band"),
    )
    rows = written(rows, "scores")

    held = rows.join(out_ids, "row_key", "left_semi").withColumn("x", F.log("perplexity"))

    def at(value: str, share: float = quantile) -> Column:
        return F.percentile_approx(value, share, 100_000)

    def blended(own: str, n: str, other: Column) -> Column:
        return F.col(own) + (other - F.col(own)) * LEAST_HELD / (F.col(n) + LEAST_HELD)

    language = held.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"), at("x").alias("_q"), at("x", 0.5).alias("_m"))
    language = language.withColumnRenamed("lang", "_l2")
    same = F.col("lang").eqNullSafe(F.col("_l2"))
    apart = held.join(language.select("_l2", "_m"), same).agg(at("x"), F.percentile_approx(F.col("x") - F.col("_m"), quantile, 100_000))
    overall, spread = apart.first()
    language = language.select("_l2", blended("_q", "_n", F.col("_m") + F.lit(spread).cast("double") * F.sqrt(1 + 1 / F.col("_n"))).alias("by_lang"))
    both = held.groupBy(F.col("lang").alias("_l"), F.col("band").alias("_b")).agg(F.count(F.lit(1)).alias("_k"), at("x").alias("_qb"))
    by_band = F.coalesce(blended("_qb", "_k", F.col("by_lang")), "by_lang", F.lit(overall).cast("double"))
    out = (
        rows.join(both, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("band") == F.col("_b")), "left")
        .join(language, same, "left")
        .withColumn("threshold", F.exp(by_band))
    )
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select(
        F.col("row_key").alias("doc_id"), "lang", (F.col("n") - 1).alias("n_bytes"), "perplexity", "threshold", kept.alias("kept")
    )
