"""Token vectors: encoding, alignment of spans, pooling and pair features."""

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from antecede.functions import text as tx
from antecede.functions.numeric import dot, times
from antecede.operators import lookup
from antecede.session import written


def lookup_encoder(vectors: DataFrame, names: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """Encoder that takes each token's vector from a table (token_id, vector).

    With ``names`` (token_id, name), whose name may be any column, the table is one of (name, vector), in which
    tokens share a vector. ``packed`` gives the same vectors without one for each place of a token: rows with
    arrays ``pos`` and ``ref``, and the vectors (ref, vector) that they refer to.
    """
    name = names.columns[1] if names is not None else "token_id"

    def encode(df: DataFrame) -> DataFrame:
        keys = [c for c in df.columns if c != "ids"]
        exploded = df.select(*keys, F.posexplode("ids").alias("pos", "token_id"))
        unpadded = exploded.filter(F.col("token_id") > 0)
        named = unpadded if names is None else unpadded.join(names, "token_id")
        return gather_vectors(named, vectors, name).select(*keys, "pos", "token_id", "vector")

    @functools.cache
    def tables() -> tuple[DataFrame, DataFrame]:
        """(token_id, ref) and (ref, vector)."""
        rows = numbered(vectors)
        refs = rows.select(name, "ref") if names is None else names.join(rows.select(name, "ref"), name)
        return written(refs.select("token_id", "ref").filter(F.col("token_id") > 0), "refs"), rows.select("ref", "vector")

    def packed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        refs, rows = tables()
        chunks = lookup.coded(df, "ids")
        known = gather_vectors(lookup.listed(chunks, "token_id"), refs, "token_id")
        known = written(known.select("id_chunk", "_code", "ref"), "known")
        keys = [c for c in df.columns if c != "ids"]
        found = lookup.placed(chunks, known).select(*keys, F.col("_pos").alias("pos"), "ref")
        return found.filter(F.size("pos") > 0), rows.join(known.select("ref").distinct(), "ref")

    encode.packed = packed
    return encode


def numbered(vectors: DataFrame) -> DataFrame:
    """The rows of a vector table, written, with a number ``ref`` that can stand for the vector."""
    return written(vectors.withColumn("ref", F.monotonically_increasing_id()), "numbered")


def model_encoder(
    load: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]],
    key: str,
    key_type: str = "string",
    batch_size: int = 32,
    layers: bool = False,
) -> Callable[[DataFrame], DataFrame]:
    """Encoder that runs a model over Arrow batches, loaded once per task.

    ``load()`` returns a function of padded ids and attention mask, both (rows, width), to
    vectors (rows, width, dims), or with ``layers`` to those of all layers, (layers, rows, width,
    dims), from which ``select_layers`` picks. Values are single-precision floats from the model
    to the table. The mask is ids > 0; masked places give no row, and a text without ids has none. At most
    ``batch_size`` texts are held as vectors at a time.
    """

    def nested(values: np.ndarray) -> pa.Array:
        """(rows, dims), or (layers, rows, dims), as one list, or one list of layers, for each row."""
        flat = values if values.ndim == 2 else values.transpose(1, 0, 2).reshape(-1, values.shape[-1])
        ends = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[-1])
        lists = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(flat).ravel()))
        if values.ndim == 2:
            return lists
        ends = pa.array(np.arange(values.shape[1] + 1, dtype=np.int32) * values.shape[0])
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([lists], names=["values"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            for first in range(0, batch.num_rows, batch_size):
                part = batch.slice(first, batch_size)
                lengths = part.column(1).value_lengths().fill_null(0).to_numpy()
                ids = np.zeros((part.num_rows, max(int(lengths.max()), 1)), dtype=np.int64)
                ids[np.arange(ids.shape[1]) < lengths[:, None]] = part.column(1).flatten().to_numpy()
                mask = ids > 0
                rows, places = np.nonzero(mask)
                if not rows.size:
                    continue
                vectors = np.asarray(model(ids, mask.astype(np.int64)), dtype=np.float32)
                columns = [
                    part.column(0).take(pa.array(rows)),
                    pa.array(places.astype(np.int32)),
                    pa.array(ids[rows, places].astype(np.int32)),
                    nested(vectors[..., rows, places, :]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "pos", "token_id", made])

    made = "layers" if layers else "vector"
    kind = "array<struct<values:array<float>>>" if layers else "array<float>"
    schema = f"{key} {key_type}, pos int, token_id int, {made} {kind}"
    return lambda df: df.select(key, "ids").mapInArrow(run, schema)


def encode_batches(
    df: DataFrame,
    encoder: Callable[[DataFrame], DataFrame],
    width: int | None = None,
    overlap: int = 64,
) -> DataFrame:
    """Vectors of all unpadded tokens, one row per (id, pos).

    With a model of limited ``width``, sequences are encoded in windows of that many tokens
    that share ``overlap`` of them. The encoder sees (key, ids), the key being a text of id and
    window; each token's vector is taken from the window in which it is farther from an edge.
    """
    if width is None:
        return encoder(df.select("id", "ids"))
    if not 0 <= overlap < width:
        raise ValueError("windows must be wider than their overlap")
    step, half = width - overlap, overlap // 2
    count = F.greatest(F.ceil((F.size("ids") - overlap) / step), F.lit(1)).cast("int")
    numbers = F.sequence(F.lit(0), count - 1)
    window = F.col("_window")
    parts = df.select("id", "ids", count.alias("_windows"), F.explode(numbers).alias("_window")).select(
        F.concat_ws("|", F.col("id").cast("string"), window.cast("string"), F.col("_windows").cast("string")).alias("id"),
        F.slice("ids", window * step + 1, F.lit(width)).alias("ids"),
    )
    coded = encoder(parts)
    number = F.substring_index(F.substring_index("id", "|", -2), "|", 1).cast("int")
    windows = F.substring_index("id", "|", -1).cast("int")
    place = F.length("id") - F.length(F.substring_index("id", "|", -2)) - 1
    own = ((F.col("pos") >= half) | (number == 0)) & ((F.col("pos") < half + step) | (number == windows - 1))
    kind = df.schema["id"].dataType
    rest = [c for c in coded.columns if c not in ("id", "pos")]
    return coded.filter(own).select(
        F.substr("id", F.lit(1), place).cast(kind).alias("id"), (F.col("pos") + number * step).alias("pos"), *rest
    )


def select_layers(df: DataFrame, layers: list[int] = [-6], name: str = "vector") -> DataFrame:
    """Concatenation of chosen entries of ``layers``; negative ones count from the end."""
    chosen = [
        F.element_at("layers", i + 1 if i >= 0 else i)["values"] for i in layers
    ]
    return df.withColumn(name, F.concat(*chosen)).drop("layers")


def span_token_rows(df: DataFrame, slots: tuple[str, ...] = ("a", "b", "p")) -> DataFrame:
    """(id, span, pos, token) for the tokens inside the spans of ``mention_segments``.

    ``slots`` may also name ``url``, the title behind the text.
    """

    def inside(slot: str) -> Column:
        start, end = F.col("spans")[f"{slot}_start"], F.col("spans")[f"{slot}_end"]
        part = F.slice("tokens", start + 1, F.greatest(end - start + 1, F.lit(0)))
        return F.transform(
            part,
            lambda t, i: F.struct(
                F.lit(slot.upper()).alias("span"), (start + i).alias("pos"), t.alias("token")
            ),
        )

    return df.select("id", F.inline(F.concat(*[inside(s) for s in slots])))


def align_spans(
    df: DataFrame, tokens: str = "tokens", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id, span, pos) of tokens found by counting characters, for foreign token lists.

    The text and its tokens are compared without white space and ``#``, the piece marker.
    P is the token that starts where the pronoun does; A and B are all tokens that start
    inside the name.
    """
    prepared, spans = _aligned(df, tokens)
    return prepared.select("id", *keep, F.inline(spans))


def _aligned(df: DataFrame, tokens: str) -> tuple[DataFrame, Column]:
    """The rows with what alignment needs, and their (span, pos) pairs as an array."""
    def solid(text: Column) -> Column:
        return F.length(F.replace(F.regexp_replace(text, r"\s+", ""), F.lit("#"), F.lit("")))

    text = F.col("text")
    prepared = df.withColumn("_lengths", F.transform(tokens, tx.piece_length))
    # Tokens that have characters, and one S per start in a string as long as all of these.
    places = F.filter(F.transform("_lengths", lambda n, i: F.when(n > 0, i)), lambda i: i.isNotNull())
    drawn = F.transform("_lengths", lambda n: F.rpad(F.when(n > 0, "S").otherwise(""), n, F.lit(".")))
    prepared = prepared.withColumns({"_places": places, "_marks": F.array_join(drawn, "")})

    def found(slot: str, off: str, name: Column, exact: bool) -> Column:
        start = solid(tx.before(text, F.col(off)))
        length = F.lit(1) if exact else solid(name)
        ahead = F.length(F.replace(tx.before(F.col("_marks"), start), F.lit("."), F.lit("")))
        within = F.length(
            F.replace(F.substr("_marks", start + 1, length), F.lit("."), F.lit(""))
        )
        return F.transform(
            F.slice("_places", ahead + 1, within),
            lambda pos: F.struct(F.lit(slot).alias("span"), pos.alias("pos")),
        )

    spans = F.concat(
        found("P", "p_off", F.col("pronoun"), True),
        found("A", "a_off", F.col("a"), False),
        found("B", "b_off", F.col("b"), False),
    )
    return prepared, spans


def pool_spans(rows: DataFrame) -> DataFrame:
    """Vectors of (id, span, pos, vector) rows pooled per span in doubles: mean for A and B, sum for P.

    A group is the tokens of one span of one text. A span without tokens has no row.
    """
    grouped = rows.groupBy("id", "span").agg(
        F.array_sort(F.collect_list(F.struct("pos", "vector"))).alias("_parts")
    )
    parts = F.col("_parts")["vector"].cast("array<array<double>>")
    total = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size("_parts") - 1, F.lit(0))),
        parts[0],
        lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y),
    )
    share = F.when(F.col("span") == "P", F.lit(1)).otherwise(F.size("_parts"))
    return grouped.withColumn("_total", total).select(
        "id", "span", F.transform("_total", lambda x: x / share).alias("vector")
    )


def span_mean_pool(df: DataFrame, token_vectors: DataFrame, referred: DataFrame | None = None) -> DataFrame:
    """Pooled vectors of P, A and B from encoder output (id, pos, token, vector).

    With ``referred`` (ref, vector) the output is packed: it has a ref in place of each vector.

    Alignment looks at token strings only, and gives each text the places of its spans as one
    array. That meets the vectors by id alone, and vectors at other places are dropped before
    anything is moved or widened. With encoder output bucketed by id (``session.bucketed``)
    no vector is shuffled at all: only the texts go to their buckets. Sums are taken in doubles.
    """
    listed = token_vectors.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_list")
    )
    texts = listed.withColumn("tokens", F.col("_list")["token"]).withColumn(
        "_listed", F.col("_list")["pos"]
    )
    prepared, spans = _aligned(df.join(texts, "id"), "tokens")
    placed = F.transform(
        spans, lambda s: F.struct(s["span"].alias("span"), F.get("_listed", s["pos"]).alias("pos"))
    )
    places = prepared.select("id", placed.alias("_spans"))
    value = "vector" if referred is None else "ref"
    vectors = token_vectors.select("id", F.col("pos").alias("_at"), value).join(places, "id")
    own = F.filter("_spans", lambda s: s["pos"] == F.col("_at"))
    rows = vectors.select("id", F.inline(own), value)
    return pool_spans(rows if referred is None else gather_vectors(rows, referred, "ref").drop("ref"))


def pronoun_vector(rows: DataFrame) -> DataFrame:
    """The vector at the pronoun."""
    return rows.filter(F.col("span") == "P").select("id", "vector")


def endpoint_span(rows: DataFrame, *spans: str) -> DataFrame:
    """``[x, y, x*y]`` of the first and the last token of the spans, both names by default."""
    ends = (
        rows.filter(F.col("span").isin(*(spans or ("A", "B"))))
        .groupBy("id", "span")
        .agg(F.min_by("vector", "pos").alias("x"), F.max_by("vector", "pos").alias("y"))
    )
    return ends.select("id", "span", F.concat("x", "y", times(F.col("x"), F.col("y"))).alias("vector"))


def attentive_span(rows: DataFrame, weights: Column, bias: float = 0.0) -> DataFrame:
    """Softmax-weighted sum of the token vectors of each span, scored by a weight vector."""
    scored = rows.withColumn("_weights", weights).withColumn(
        "score", dot(F.col("vector"), F.col("_weights")) + bias
    )
    grouped = scored.groupBy("id", "span").agg(
        F.array_sort(F.collect_list(F.struct("pos", "score", "vector"))).alias("_parts"),
        F.max("score").alias("_top"),
    )
    weighted = grouped.withColumn(
        "_parts",
        F.transform(
            "_parts",
            lambda t: F.struct(
                F.exp(t["score"] - F.col("_top")).alias("w"), t["vector"].alias("vector")
            ),
        ),
    )
    total = F.aggregate(F.col("_parts")["w"], F.lit(0.0), lambda acc, w: acc + w)
    scaled = F.transform(
        "_parts", lambda t: F.transform(t["vector"], lambda x: x * (t["w"] / F.col("_mass")))
    )
    return (
        weighted.withColumn("_mass", total)
        .withColumn("_scaled", scaled)
        .select(
            "id",
            "span",
            F.aggregate(
                F.slice("_scaled", 2, F.greatest(F.size("_scaled") - 1, F.lit(0))),
                F.col("_scaled")[0],
                lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y),
            ).alias("vector"),
        )
    )


def span_columns(pooled: DataFrame) -> DataFrame:
    """One row per id with the span vectors as ``vec_a``, ``vec_b`` and ``vec_p``."""
    own = {s: F.when(F.col("span") == s, F.col("vector")) for s in "ABP"}
    return pooled.groupBy("id").agg(
        *[F.first(v, ignorenulls=True).alias(f"vec_{s.lower()}") for s, v in own.items()]
    )


def pair_features(df: DataFrame) -> DataFrame:
    """``[A*P, A, P]`` and ``[B*P, B, P]``."""
    p = F.col("vec_p")
    return df.withColumns(
        {
            f"pair_{s}": F.concat(times(F.col(f"vec_{s}"), p), F.col(f"vec_{s}"), p)
            for s in ("a", "b")
        }
    )


def distance_embedding(df: DataFrame, table: DataFrame, bins: int = 14) -> DataFrame:
    """Vectors of both distance bins, from a table (bin, vector) with one row per bin."""
    rows = F.broadcast(table.filter(F.col("bin").between(0, bins - 1)))
    out = df
    for s in ("a", "b"):
        own = rows.select(F.col("bin").alias(f"d_p{s}"), F.col("vector").alias(f"emb_{s}"))
        out = out.join(own, f"d_p{s}", "left")
    return out


def gather_vectors(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Vectors for token rows by a key that frequent tokens share.

    One join at every size: Spark broadcasts the table if its bytes are few, else joins by
    key and splits the partitions of frequent ones.
    """
    return rows.join(vectors, key)
