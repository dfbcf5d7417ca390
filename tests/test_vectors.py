import os

import pyarrow as pa
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from antecede import session
from antecede.plans import catalog
from antecede.operators import scoring, sequences, vectors
from antecede.session import bucketed


def test_vocab_and_ids(spark):
    words = spark.createDataFrame([(w,) for w in "b b a a c [A] [SEP]".split()], "token string")
    vocab = {r.token: r.token_id for r in sequences.build_vocab(words, 2).collect()}
    assert vocab["a"] == 104 and vocab["b"] == 105 and "c" not in vocab
    assert {vocab[t] for t in ("[PAD]", "[A]", "[B]", "[MALENAME]", "[FEMALENAME]", "[NAME]")} == set(range(6))
    rows = spark.createDataFrame([(1, ["b", "c", "[SEP]"], "x"), (2, [], "y")], "id long, tokens array<string>, note string")
    got = {r.id: (r.ids, r.note) for r in sequences.encode_tokens(rows, sequences.build_vocab(words, 2)).collect()}
    assert got == {1: ([101, 105, 100, 102], "x"), 2: ([101], "y")}
    with_sep = sequences.encode_tokens(rows, sequences.build_vocab(words, 2), sep=True)
    assert {r.id: r.ids[-1] for r in with_sep.collect()} == {1: 102, 2: 102}


def test_vocab_holds_all_tokens_or_the_first(spark):
    words = spark.createDataFrame([(w,) for w in ["b"] * 3 + ["ab", "aa", "c", "c", "é", "a", "[SEP]"]], "token string")
    first = max(sequences.RESERVED.values()) + 1
    ranked = ["b", "c", "a", "aa", "ab", "é"]
    for size in (None, 4):
        got = {r.token: r.token_id for r in sequences.build_vocab(words, size).collect()}
        assert got == {**sequences.RESERVED, **{t: first + i for i, t in enumerate(ranked[:size])}}


def test_encoding_shuffles_rows_once(spark):
    rows = spark.createDataFrame([(1, ["b"])], "id long, tokens array<string>")
    vocab = spark.createDataFrame([("b", 7)], "token string, token_id int")
    plan = sequences.encode_tokens(rows, vocab.hint("broadcast"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_postings_move_once_a_row_and_token(spark):
    """Two exchanges of rows when the vocabulary is joined, and a frequent token is one row of them."""
    text = ["the"] * 500 + ["cat", "the", None, "", "cat"]
    rows = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, [], None)], "id long, tokens array<string>, note string")
    vocab = spark.createDataFrame([("the", 7), ("cat", 8), ("[CLS]", 101), ("[SEP]", 102)], "token string, token_id int")
    coded = sequences.encode_tokens(rows, vocab.hint("merge"), sep=True)
    got = {r.id: (r.ids, r.note) for r in coded.collect()}
    assert got == {1: ([101] + [7] * 500 + [8, 7, 100, 100, 8, 102], "x"), 2: ([101, 102], "y"), 3: ([101, 102], None)}
    plan = coded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(token") == 2 and plan.count("Exchange hashpartitioning(id") == 1
    posted = rows.select("id", F.size(sequences._postings(F.coalesce("tokens", F.array().cast("array<string>")))).alias("n"))
    assert {r.id: r.n for r in posted.filter("id = 1").collect()} == {1: 3}


def test_batches_of_even_length(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 211 + 1).cast("int").alias("n"))
    placed = sequences.length_batches(df, 32)
    rows = placed.collect()
    order = sorted(rows, key=lambda r: (r.batch_id, r.batch_pos))
    assert [r.n for r in order] == sorted(r.n for r in rows) and [r.batch_pos for r in order] == [i % 32 for i in range(1000)]
    even = sequences.padding(placed, []).first()
    plain = sequences.padding(df.withColumn("batch_id", F.floor(F.col("id") / 32)), []).first()
    width = lambda b: max(r.n for r in rows if r.batch_id == b)
    assert even.n_padding == sum(width(r.batch_id) - r.n for r in rows) and even.n_tokens == plain.n_tokens
    assert even.share < plain.share / 2
    assert sequences.length_batches(df.limit(0)).count() == 0


def test_padding(spark):
    rows = [(1, 0, [5] * 3, (1, 1)), (2, 0, [5] * 7, (5, 5)), (3, 1, [5] * 2, (0, 0))]
    df = spark.createDataFrame(rows, "id long, batch_id long, ids array<int>, spans struct<a_start:int,a_end:int>")
    got = {r.id: r for r in sequences.pad_truncate(df, max_len=6).collect()}
    assert got[1].ids == [5, 5, 5, 0, 0, 0] and got[2].ids == [5] * 6 and got[3].ids == [5, 5]
    assert [got[i].truncated_span for i in (1, 2, 3)] == [False, True, False]
    assert got[1].spans.a_start == 2


def align(text, a, b, p, toks):
    """Span tokens by walking over the tokens with a running character count."""
    solid = lambda t: sum(c not in " #\n\t" for c in t)
    begin = {s: solid(text[: text.index(w)]) for s, w in (("A", a), ("B", b), ("P", p))}
    out, count = set(), 0
    for i, t in enumerate(toks):
        size = solid(t)
        if size:
            if count == begin["P"]:
                out.add(("P", i))
            for s, w in (("A", a), ("B", b)):
                if begin[s] <= count < begin[s] + solid(w):
                    out.add((s, i))
        count += size
    return out


@pytest.mark.parametrize(
    "text, a, b, p, toks",
    [
        ("Anna Lee saw Bo. # Then he\nleft", "Anna Lee", "Bo", "he", "An ##na Lee saw Bo . # Then he left".split()),
        ("he ran to Jo and Mo", "Jo", "Mo", "he", "he ran to J ##o and M ##o".split()),
        ("#he saw É Al", "É", "Al", "he", "# he saw É Al".split()),
    ],
)
def test_alignment_by_characters(spark, text, a, b, p, toks):
    row = (1, text, p, text.index(p), a, text.index(a), b, text.index(b), toks)
    df = spark.createDataFrame(
        [row], "id long, text string, pronoun string, p_off int, a string, a_off int, b string, b_off int, tokens array<string>"
    )
    got = {(r.span, r.pos) for r in vectors.align_spans(df).collect()}
    assert got == align(text, a, b, p, toks)


def test_span_mean_pool_from_encoder_rows(spark):
    toks = "[CLS] An ##na saw he Bo [SEP]".split()
    text = "Anna saw he Bo"
    m = spark.createDataFrame(
        [(1, text, "he", 9, "Anna", 0, "Bo", 12)],
        "id long, text string, pronoun string, p_off int, a string, a_off int, b string, b_off int",
    )
    rows = [(1, i, t, [float(i), 1.0]) for i, t in enumerate(toks)]
    tv = spark.createDataFrame(rows, "id long, pos int, token string, vector array<double>")
    got = {r.span: r.vector for r in vectors.span_mean_pool(m, tv).collect()}
    assert got == {"A": [1.5, 1.0], "P": [4.0, 1.0], "B": [5.0, 1.0]}


def test_packed_encoder_output_is_pooled_alike(spark):
    """References in place of vectors, of which some are shared, one is null and one comes twice."""
    toks = "[CLS] An ##na saw he Bo [SEP]".split()
    m = spark.createDataFrame(
        [(k, "Anna saw he Bo", "he", 9, "Anna", 0, "Bo", 12) for k in range(8)],
        "id long, text string, pronoun string, p_off int, a string, a_off int, b string, b_off int",
    )
    kinds = [(7, [0.1, 2.0]), (8, [0.7, None]), (9, None), (10, [0.3, 4.0])]
    table = spark.createDataFrame(kinds, "ref long, vector array<float>")
    rows = [(k, i, t, 7 + (i + k) % 4) for k in range(8) for i, t in enumerate(toks)]
    refs = spark.createDataFrame(rows, "id long, pos int, token string, ref long")
    plain = vectors.span_mean_pool(m, refs.join(table, "ref").select("id", "pos", "token", "vector"))
    packed = vectors.span_mean_pool(m, refs, table)
    assert packed.schema == plain.schema and packed.count() == 24
    assert sorted(map(repr, packed.collect())) == sorted(map(repr, plain.collect()))


def test_encoder_output_is_written_without_its_vectors(spark, tmp_path, monkeypatch):
    """All that ``span_mean_pool`` writes is a part of the bytes of the vectors of all tokens."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    texts = [(i, f"Ann saw Bob . he met Cid {' '.join(rng.choice(words, 2500))} .", "en") for i in range(30)]
    folder, scratch = tmp_path / "tables", tmp_path / "scratch"
    for name, rows, kind in (
        ("documents", texts, "doc_id long, text string, lang string"),
        ("pages", [(i, f"http://x/{i}") for i in range(7)], "page_id long, url string"),
        ("embeddings", [(i, rng.random(64).tolist()) for i in range(300)], "vec_id long, embedding array<float>"),
    ):
        spark.createDataFrame(rows, kind).write.parquet(f"{folder}/{name}.parquet")
    monkeypatch.setattr(session, "scratch_root", lambda spark: str(scratch))
    assert catalog.span_mean_pool(spark, str(folder)).count() == 30 * 3 * 64
    held = sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(scratch) for f in files if not f.endswith(".crc"))
    assert held < 30 * 2500 * 64 * 4 / 8


@pytest.fixture()
def no_broadcast(spark):
    """Plans as they are when no side is small."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_vectors_outside_mentions_are_not_shuffled(spark, no_broadcast):
    """Encoder output bucketed by id is read in place: only the texts are shuffled."""
    text = "Anna saw he Bo"
    m = [(i, text, "he", 9, "Anna", 0, "Bo", 12) for i in range(30)]
    m = spark.createDataFrame(m, "id long, text string, pronoun string, p_off int, a string, a_off int, b string, b_off int")
    toks = "[CLS] An ##na saw he Bo [SEP]".split()
    tv = spark.createDataFrame(
        [(k, i, t, [float(i), float(k)]) for k in range(30) for i, t in enumerate(toks)],
        "id long, pos int, token string, vector array<float>",
    )
    stored = bucketed(tv.repartition(4, "id"), "id", "stored", 4)
    pooled = vectors.span_mean_pool(m, stored)
    got = {(r.id, r.span): r.vector for r in pooled.collect()}
    assert got == {(k, s): [v, float(k)] for k in range(30) for s, v in (("A", 1.5), ("P", 4.0), ("B", 5.0))}
    plan = pooled._jdf.queryExecution().executedPlan().toString()
    ran = plan.split("Initial Plan")[0].splitlines()
    scans = [line for line in ran if "Bucketed: true" in line]
    moved = [i for i, line in enumerate(ran) if "Exchange" in line and "Reused" not in line]
    assert len(scans) == 2 and sum("vector" in line.partition("[")[2].partition("]")[0] for line in scans) == 1
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    assert moved
    for at in moved:  # what is below an exchange has no vector
        for line in ran[at + 1 :]:
            if depth(line) <= depth(ran[at]):
                break
            assert "vector" not in line and "stored" not in line


@pytest.fixture()
def rows(spark):
    data = [(1, "A", 0, [1.0, 2.0]), (1, "A", 1, [3.0, 4.0]), (1, "B", 4, [0.5, -1.0]), (1, "P", 6, [2.0, 2.0])]
    return spark.createDataFrame(data, "id long, span string, pos int, vector array<double>")


def test_pooling(rows):
    got = {r.span: r.vector for r in vectors.pool_spans(rows).collect()}
    assert got == {"A": [2.0, 3.0], "B": [0.5, -1.0], "P": [2.0, 2.0]}
    wide = vectors.pair_features(vectors.span_columns(vectors.pool_spans(rows))).first()
    assert wide.pair_a == [4.0, 6.0, 2.0, 3.0, 2.0, 2.0]
    assert wide.pair_b == [1.0, -2.0, 0.5, -1.0, 2.0, 2.0]
    assert vectors.pronoun_vector(rows).first().vector == [2.0, 2.0]
    assert vectors.endpoint_span(rows, "A").first().vector == [1.0, 2.0, 3.0, 4.0, 3.0, 8.0]


def test_attention_sums_to_one(rows):
    got = {r.span: np.array(r.vector) for r in vectors.attentive_span(rows, F.array(F.lit(0.5), F.lit(0.25))).collect()}
    score = np.array([1.0, 2.5])
    share = np.exp(score) / np.exp(score).sum()
    assert np.allclose(got["A"], share @ np.array([[1.0, 2.0], [3.0, 4.0]]))
    assert np.allclose(got["B"], [0.5, -1.0])


def test_layers(spark):
    df = spark.createDataFrame([(1, [([float(i)],) for i in range(8)])], "id long, layers array<struct<values:array<double>>>")
    assert vectors.select_layers(df).first().vector == [2.0]
    assert vectors.select_layers(df, [0, -1]).first().vector == [0.0, 7.0]


def test_distance_embedding(spark):
    table = spark.createDataFrame([(i, [float(i)]) for i in range(20)], "bin int, vector array<double>")
    df = spark.createDataFrame([(1, 0, 13)], "id long, d_pa int, d_pb int")
    row = vectors.distance_embedding(df, table).first()
    assert (row.emb_a, row.emb_b) == ([0.0], [13.0])


def test_encoders_agree(spark):
    table = np.random.default_rng(1).normal(size=(50, 3)).astype(np.float32)
    df = spark.createDataFrame([(i, [101 % 50, i % 50, (i * 7) % 50, 0][: 2 + i % 3]) for i in range(90)], "id long, ids array<int>")
    lookup = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(table)], "token_id int, vector array<float>")

    def load():
        return lambda ids, mask: table[ids] * mask[:, :, None]

    native = vectors.encode_batches(df, vectors.lookup_encoder(lookup))
    model = vectors.encode_batches(df, vectors.model_encoder(load, "id", "long", batch_size=8))
    columns = ["id", "pos", "token_id", "vector"]
    assert sorted(map(repr, native.select(columns).collect())) == sorted(map(repr, model.select(columns).collect()))
    assert model.filter("token_id = 0").count() == 0


@pytest.mark.parametrize("width, overlap", [(4, 0), (5, 2), (6, 3), (100, 10)])
def test_windows_cover_every_token_once(spark, width, overlap):
    """A vector shows where in its window a token stood: away from the edges, if it can."""
    df = spark.createDataFrame([(f"a|{n}", list(range(1, n + 1))) for n in (1, 4, 5, 17)], "id string, ids array<int>")

    def encoder(parts):
        long = parts.select("id", F.size("ids").alias("n"), F.posexplode("ids").alias("pos", "token_id"))
        return long.select("id", "pos", "token_id", F.array("pos", "n").alias("vector"))

    got = vectors.encode_batches(df, encoder, width, overlap).collect()
    want = {(f"a|{n}", i, i + 1) for n in (1, 4, 5, 17) for i in range(n)}
    assert {(r.id, r.pos, r.token_id) for r in got} == want and len(got) == len(want)
    for r in got:
        place, size = r.vector
        assert r.pos < overlap // 2 or place >= overlap // 2 or size < width
    with pytest.raises(ValueError):
        vectors.encode_batches(df, encoder, 4, 4)


def test_model_with_layers(spark):
    """All layers of a plug-in arrive as floats, in windows, and layers are picked from them."""
    df = spark.createDataFrame([(i, [3 + i % 7, 5, (i * 7) % 50 + 1, 0][: 2 + i % 3]) for i in range(40)] + [(99, [])], "id long, ids array<int>")

    def load():
        return lambda ids, mask: np.stack([np.stack([ids * (k + 1), ids + k], axis=-1) for k in range(8)])

    encoder = vectors.model_encoder(load, "id", "long", batch_size=8, layers=True)
    coded = vectors.encode_batches(df, encoder)
    assert coded.schema["layers"].dataType.simpleString() == "array<struct<values:array<float>>>"
    got = {(r.id, r.pos): r.vector for r in vectors.select_layers(coded, [-6, 0]).collect()}
    want = {}
    for r in df.collect():
        for pos, t in enumerate(r.ids):
            if t > 0:
                want[r.id, pos] = [t * 3.0, t + 2.0, float(t), float(t)]
    assert got == want
    wide = vectors.encode_batches(df, vectors.model_encoder(load, "id", batch_size=8, layers=True), width=2, overlap=0)
    assert {(r.id, r.pos): r.vector for r in vectors.select_layers(wide, [-6, 0]).collect()} == want


def test_topk_needs_k_snapshots(spark):
    snaps = spark.createDataFrame([(1, s, float(s)) for s in range(3)], "run int, step int, loss double")
    pred = spark.createDataFrame([(1, s, 9, s / 10, 0.2, 0.3) for s in range(3)], "run int, step int, id long, pr_a double, pr_b double, pr_neither double")
    assert abs(scoring.topk_snapshot_ensemble(snaps, pred, 2).first().pr_a - 0.05) < 1e-12
    with pytest.raises(PySparkException):
        scoring.topk_snapshot_ensemble(snaps, pred, 4).collect()


def test_buckets_follow_the_texts(spark, monkeypatch):
    """A task's share of encoder output stays the same when there are more texts."""
    monkeypatch.setattr(session, "BUCKET_CHARS", 100)
    rows = spark.range(500).select("id", F.lit("ten chars ").alias("text"))
    assert session.text_buckets(rows) == 50 and session.text_buckets(rows.limit(1)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.text_buckets(rows.limit(0)) > 0 and session.text_buckets(rows.select(F.lit(None).cast("string").alias("text"))) > 0


def test_place_weighted_sums(spark):
    rows = [([1.5, 2.0],), ([],), (None,), ([1.0, None, 3.0],), ([float("nan")],), ([0.1, 0.2, 0.3],)]
    got = catalog.place_weighted(pa.array([r[0] for r in rows], pa.list_(pa.float32()))).to_pylist()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v array<float>")
    plain = F.aggregate(F.transform("v", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    want = [r.w for r in df.select("i", plain.alias("w")).orderBy("i").collect()]
    assert repr(got) == repr(want)


def test_places_are_filled_by_chunks(spark, monkeypatch):
    """Rows whose postings come in several chunks, and chunks that hold several rows, with null ids and null columns."""
    words = [(i, [f"w{j % (i + 1)}" for j in range(3 * i)], (i, None)[i % 2]) for i in range(12)] + [(None, ["w1"], 5)]
    rows = spark.createDataFrame(words, "id long, tokens array<string>, note long").coalesce(1)
    vocab = spark.createDataFrame([(f"w{i}", 200 + i) for i in range(12)] + [("[CLS]", 101)], "token string, token_id int")
    want = {i: ([101] + [200 + int(t[1:]) for t in tokens], note) for i, tokens, note in words}
    source = sequences.encode_tokens(rows, vocab)
    assert {r.id: (r.ids, r.note) for r in source.collect()} == want
    schema = pa.schema([("id", pa.int64()), ("note", pa.int64()), ("_tokens", pa.list_(pa.string()))])
    batch = pa.RecordBatch.from_pylist([{"id": i, "note": n, "_tokens": ["[CLS]", *t]} for i, t, n in words], schema)
    ids = {"[CLS]": 101, **{f"w{i}": 200 + i for i in range(12)}}
    for size in (1, 4, 7):
        monkeypatch.setattr(sequences, "CHUNK", size)
        posted = pa.Table.from_batches(sequences._posted(iter([batch])))
        coded = posted.drop(["token"]).add_column(2, "_id", pa.array([ids[t] for t in posted["token"].to_pylist()], pa.int32()))
        filled = list(sequences._in_place(iter(coded.to_batches(max_chunksize=5))))
        assert max(b.num_rows for b in filled) <= max(size, 5)
        assert {r["id"]: (r["ids"], r["note"]) for b in filled for r in b.to_pylist()} == want


def test_rows_are_padded_without_a_slice(spark):
    """Rows are cut only where they are longer than the batch may be; others are filled up, null rows stay null."""
    rows = [(0, [1, 2, 3]), (0, [4]), (0, []), (1, [5, 6, 7, 8]), (1, None)]
    df = spark.createDataFrame(rows, "batch_id int, ids array<int>").withColumn("spans", F.struct(F.lit(2).alias("a_end")))
    full, cut = sequences.pad_truncate(df), sequences.pad_truncate(df, max_len=2)
    got = lambda d: sorted((r.batch_id, r.ids) for r in d.collect() if r.ids is not None)
    assert got(full) == [(0, [0, 0, 0]), (0, [1, 2, 3]), (0, [4, 0, 0]), (1, [5, 6, 7, 8])]
    assert got(cut) == [(0, [0, 0]), (0, [1, 2]), (0, [4, 0]), (1, [5, 6])]
    assert full.filter("ids IS NULL").count() == 1 and cut.filter("ids IS NULL").count() == 1
    assert "CASE WHEN" in full._jdf.queryExecution().optimizedPlan().toString()
