import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from plain import base_counts, near, without_repeats
from pyspark.sql import functions as F

from antecede.llm import bpe, line_dedup, near_dup, quality_rules, sharding, token_counts

DOCS = "doc_id long, text string"
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
ODD = [
    "",
    None,
    " \n\t ",
    "a",
    "Äé 你好 😀 mixed, text's end!!!  \n\n\n x",
    "<|endoftext|> is text here",
    "a" * 100_000,
    " " * 70_000 + "b",
    LONG,
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def plain_rows(documents):
    return [(r.doc_id, r.text) for r in documents.collect()]


def numbered(texts):
    return [(i, t) for i, t in enumerate(texts)]


def test_bpe_equals_tiktoken_on_whole_texts(spark, plain_rows):
    enc = bpe.encoder(RANKS, PATTERN)
    rows = numbered(ODD + [t for _, t in plain_rows[:50]])
    got = bpe.round_trip(spark.createDataFrame(rows, DOCS), RANKS, PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r.doc_id][1] or ""
        ids = enc.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.same
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("size", [1, 7, 100])
def test_pieces_keep_the_tokens(size):
    enc = bpe.encoder(RANKS, PATTERN)
    for text in ["it's  a\n\n b\tc'll 12 34!? ", "a" * 50, "  x" * 30, "é 你 " * 20]:
        parts = list(bpe.pieces(text, size))
        assert "".join(parts) == text
        assert [t for p in parts for t in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_bpe_columns_and_decoding(spark):
    rows = [(1, "one two", "kept"), (1, "one two", "kept"), (None, None, None)]
    df = spark.createDataFrame(rows, "IDS long, text string, batch string")
    df = df.withColumnRenamed("IDS", "n")
    coded = bpe.encode(df, RANKS, PATTERN)
    assert coded.columns == ["n", "text", "batch", "ids"] and coded.count() == 3
    back = bpe.decode(coded, RANKS, PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in back) == [b"", b"one two", b"one two"]
    assert bpe.encode(coded, RANKS, PATTERN).columns == coded.columns  # replaced
    assert bpe.encode(df.limit(0), RANKS, PATTERN).count() == 0


def test_token_counts_against_offsets(spark, plain_rows):
    enc = bpe.encoder(RANKS, PATTERN)
    rows = numbered(["", None, "a\n\n\nb c\n", "é\n你好 😀\n", "x"] + [t for _, t in plain_rows[:30]])
    for rule in token_counts.RULES:
        got = token_counts.token_counts(spark.createDataFrame(rows, DOCS), RANKS, PATTERN, rule=rule).collect()
        for i, text in rows:
            text = text or ""
            own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
            assert [text[r.start : r.end] for r in own] == text.split("\n")[:1] * (not text) or "".join(
                text[r.start : r.end] for r in own
            ) == text
            ids = enc.encode_ordinary(text)
            assert sum(r.n_tokens for r in own) == pytest.approx(len(ids))
            assert {r.doc_tokens for r in own} == {len(ids)}
            if rule == "first":
                _, at = enc.decode_with_offsets(ids) if ids else ("", [])
                for r in own:
                    if all(len(enc.decode_single_token_bytes(t).decode("utf-8", "ignore")) for t in ids):
                        assert r.n_tokens == sum(r.start <= a < r.end for a in at)


def test_token_counts_rules_at_an_edge(spark):
    df = spark.createDataFrame([(1, "ab\n\n\n\ncd")], DOCS)
    from pyspark.sql import functions as F

    cut = F.array(
        F.struct(F.lit("a").alias("name"), F.lit(0).alias("start"), F.lit(3).alias("end")),
        F.struct(F.lit("b").alias("name"), F.lit(3).alias("start"), F.lit(8).alias("end")),
        F.struct(F.lit("none").alias("name"), F.lit(5).alias("start"), F.lit(5).alias("end")),
    )
    enc = bpe.encoder(RANKS, PATTERN)
    pieces = [enc.decode([t]) for t in enc.encode_ordinary("ab\n\n\n\ncd")]
    spans, at = [], 0
    for p in pieces:
        spans.append((at, at + len(p)))
        at += len(p)
    for rule in token_counts.RULES:
        rows = token_counts.token_counts(df, RANKS, PATTERN, cut, rule).collect()
        got = {r.name: r for r in rows}
        want = {"first": lambda s, e: s < 3, "last": lambda s, e: e <= 3}
        if rule == "split":
            first = sum((min(e, 3) - s) / (e - s) for s, e in spans if s < 3)
        else:
            first = sum(want[rule](s, e) for s, e in spans)
        assert got["a"].n_tokens == pytest.approx(first)
        assert got["b"].n_tokens == pytest.approx(len(spans) - first)
        assert got["none"].n_tokens == 0
        crossing = sum(s < 3 < e for s, e in spans)
        assert (got["a"].n_crossing, got["b"].n_crossing) == (crossing, crossing)
    with pytest.raises(ValueError):
        token_counts.token_counts(df, RANKS, PATTERN, rule="other")


def test_joined_fields_add_up(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "Title", "Body text\nhere"), (2, None, "x")], "doc_id long, title string, body string")
    text, sections = token_counts.join_fields({"title": F.col("title"), "body": F.col("body")})
    joined = df.withColumn("text", text)
    rows = token_counts.token_counts(joined, RANKS, PATTERN, sections).collect()
    assert {(r.doc_id, r.name): (r.start, r.end) for r in rows} == {
        (1, "title"): (0, 5),
        (1, "body"): (6, 20),
        (2, "title"): (0, 0),
        (2, "body"): (1, 2),
    }


def test_near_duplicates_equal_all_pairs(spark, documents, plain_rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(documents).collect()}
    assert got == near(plain_rows)


def chain(n, words=100, step=6):
    """Texts of which each is near the next one alone: a window that moves over a long text."""
    every = [f"t{i}" for i in range(words + step * n)]
    return [" ".join(every[step * k : step * k + words]) for k in range(n)]


def test_near_duplicates_in_odd_cases(spark):
    texts = ["", None, "a b", "a  B", "a b c d e", *chain(12), *chain(3, 40, 30), LONG, LONG + " end", "\n"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(500 + i, chain(1)[0]) for i in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()}
    assert got == near(rows)
    kept = near_dup.one_of_each(df.selectExpr("doc_id", "text", "1 as KEPT", "2 as component_id"))
    assert kept.columns == ["doc_id", "text", "KEPT", "component_id"]
    assert {r.doc_id for r in kept.collect()} == {k for k, v in near(rows).items() if v[1] == k}


def test_hot_buckets_equal_all_pairs(spark, monkeypatch):
    """Copies of two texts with more and more words changed, compared in small blocks."""
    monkeypatch.setattr(near_dup, "HOT", 3)
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(3)
    rows = []
    for i in range(120):
        text = [f"{'ab'[i % 2]}{k}" for k in range(90)]
        for k in rng.sample(range(90), rng.randrange(9)):
            text[k] = f"n{rng.random()}"
        rows.append((i, " ".join(text)))
    want = near(rows)
    assert 5 < len({v[1] for v in want.values()}) < 100
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want


def test_short_near_copies_share_a_key():
    """Signatures of sets of 6 of 7 up to 26 of 30 shingles; with independent orderings some 0 to 4 pairs have no key."""
    rng = np.random.default_rng(5)
    missed = 0
    for same, n in ((6, 7), (7, 8), (12, 14), (17, 20), (26, 30)):
        first = rng.integers(0, 2**64, (4000, n), dtype=np.uint64)
        at = np.arange(4000)
        a, b = near_dup.signatures(first.ravel(), at * n), near_dup.signatures(first[:, :same].ravel(), at * same)
        differ = (a != b).reshape(4000, -1, near_dup.CHUNK).sum(axis=2)
        missed += int((differ >= 2).all(axis=1).sum())
    assert missed <= 6


def test_near_duplicates_without_keys_or_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f")], DOCS)
    got = sorted(near_dup.near_duplicates(df).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.kept) for r in got] == [(7, 7, True)] * 2 + [(None, None, True)] * 2
    assert near_dup.one_of_each(df).count() == 4
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_base_rules_equal_plain_counts(spark, plain_rows):
    texts = [*ODD[:6], "a b c d e f g h " * 5, "x\nx\n\n x\nx", "x\r\nx\r\n", "é é\né é", "#*$ <>|&%\n" * 3, "q" * 3000 + "\n" + "q" * 3000]
    rows = numbered(texts + [t for _, t in plain_rows])
    df = spark.createDataFrame(rows, DOCS)
    for r in quality_rules.quality(df, None).collect():
        counts = base_counts(rows[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert r.probability is None and r.kept == (not r.base_failed)


def test_quality_model_on_held_out_rows(spark):
    """Fitted on one scale, it tells junk from text on another; most text is kept."""
    small = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.fit(docs, labels)
    large = "/root/testdata/sf0.1"
    others = spark.read.parquet(f"{large}/labels.parquet").filter("doc_id >= 1000")
    rows = quality_rules.quality(spark.read.parquet(f"{large}/documents.parquet"), model).join(others, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) > 0.97 * len(good)
    assert sum(not r.kept for r in bad) > 0.9 * len(bad)
    assert all(0 <= r.probability <= 1 for r in rows)


def test_quality_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.fit(documents, none) is None
    one = spark.createDataFrame([(0, 1), (None, 0), (1, None)], "doc_id long, quality int")
    assert quality_rules.fit(documents, one) is None
    df = documents.selectExpr("doc_id", "text", "true as KEPT", "0 as N_words")
    assert quality_rules.keep_good(df, None).columns == df.columns
    assert quality_rules.keep_good(df.limit(0), None).count() == 0
    assert quality_rules.quality(df.limit(0), None).count() == 0


def test_line_dedup_equals_plain(spark, documents, plain_rows):
    extra = [
        (900001, "a\nb\nc\nd"),
        (900002, "x\na\n \nb\nc\ny"),
        (900003, "a\na\na\na\na"),
        (900004, "b\nc\nd\ne\nf"),
        (900005, "a\nb"),
        (900006, ""),
        (900007, "\n\n\n"),
        (900008, "a\nb\nc"),
    ]
    rows = plain_rows + extra
    got = line_dedup.drop_repeated(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in got} == without_repeats(rows)


def test_line_dedup_in_odd_cases(spark):
    rows = [(1, "a\nb\nc", 5), (1, "a\nb\nc", 6), (None, "a\nb\nc", 7), (2, None, 8), (3, "a\nb\nc\n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_removed long")
    out = line_dedup.drop_repeated(df)
    assert out.columns == ["doc_id", "text", "n_removed"]
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in out.collect()), key=str)
    assert got == [(1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (2, None, 0), (3, "", 3), (None, "a\nb\nc", 0)]
    assert line_dedup.drop_repeated(df.limit(0)).count() == 0


def test_tiktoken_is_the_reference():
    ranks = bpe.encoder(RANKS, PATTERN)
    assert isinstance(ranks, tiktoken.Encoding) and ranks.n_vocab == 50256


# Columns called like helpers


def test_helper_names_do_not_clash(spark):
    lines = "\n".join(f"line {i} of the text" for i in range(4))
    rows = [(1, lines, 1, 2, 3, 4, 5, 6), (2, lines, 1, 2, 3, 4, 5, 6), (3, "x", 1, 2, 3, 4, 5, 6)]
    extra = ["_key", "_GONE", "_slot", "_table_slot", "_quality_text", "_bpe_text"]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'{c} int' for c in extra)}")
    cut = line_dedup.drop_repeated(df)
    assert cut.columns == [*df.columns, "n_removed"] and {r.n_removed for r in cut.collect()} == {0, 4}
    one = near_dup.one_of_each(df)
    assert one.columns == df.columns and {r.doc_id for r in one.collect()} == {1, 3}
    placed = sharding.place(df, "doc_id", ["a", "b"], 11)
    assert placed.columns == [*df.columns, "slot", "shard", "shard_name"] and placed.count() == 3
    assert quality_rules.keep_good(df, None).columns == df.columns
    with pytest.raises(ValueError):
        sharding.place(df.withColumnRenamed("doc_id", "slot"), "slot", ["a", "b"], 11)


def test_byte_bpe_with_clashing_names(spark):
    df = spark.createDataFrame([("a b", 1)], "text string, _bpe_text int").withColumn("_bpe_ids", F.lit(2))
    coded = bpe.encode(df, RANKS, PATTERN)
    assert coded.columns == [*df.columns, "ids"]
    back = bpe.decode(coded, RANKS, PATTERN).first()
    assert bytes(back.decoded) == b"a b" and (back._bpe_text, back._bpe_ids) == (1, 2)
    with pytest.raises(ValueError):
        bpe.round_trip(df.withColumn("n_tokens", F.lit(1)), RANKS, PATTERN, "n_tokens")


def test_a_very_long_text(spark):
    """One text of 60,000 words among short ones: lines, rules and counts as in plain Python."""
    long = "\n".join(f"line number {i % 4000} holds w{i % 7919}" for i in range(12_000))
    rows = [(1, long), (2, "a b c\n" * 5), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.quality(df, None).collect()}
    for key, text in rows:
        r = got[key]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(text)
    cut = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.drop_repeated(df).collect()}
    assert cut.pop(3) == (None, 0)
    assert cut == without_repeats([r for r in rows if r[1] is not None])
    again = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df.unionByName(df.withColumn("doc_id", F.col("doc_id") + 10))).collect()}
    assert again == {1: 1, 11: 1, 2: 2, 12: 2, 3: 3, 13: 13, 4: 4, 14: 14}
