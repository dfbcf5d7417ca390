import hashlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from plain import base_counts, base_scores, held_out, near, shingles, without_repeats, words
from pyspark.sql import functions as F

import corpus_pipeline
from antecede.llm import components, decontaminate, kneser_ney, licenses, ngram_filter, queries, quality_rules, sharding
from antecede.llm import words as W

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def plain_rows(documents):
    return [(r.doc_id, r.text) for r in documents.collect()]


# Words


def test_word_arrays_do_not_depend_on_slices():
    texts = ["A b\tc", "", None, "x", "Ünï b", " lead and trail ", "w" * 5000, "a b c d e f g"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    whole = W.Words(batch.column(0))
    all_hashes = np.split(whole.hashes(), whole.first[1:-1])
    for size in (1, 10, 1 << 20):
        found = []
        for part in W.runs(batch, "text", size):
            own = W.Words(part.column(0))
            found += np.split(own.hashes(), own.first[1:-1])
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(found, all_hashes, strict=True))
    assert [len(x) for x in all_hashes] == [len(words(t)) for t in texts]
    flat, bounds = W.shingles(whole, whole.hashes())
    assert np.diff(bounds).tolist() == [1, 0, 0, 1, 1, 1, 1, 3] and len(flat) == bounds[-1]


# Sharding


def test_table_is_filled_by_turns():
    names, slots = ["a", "b", "c", "d", "e"], 101
    table = sharding.fill_table(names, slots)
    free, claimed = set(range(slots)), {}
    walks = []
    for name in names:
        begin, step = sharding._preference(name, slots)
        walks.append(iter([(begin + k * step) % slots for k in range(slots)]))
    turn = 0
    while free:
        slot = next(s for s in walks[turn % 5] if s in free)
        free.discard(slot)
        claimed[slot] = turn % 5
        turn += 1
    assert table == [claimed[s] for s in range(slots)]
    sizes = Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_few_keys_move_when_a_shard_goes():
    names = queries.SHARD_NAMES
    before, after = sharding.fill_table(names), sharding.fill_table(names[:-1])
    moved = sum(a != b for a, b in zip(before, after) if a != len(names) - 1)
    assert moved < 0.05 * len(before)
    shares = Counter(before).values()
    assert max(shares) / min(shares) < 1.01


def test_placement(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5), (None, "b", 6), (1, "c", 7)], "doc_id long, text string, SHARD long")
    out = sharding.place(df, "doc_id", ["x", "y", "z"], 11)
    assert out.columns == ["doc_id", "text", "slot", "shard", "shard_name"]
    rows = out.collect()
    assert len(rows) == 3 and len({r.shard for r in rows if r.doc_id == 1}) == 1
    for r in rows:
        digest = hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()
        assert r.slot == int(digest[:15], 16) % 11
        assert r.shard == sharding.fill_table(["x", "y", "z"], 11)[r.slot] and r.shard_name == "xyz"[r.shard]
    assert sharding.place(df.limit(0), "doc_id", ["x"], 2).count() == 0
    for wrong in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(wrong, 11)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 12)
    sharding.write_shards(df, "doc_id", ["x", "y"], str(tmp_path / "out"), 11)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


# Licences


def test_notices_are_found_in_odd_texts(spark):
    apache = licenses.NOTICES["apache-2.0"]
    noise = " ".join(f"n{i}" for i in range(5000))
    texts = {
        1: apache,
        2: f"{noise} {apache.upper()} {noise}",
        3: "Licensed under the Apache License, Version 3.0.",  # two of three runs
        4: "",
        5: None,
        6: "Released under the\nMIT\tLicense!",
        7: "Released under the license of MIT",
        8: apache + " " + apache,
    }
    df = spark.createDataFrame([*texts.items(), (None, apache)], DOCS)
    got = {(r.doc_id, r.license, r.n_shared, r.n_notice, r.first_word) for r in licenses.find_notices(df).collect()}
    assert got == {
        (1, "apache-2.0", 3, 3, 0),
        (2, "apache-2.0", 3, 3, 5000),
        (6, "mit", 1, 1, 0),
        (8, "apache-2.0", 3, 3, 0),
        (None, "apache-2.0", 3, 3, 0),
    }
    assert licenses.find_notices(df.limit(0)).count() == 0
    assert licenses.find_notices(df, {"short": "too short"}).count() == 0


GNU = """{0} This {1} is free software; you can redistribute it and/or modify it under
{0} the terms of the GNU {2} as published by the Free
{0} Software Foundation; either version {3} of the License, or (at your option)
{0} any later version."""


def test_siblings_are_told_apart(spark):
    """Headers that differ in a name or a version, in blocks of comments."""
    gnu = {
        "gpl-2.0-header": ("program", "General Public License", "2"),
        "gpl-3.0-header": ("program", "General Public License", "3"),
        "lgpl-2.1-header": ("library", "Lesser General Public License", "2.1"),
        "lgpl-3.0-header": ("library", "Lesser General Public License", "3"),
        "agpl-3.0-header": ("program", "Affero General Public License", "3"),
    }
    rows, want = [], {}
    for k, (name, parts) in enumerate(gnu.items()):
        for j, mark in enumerate((" *", "#", "//", "")):
            rows.append((10 * k + j, "int x; /*\n" + GNU.format(mark, *parts) + "\n */ more"))
            want[10 * k + j] = {name}
    rows.append((100, "\n".join(" * " + line for line in licenses.NOTICES["bsd-3-clause"].split(". "))))
    rows.append((101, licenses.NOTICES["bsd-2-clause"]))
    want |= {100: {"bsd", "bsd-3-clause"}, 101: {"bsd", "bsd-2-clause"}}
    for k, (name, text) in enumerate(licenses.NOTICES.items()):
        rows.append((200 + k, "x y z " + text))
        want[200 + k] = {name}
    got = {}
    for r in licenses.find_notices(spark.createDataFrame(rows, DOCS)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    for key, names in want.items():
        assert names <= got[key]
        # What else is found is a part of the notice.
        for other in got[key] - names:
            small, large = shingles_of(licenses.NOTICES[other]), set.union(*[shingles_of(licenses.NOTICES[n]) for n in names])
            assert len(small & large) >= 0.8 * len(small)
    for key in range(0, 50, 10):
        assert got[key] == want[key] and not {n for n in got[key] if n.startswith("gpl-3")} - want[key]


def shingles_of(text):
    plain = text.translate(str.maketrans(licenses.FROM[:26], licenses.TO, licenses.FROM[26:])).split()
    kept = [w for w in plain if w.strip(licenses.MARKS)]
    return {tuple(kept[i : i + 5]) for i in range(len(kept) - 4)}


def test_windows_agree_with_the_notices_they_hold(spark):
    """Four fifths of a notice in a window of its class: bands agree but for 2 in 10,000."""
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 4, 8, 31, 100):
        size_class = n.bit_length() - 1
        shared, missed = -(-4 * n // 5), 0
        x = rng.integers(-(2**63), 2**63, (4000, (3 << size_class) + n - shared), dtype=np.int64)
        for row in x:
            sets = [row[: 3 << size_class], np.concatenate([row[:shared], row[3 << size_class :]])]
            low = []
            for own in sets:
                own = np.sort(own)
                band = own >> (64 - licenses.bits_of(size_class))
                low.append(set(own[np.append(True, band[1:] != band[:-1])].tolist()))
            missed += not low[0] & low[1]
        assert missed <= 3, n
    notice = spark.sql("SELECT array(5L, -7L, 9L, 1L << 62) AS h")
    assert notice.select(licenses.band_minima(F.col("h"), 1)).first()[0] == [-7, 5]


# Decontamination


def planted(items, noise):
    """Texts that hold a part of an item between noise, and whether that is 0.8 of its shingles."""
    rows = []
    for n, (item, text) in enumerate(items):
        w = text.split()
        for k, share in enumerate((1.0, 0.9, 0.7, 0.4)):
            own = w[: max(1, round(len(w) * share))]
            at = (37 * n + 11 * k) % 400
            rows.append((1000 + 10 * n + k, " ".join(noise[:at] + own + noise[at : at * 20])))
    return rows


def test_items_in_documents_equal_all_pairs(spark, documents, plain_rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    noise = [f"z{i}" for i in range(9000)]
    rows = plain_rows + planted(items, noise) + [(1, ""), (2, None), (3, items[0][1]), (3, items[0][1])]
    sets = {i: shingles(t) for i, t in items}
    want = Counter()
    for key, text in rows:
        own = shingles(text)
        for i, s in sets.items():
            if s and 5 * len(s & own) >= 4 * len(s):
                want[key, i, len(s & own), len(s)] += 1
    df = spark.createDataFrame(rows, DOCS)
    benchmark = spark.createDataFrame([*items, (None, "a b c d e f"), (999, None), (998, " ")], "item_id long, text string")
    for block in (7, 20_000):
        got = decontaminate.contained_items(df, benchmark, block_items=block).collect()
        assert Counter(tuple(r) for r in got) == want
    clean = decontaminate.decontaminate(df.withColumn("ITEM_ID", F.lit(1)), benchmark)
    assert clean.columns == ["doc_id", "text", "ITEM_ID"]
    holds = [any(s and 5 * len(s & shingles(t)) >= 4 * len(s) for s in sets.values()) for _, t in rows]
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(r for r, h in zip(rows, holds) if not h)
    assert decontaminate.contained_items(df.limit(0), benchmark).count() == 0
    assert decontaminate.contained_items(df, benchmark.limit(0)).count() == 0
    assert decontaminate.decontaminate(df, benchmark.limit(0)).count() == len(rows)
    blocks = decontaminate.decontaminate(df, benchmark, block_items=7)
    assert sorted(r.doc_id for r in blocks.collect()) == sorted(r.doc_id for r in clean.collect())


def test_rows_without_a_key_go_by_their_own_text(spark):
    benchmark = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    rows = [(None, "a clean text"), (None, "x one two three four five six y"), (None, None), (7, ""), (7, "one two three four five six")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"_leak": F.lit(1), "_searched_text": F.lit(2)})
    out = decontaminate.decontaminate(df, benchmark)
    assert out.columns == df.columns
    assert {(r.doc_id, r.text) for r in out.collect()} == {(None, "a clean text"), (None, None), (7, "")}


def test_short_items_agree_with_their_windows():
    """Two shingles of an item in a window of six: a band of 32 agrees but for 2 in a million."""
    rng = np.random.default_rng(9)
    index = decontaminate.Index([1], ["a b c d e f"])
    x = rng.integers(0, 2**64, (100_000, 6), dtype=np.uint64)
    missed = 0
    for begin in range(0, len(x), 2000):
        part = x[begin : begin + 2000]
        index.classes = {1: []}
        for k in index.constants:
            low = decontaminate.ordered(part[:, 2:4], k).min(axis=1)
            order = np.argsort(low, kind="stable")
            index.classes[1].append((low[order], order, np.ones(1 << 16, bool)))
        found = index.candidates(part.ravel(), np.arange(len(part) + 1) * 6)
        missed += len(part) - int((found[:, 0] == found[:, 1]).sum())
    assert missed <= 3


# Components


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 299), (299, 300)]
    found = components.components(spark.createDataFrame([*edges, (None, 5)], "u long, v long"))
    got = {r.node: r.component for r in found.collect()}
    want = {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)} | {299: 299, 300: 299}
    assert got == want
    assert components.components(found.limit(0).selectExpr("node as u", "component as v")).count() == 0


# Scores from the filter


def score(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return {r.doc_id: r for r in ngram_filter.score_documents(df, held).collect()}


@pytest.mark.parametrize("head", [1 << 20, 300, 0])
def test_base_scores_are_exact(spark, plain_rows, monkeypatch, head):
    monkeypatch.setattr(ngram_filter, "HEAD_WORDS", head)
    rows = [*plain_rows, (90001, ""), (90002, None), (90003, "the " * 3000), (90004, "unheard-of")]
    got = score(spark, rows)
    for key, want in base_scores(rows).items():
        r = got[key]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert r.base_score == pytest.approx(want[4], rel=1e-9)


def test_parts_of_the_filter_give_the_same_scores(spark, plain_rows, monkeypatch):
    whole = score(spark, plain_rows)
    monkeypatch.setattr(ngram_filter, "SHARD_BYTES", 20_000)
    more = score(spark, plain_rows)
    monkeypatch.setattr(ngram_filter, "PART_BYTES", 15_000)
    parts = score(spark, plain_rows)
    monkeypatch.setattr(ngram_filter, "HEAD_WORDS", 300)
    joined = score(spark, plain_rows)
    for key, r in whole.items():
        assert joined[key].score == pytest.approx(parts[key].score, rel=1e-9)
        assert parts[key].score == pytest.approx(more[key].score, rel=1e-9)
        assert parts[key].n_tokens == r.n_tokens and parts[key].base_score == pytest.approx(r.base_score)
        assert r.score < 0 and more[key].score == pytest.approx(r.score, rel=0.05)


def plain_scores(rows, priors=ngram_filter.PRIORS):
    """doc_id -> score by the formula, on exact counts of words and level means of exact counts of pairs."""
    tokens = {key: [*words(text), "end"] for key, text in rows}
    train = [key for key in tokens if not held_out(key)]
    c1 = Counter(t for key in train for t in tokens[key])
    before = {key: ["begin", *tokens[key][:-1]] for key in tokens}
    c2 = Counter(p for key in train for p in zip(before[key], tokens[key]))
    sums = {}
    for c in c2.values():
        total = sums.setdefault(c.bit_length(), [0, 0])
        total[0], total[1] = total[0] + 1, total[1] + c
    mean = {level: c / n for level, (n, c) in sums.items()}
    n, n1 = sum(c1.values()), sum(c == 1 for c in c1.values())
    unseen = min(max(n1 / n, 1e-9), 0.5)
    single = lambda c: (1 - unseen) * c / n if c > 0 else unseen

    def score(key, prior, out):
        total = 0.0
        for h, w in zip(before[key], tokens[key]):
            own, ch = c1[w], c1["end"] if h == "begin" else c1[h]
            pair = min(mean[c2[h, w].bit_length()], own, ch) if c2[h, w] else 0
            total += log10((max(pair - out, 0) + prior * single(max(own - out, 0))) / (max(ch - out, 0) + prior))
        return total

    best = max(priors, key=lambda prior: sum(score(key, prior, 1) for key in train))
    return {key: score(key, best, 0) for key in tokens}, best


@pytest.mark.parametrize("head, bits, apart", [(1 << 20, 512, 1e-9), (300, 512, 1e-9), (1 << 20, ngram_filter.BITS, 0.05)])
def test_scores_equal_the_formula(spark, plain_rows, monkeypatch, head, bits, apart):
    """With so many bits that the filter makes no error, whether words are broadcast or joined; else nearly."""
    monkeypatch.setattr(ngram_filter, "BITS", bits)
    monkeypatch.setattr(ngram_filter, "HEAD_WORDS", head)
    rows = [*plain_rows, (90001, ""), (90002, None), (90003, "the " * 3000), (90004, "unheard-of")]
    got = score(spark, rows)
    want, prior = plain_scores(rows)
    assert {r.prior for r in got.values()} == {prior}
    for key, own in want.items():
        assert got[key].score == pytest.approx(own, rel=apart)


def test_a_very_long_text_is_scored(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(1, long), (2, "w1 w2"), (3, long + " w1")]
    for key, want in base_scores(rows).items():
        r = score(spark, rows)[key]
        assert (r.n_tokens, r.n_known) == want[1:3] and r.base_score == pytest.approx(want[4], rel=1e-9)


def test_model_is_better_than_base_on_held_out_texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    out = [r for r in score(spark, rows).values() if r.held_out]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_model_learns_word_order(spark):
    """Pairs of a fixed order get far more than the words by themselves."""
    text = " ".join(f"p{i % 50}" for i in range(1000))
    rows = [(i, text) for i in range(60)]
    r = next(r for r in score(spark, rows).values() if r.held_out)
    assert r.score > 0.2 * r.base_score


def test_filter_never_reads_too_low():
    rng = np.random.default_rng(1)
    hashes = W.mix(np.arange(20_000, dtype=np.uint64))
    levels = rng.integers(1, 5, len(hashes))
    size, bits = ngram_filter.Filter.fill(hashes, levels)
    own = ngram_filter.Filter(np.array([size]), bits)
    shard = np.zeros(len(hashes), np.int64)
    read = own.levels(hashes, shard)
    assert (read >= levels).all() and (read == levels).mean() > 0.9
    others = own.levels(W.mix(np.arange(30_000, 60_000, dtype=np.uint64)), np.zeros(30_000, np.int64))
    assert (others > 0).mean() < 0.04


def test_scoring_without_training_or_rows(spark):
    key = next(k for k in range(100) if held_out(k))
    got = score(spark, [(key, "a b")])[key]
    assert (got.n_tokens, got.n_known, got.train_tokens) == (3, 0, 0)
    assert got.base_score == pytest.approx(3 * log10(0.1 / 0.1))
    df = spark.createDataFrame([], DOCS)
    assert ngram_filter.score_documents(df, F.lit(False)).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a"), (None, "b")], DOCS).withColumn("H", F.lit(1))
    rows = {r.doc_id: r.n_tokens for r in ngram_filter.score_documents(twice, F.lit(None).cast("boolean")).collect()}
    assert rows == {1: 5, None: 2}


# Kneser-Ney


def plain_model(texts, order=kneser_ney.ORDER):
    """Probability of a byte after others, by the definition of the model."""
    data = [b"\x02" * (order - 1) + t.encode() + b"\x03" for t in texts]
    counts = {order: Counter(d[i : i + order] for d in data for i in range(len(d) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts, total, left = {}, {}, {}
    for k in counts:
        n = Counter(counts[k].values())
        n1, n2, n3, n4 = (max(n[i], 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        cuts[k] = [min(max(d, 0.05), (i + 1) * 0.95) for i, d in enumerate(raw)]
        total[k], left[k] = Counter(), Counter()
        for g, c in counts[k].items():
            total[k][g[:-1]] += c
            left[k][g[:-1]] += cuts[k][min(c, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 257
        h = g[:-1]
        if not total[k][h]:
            return p(g[1:])
        c = counts[k][g]
        own = c - cuts[k][min(c, 3) - 1] if c else 0
        return own / total[k][h] + left[k][h] / total[k][h] * p(g[1:])

    return lambda text: sum(
        np.log(p(d[i : i + order])) for d in [b"\x02" * (order - 1) + text.encode() + b"\x03"] for i in range(len(d) - order + 1)
    )


@pytest.mark.parametrize("entries", [1 << 22, 3000])
def test_kneser_ney_equals_its_definition(spark, plain_rows, entries):
    train = [t for _, t in plain_rows[:40]]
    probe = ["", "the ofan", "QQ!!", "Äé", *[t[:300] for _, t in plain_rows[60:70]]]
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in train], "text string"))
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(probe)], "row_key long, text string, lang string")
    want = plain_model(train)
    for r in kneser_ney.scores(df, model, entries).collect():
        assert r.n == len(probe[r.row_key].encode()) + 1
        assert r.logp == pytest.approx(want(probe[r.row_key]), rel=1e-4)


def test_classifier_keeps_text_and_drops_noise(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    noise = [(10**6 + i, " ".join(f"#{(i * 7919 + k) % 997}$%" for k in range(80)), "en") for i in range(20)]
    more = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(noise, "doc_id long, text string, lang string"))
    rows = kneser_ney.classify(more, labels).collect()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    good = [r for r in rows if quality.get(r.doc_id) == 1]
    assert sum(r.kept for r in good) > 0.97 * len(good)
    assert not any(r.kept for r in rows if r.doc_id >= 10**6)


def test_classifier_keeps_text_of_a_rare_language(spark):
    """A rare language far from the model has a threshold at its own level, one without trusted text that of all."""
    rng = np.random.default_rng(3)
    common = lambda: " ".join(rng.choice(["the", "of", "and", "text", "word"], rng.integers(8, 60)))
    rare = lambda: "".join(rng.choice(list("дежзиклмнопр"), 200))
    rows = [(i, common(), "en") for i in range(600)] + [(1000 + i, rare(), "xx") for i in range(60)] + [(2000, rare(), "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in [*range(500), 1000, 1001]], "doc_id long, quality int")
    got = {r.doc_id: r for r in kneser_ney.classify(df, labels).collect()}
    new = [got[1000 + i] for i in range(2, 60)]
    assert sum(r.kept for r in new) > 0.8 * len(new) and sum(got[i].kept for i in range(500, 600)) > 95
    assert got[1000].threshold > got[2000].threshold > 0 and not got[2000].kept


def test_classifier_in_odd_cases(spark):
    docs = spark.createDataFrame([(1, "some text", "en"), (2, None, None), (None, "x", "en"), (1, "more", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = kneser_ney.classify(docs, none).collect()
    assert sorted((str(r.doc_id), r.kept) for r in rows) == [("1", True), ("2", True), ("None", True)]
    assert kneser_ney.classify(docs.limit(0), none).count() == 0
    some = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (None, 1)], "doc_id long, quality int")
    assert kneser_ney.classify(docs, some).count() == 3


# Pipeline


def test_pipeline_equals_plain_python(spark):
    base = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    items = [shingles(r.text) for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()]
    table, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.fit(table, labels)
    verdict = {r.doc_id: r.probability for r in quality_rules.quality(table, model).collect()}
    kept = []
    for key, text in docs:
        n_words, _, _, _, repeated = base_counts(text)
        likely = verdict[key] is None or verdict[key] >= quality_rules.KEEP_FROM
        if n_words >= 20 and 100 * repeated <= 30 * n_words and likely:
            kept.append((key, text))
    cut = without_repeats(kept)
    kept = [(k, t) for k, (t, n) in cut.items() if not n or words(t)]
    parts = near(kept, corpus_pipeline.NEAR)
    kept = [(k, t) for k, t in kept if parts[k][1] == k]
    kept = [(k, t) for k, t in kept if not any(s and 5 * len(s & shingles(t)) >= 4 * len(s) for s in items)]
    got = corpus_pipeline.run(spark, base).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in kept}
    assert all(r.same for r in got) and 50 < len(got) < len(docs)


def test_near_stage_takes_copies_from_four_fifths_on(spark):
    text = [f"w{i}" for i in range(104)]
    other = [*text[:91], *[f"v{i}" for i in range(9)]]  # 87 of 109 shingles
    close = [*text[:94], *[f"u{i}" for i in range(10)]]  # 90 of 110
    rows = [(1, " ".join(text)), (2, " ".join(close)), (3, " ".join(other))]
    df = spark.createDataFrame(rows, DOCS)
    assert {k: v[1] for k, v in near(rows, 80).items()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, df, SMALL).collect()} == {1, 3}


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_all_operators_are_registered():
    import __spark_entry__ as driver

    names = driver.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None
