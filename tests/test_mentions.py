import pytest
from pyspark.sql import functions as F

from antecede.operators import checks, features, joins, labels, lexicon, sequences, tokens
from brute import sentence_of, tokens as brute_tokens


def test_target_rules(spark):
    df = spark.createDataFrame([(True, False), (False, True), (False, False), (True, True)], "a_coref boolean, b_coref boolean")
    assert [r.target for r in labels.extract_target(df).collect()] == [0, 1, 2, 1]
    assert [r.neither for r in labels.extract_target(df).collect()] == [0, 0, 1, 0]
    assert [r.label for r in labels.coref_label(df).collect()] == ["A", "B", "Neither", "B"]


def test_unknown_labels_stay_unknown(spark):
    df = spark.createDataFrame([(None, None), (None, True), (False, None)], "a_coref boolean, b_coref boolean")
    assert [r.target for r in labels.extract_target(df).collect()] == [None, 1, 2]
    assert [r.label for r in labels.coref_label(df).collect()] == [None, "B", "Neither"]


def test_rows_without_address_or_tokens_stay(mentions):
    rows = mentions([("Ann Bo he", "he", "Ann", "Bo")]).withColumn("url", F.lit(None).cast("string"))
    cut = tokens.mention_segments(rows)
    assert cut.first()["tokens"] == ["ann", "bo", "he"]
    vocab = sequences.build_vocab(cut.select(F.explode("tokens").alias("token")))
    more = cut.select("id", "tokens").unionByName(cut.select(F.lit(9).cast("bigint").alias("id"), F.lit(None).cast("array<string>").alias("tokens")))
    got = {r.id: r.ids for r in sequences.encode_tokens(more, vocab).collect()}
    assert got[9] == [101] and len(got[0]) == 4 and 100 not in got[0]


def test_prior(mentions):
    df = mentions([("Ann Bo he", "he", "Ann", "Bo"), ("Ann Bo he", "he", "Bo", "Ann"), ("he Ann Bo", "he", "Ann", "Bo")])
    got = [(r.pr_a, r.pr_b, round(r.pr_neither, 9)) for r in labels.positional_prior(df).orderBy("id").collect()]
    assert got == [(0.45, 0.45, 0.1), (0.4, 0.3, 0.3), (0.4, 0.45, 0.15)]


def test_mask_and_section(one):
    row = labels.mention_section(one).first()
    assert row["mask"] == "BBBBBBB*****AAA*******PP" + "*" * 6
    assert row["section_text"] == "Bob Lee saw Ann. Then he"
    assert len(row["section_mask"]) == len(row["section_text"])


def test_segments_golden(one):
    row = tokens.mention_segments(one).first()
    assert row["tokens"] == "bob lee saw ann . then he left . bob _ lee".split()
    s = row["spans"]
    assert (s.a_start, s.a_end, s.b_start, s.b_end, s.p_start, s.p_end) == (3, 3, 0, 1, 6, 6)
    assert (s.url_start, s.url_end) == (9, 11)


def test_segments_with_markers(one):
    row = tokens.mention_segments(one, markers=True).first()
    assert row["tokens"] == "bob lee saw ann . [SEP] then he left . [SEP] bob _ lee".split()
    assert (row["spans"].p_start, row["spans"].url_start) == (7, 11)


def test_open_tail_is_closed(mentions):
    df = mentions([("Ann saw Bo. Then he left. And so on", "he", "Ann", "Bo")])
    toks = tokens.mention_segments(df, markers=True).first()["tokens"]
    assert " ".join(toks).endswith("left . [SEP] and so on [SEP] bob _ lee")


def test_segments_keep_all_text(mentions):
    text = "Zed (he) met Ann Lee; Bo!  He # left\nlater? yes"
    df = mentions([(text, "he", "Ann Lee", "Bo"), (text, "He", "Bo", "Zed"), (text, "later", "Zed", "Ann Lee")])
    for row in tokens.mention_segments(df).collect():
        title = brute_tokens("bob_lee")
        assert row["tokens"] == brute_tokens(text.lower().replace("#", "*")) + title
        for slot, name in (("a", row["a"]), ("b", row["b"]), ("p", row["pronoun"])):
            start, end = row["spans"][f"{slot}_start"], row["spans"][f"{slot}_end"]
            assert row["tokens"][start : end + 1] == brute_tokens(name.lower())


def test_segments_by_name_are_lossy(one):
    row = tokens.mention_segments(one, order="name").first()
    assert row["tokens"][:5] == ["bob", "lee", "saw", "ann", "bob"]


def test_checks(one):
    assert checks.check_mentions(one).count() == 0
    moved = one.withColumn("p_off", F.col("p_off") + 1)
    assert checks.check_mentions(moved).collect() == [(0, "P", "he", "e ")]
    cut = tokens.mention_segments(one)
    assert checks.check_single_token_pronoun(cut).count() == 0
    wide = cut.withColumn("spans", F.col("spans").withField("p_end", F.lit(9)))
    assert checks.check_single_token_pronoun(wide).first()["p_end"] == 9


def test_template_check_goes_both_ways(spark):
    left = spark.createDataFrame([(1,), (2,)], "id long")
    right = spark.createDataFrame([(2,), (3,)], "id long")
    got = {(r.id, r.missing_from) for r in checks.check_template(left, right).collect()}
    assert got == {(3, "table"), (1, "template")}


@pytest.mark.parametrize(
    "a, b, url, mode, expected",
    [
        ("Zed", "Al", "/Al", "char", (0, 1)),
        ("Al", "Al Z", "/Al", "char", (1, 0)),
        ("*Al", "Zed", "/Al", "char", (1, 0)),
        ("Arno", "Al", "/Al", "char", (1, 0)),
        ("Arno", "Al Z", "/Al", "word", (0, 1)),
        (". x", "Q", "/Al", "char", (0, 0)),
        ("(x", "*", "/Al", "char", (0, 0)),
    ],
)
def test_url_cues(spark, a, b, url, mode, expected):
    df = spark.createDataFrame([(a, b, url)], "a string, b string, url string")
    row = features.url_contains(df, mode).first()
    assert (row.a_in_url, row.b_in_url) == expected
    code = features.url_contains3(df, mode).first().in_url
    assert code == {(1, 0): 0, (0, 1): 1, (0, 0): 2}[expected]


def test_distance_features_need_no_shuffle(one):
    plan = features.distance_features(one)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_word_tokens_need_no_shuffle(one):
    plan = tokens.word_tokens(one)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_sentence_positions(mentions):
    text = "Ann went. Bo, who was late, saw him there! And the end"
    df = mentions([(text, "him", "Ann", "Bo"), (text, "end", "Bo", "Ann"), ("Ann him", "him", "Ann", "Ann")])
    for r in features.sentence_position(df, p="p_off", a="a_off", b="b_off").collect():
        for m in "pab":
            sent, pos, length = sentence_of(r.text, r[f"{m}_off"])
            assert (r[f"{m}_sent"], r[f"{m}_pos"], r[f"{m}_len"], r[f"{m}_inv"]) == (sent, pos, length, length - pos)


def test_positional_features_are_45_wide(one):
    row = features.positional_features(one, "p_off", "a_off", "b_off").first()
    for values in (row.features_a, row.features_b):
        assert len(values) == 45 and sum(values) == 5.0
        assert all(sum(values[i : i + 9]) == 1.0 for i in range(0, 45, 9))


@pytest.mark.parametrize("place, first, last, pos", [(55, 7, 56, 48), (48, 0, 49, 48), (49, 1, 50, 48), (58, 10, 59, 48)])
def test_long_sentence_window(spark, place, first, last, pos):
    # The sentence under test is the second one, where positions count from 0.
    words = [f"w{i}" for i in range(60)]
    text = "Start. " + " ".join(words) + ". More follows"
    off = text.index(f"w{place}")
    row = (text, "x", off, "x", off, "x", off)
    df = spark.createDataFrame([(1, *row)], "id long, text string, pronoun string, p_off int, a string, a_off int, b string, b_off int")
    got = features.mention_sentence_window(df).first()
    window = got.p_window.split(" ")
    sentence = [*words, "."]
    assert window == sentence[first : last + 1]
    assert got.p_window_pos == pos and window[pos] == f"w{place}"


def test_markers(mentions):
    df = mentions([("Ann. Bo he", "he", "Ann", "Bo"), ("Ann Bo he", "he", "Ann", "Bo")])
    got = [r.marked for r in tokens.sentence_markers(df).orderBy("id").collect()]
    assert got == ["[CLS] Ann. [SEP] Bo he [SEP]", "[CLS] Ann Bo he [SEP] "]


def test_token_table(spark):
    df = spark.createDataFrame([(1, "The Xylophones of 12345!")], "id long, text string")
    got = [(r.shape, r.is_alpha, r.is_stop) for r in tokens.token_table(df, ["the", "of"]).orderBy("pos").collect()]
    assert got == [("Xxx", True, True), ("Xxxxx", True, False), ("xx", True, True), ("dddd", False, False), ("!", False, False)]


def test_lexicon_keeps_both_genders(mentions):
    rows = [("Sam his Bo", "his", "Sam", "Bo"), ("Bo Sam her", "her", "Bo", "Sam"), ("Sam x Bo", "x", "Sam", "Bo"), ("Sam Her Bo", "Her", "Sam", "Bo")]
    got = {tuple(r) for r in lexicon.name_gender_lexicon(mentions(rows)).collect()}
    assert got == {("sam", 1), ("sam", 0)}
    genders = {r.pronoun: r.gender for r in joins.pronoun_gender(mentions(rows)).collect()}
    assert genders == {"his": 1, "her": 0, "x": None, "Her": 0}


def test_name_swap_keeps_offsets_right(spark, mentions):
    texts = [(f"{x} Ann met {y} Lee and he saw {x} Bo.", "he", "Ann", "Bo") for x in ("", "Oh,", "é") for y in ("a", "bb")]
    texts += [(f"Then he told Bo that Ann{'!' * i}", "he", "Ann", "Bo") for i in range(30)]
    df = mentions(texts)
    names = spark.createDataFrame(
        [("ann", 0), ("bo", 1), ("wilhelmina", 0), ("jo", 0), ("maximilian", 1)], "name string, gender int"
    )
    out = lexicon.name_swap_augment(df, names)
    assert checks.check_mentions(out).count() == 0
    assert out.count() == df.count()
    before = {r.id: r for r in df.collect()}
    changed = [r for r in out.collect() if r.text != before[r.id].text]
    assert changed and {r.a for r in changed} <= {"Ann", "ann", "wilhelmina", "jo"}


def test_overlapping_names_stay(spark, mentions):
    df = mentions([("Ann Lee he", "he", "Ann Lee", "Lee")] * 20)
    names = spark.createDataFrame([("ann lee", 0), ("lee", 0), ("eve", 0)], "name string, gender int")
    out = lexicon.name_swap_augment(df, names, p=1.0)
    assert [r.text for r in out.collect()] == ["Ann Lee he"] * 20


def test_mask_span_is_on_the_span(spark):
    df = spark.createDataFrame(
        [(i, [101, 7, 8, 9, 10, 11], (0, 1, 3, 3)) for i in range(200)],
        "id long, ids array<int>, spans struct<a_start:int,a_end:int,b_start:int,b_end:int>",
    )
    got = {tuple(r.ids) for r in lexicon.mask_span_augment(df).collect()}
    assert got == {(101, *a, 9, b, 11) for a in ((7, 8), (1, 1)) for b in (10, 2)}
    again = lexicon.mask_span_augment(df, epoch=1).exceptAll(lexicon.mask_span_augment(df, epoch=0))
    assert again.count() > 0
