import math
import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F
import pytest

from antecede.functions import numeric as nm, text as tx
from antecede.functions.stopwords import STOPWORDS
from antecede.operators.tokens import token_table
from brute import sentence_of, starts, token_index, tokens

SLOW = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
TEXTS = st.text(alphabet="aB1 .!?,\n\té*#[]世😀", max_size=40)


def column(spark, values, kind, make):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(make(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "text, off, expected",
    [("ab cd ef", 3, 1), ("ab cd ef", 6, 1), ("ab cd ef", 4, 1), ("ab", 0, -1), ("", 0, -1), ("ab cd ef", 0, 0)],
)
def test_char_to_token_golden(spark, text, off, expected):
    df = spark.createDataFrame([(text, off)], "t string, o int")
    assert df.select(tx.char_to_token(F.col("t"), F.col("o"))).first()[0] == expected


@SLOW
@given(cases=st.lists(st.tuples(TEXTS, st.integers(0, 39)), min_size=1, max_size=60))
def test_offsets_match_brute_force(spark, cases):
    cases = [(t, min(o, max(len(t) - 1, 0))) for t, o in cases]
    df = spark.createDataFrame(cases, "t string, o int")
    t, o = F.col("t"), F.col("o")
    rows = df.select(
        "t", "o", tx.tokens(t), tx.token_starts(t), tx.char_to_token(t, o), tx.token_to_sentence(t, o)
    ).collect()
    for text, off, toks, at, index, sent in rows:
        assert toks == tokens(text)
        assert at == starts(text)
        assert index == token_index(text, off)
        assert sent == sentence_of(text, off)[0]


def test_bins(spark):
    got = column(spark, [-9, -8, 0, 1, 6, 64, 65], "int", nm.distance_bin)
    assert got == [0, 0, 4, 4, 9, 12, 13]
    assert column(spark, [0, 1, 6, 64, 65], "int", nm.distance_bin9) == [0, 0, 5, 8, 9]


def test_onehot_clamps(spark):
    for hot in column(spark, [64, 1000], "int", nm.bucket_onehot):
        assert hot == [0] * 8 + [1]
    assert column(spark, [-3], "int", nm.bucket_onehot)[0] == [1] + [0] * 8


def test_text_columns(spark):
    assert column(spark, ["http://x/y/Z_z", "plain"], "string", tx.title_of) == ["Z_z", "plain"]
    assert column(spark, ["A#b"], "string", tx.normalise_text) == ["a*b"]
    assert column(spark, ["##ing x"], "string", tx.piece_length) == [4]
    assert column(spark, [" a  b\n"], "string", tx.nonspace_length) == [3]
    assert column(spark, [" One two. \n Three! four "], "string", tx.sentences) == [["One two.", "Three!", "four"]]


def test_softmax_clamp(spark):
    got = column(spark, [[0.0, 0.0, 100.0], [1.0, 1.0, 1.0]], "array<double>", nm.softmax_clamp)
    assert got[0] == [1e-4, 1e-4, 1 - 1e-4]
    assert all(math.isclose(p, 1 / 3) for p in got[1])


def test_coin_is_seeded_and_fair(spark):
    ids = spark.range(20_000)
    first = ids.select(F.avg(nm.coin(0.5, 7, F.col("id")).cast("int"))).first()[0]
    assert abs(first - 0.5) < 0.02
    flips = ids.select(nm.coin(0.3, 7, F.col("id")).alias("c"), nm.coin(0.3, 7, F.col("id")).alias("d"))
    assert flips.filter("c <> d").count() == 0


def test_token_table_makes_only_what_is_asked_for(spark):
    """The shapes, flags and starts of each token by itself, and starts that are not asked for are not made."""
    text = "aaaaa abcd dddd12345 X1y XXXXXX éa Zed x  #12x McDonaldX\nThe 0000000d"
    df = spark.createDataFrame([(1, text), (2, None), (3, " ")], "id long, text string")
    table = token_table(df)
    got = [(r.start, r.token, r["shape"], r.is_alpha, r.is_stop) for r in table.orderBy("pos").collect()]
    want = []
    for m in re.finditer(r"[A-Za-z0-9]+|[^ \t\n\x0b\f\r]", text):
        drawn = re.sub("[0-9]", "\0", re.sub("[A-Z]", "X", re.sub("[a-z]", "x", m[0]))).replace("\0", "d")
        own = re.sub(r"([xXd])\1{4,}", r"\1\1\1\1", drawn)
        want.append((m.start(), m[0], own, bool(re.fullmatch("[A-Za-z]+", m[0])), m[0].lower() in STOPWORDS))
    assert got == want
    plan = table.select("id", "pos", "token", "shape")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "split(" in table._jdf.queryExecution().optimizedPlan().toString()
