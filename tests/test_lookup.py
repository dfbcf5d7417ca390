import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from antecede.operators import lookup, sequences


def places(rows, values, default=None):
    """(key, positions, values) of rows by plain Python."""
    out = []
    for key, elements in rows:
        found = [(i, v) for i, e in enumerate(elements or []) for v in values.get(e, [] if default is None else [default])]
        out.append((key, [i for i, _ in found], [v for _, v in found]))
    return sorted(out, key=repr)


WORDS = [(i, [random.Random(i * 100 + j).choice(["a", "b", "é", "", "x y"]) for j in range(i % 9)]) for i in range(60)]
ROWS = [*WORDS, (60, None), (None, ["a", "zz", "b"]), (7, ["b"])]


@pytest.mark.parametrize("default", [None, 100])
def test_elements_meet_a_table(spark, default):
    """Elements with no value, one or two; rows that are null or come again."""
    df = spark.createDataFrame(ROWS, "key long, words array<string>").repartition(3)
    values = {"a": [1], "b": [2, 3], "x y": [4], "unused": [5]} if default is None else {"a": [1], "b": [2]}
    table = spark.createDataFrame([(w, v) for w, own in values.items() for v in own], "word string, value int")
    chunks = lookup.coded(df, "words")
    known = lookup.listed(chunks, "word").join(table, "word").select("id_chunk", "_code", "value")
    got = [(r.key, r["_pos"], r.value) for r in lookup.placed(chunks, known, default).collect()]
    assert sorted(((k, p, v) if default is None else (k, list(range(len(v))), v) for k, p, v in got), key=repr) == places(ROWS, values, default)
    assert all(p == sorted(p) for _, p, _ in got)


def test_chunks_hold_as_many_elements_or_one_row(monkeypatch):
    schema = pa.schema([("key", pa.int64()), ("words", pa.list_(pa.string()))])
    batches = [pa.RecordBatch.from_pylist([{"key": k, "words": w} for k, w in ROWS[i : i + 7]], schema) for i in range(0, len(ROWS), 7)]
    monkeypatch.setattr(lookup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    for size in (1, 5, 23, 1000):
        monkeypatch.setattr(lookup, "CHUNK", size)
        made = [r for b in lookup._chunks(iter(batches)) for r in b.to_pylist()]
        lists = {r["id_chunk"]: r["_listed"] for r in made if r["_listed"] is not None}
        rows = [r for r in made if r["_codes"] is not None]
        assert len(rows) == len(ROWS) and len(made) == len(rows) + len(lists) and min(lists) == 3 << 32
        assert [(r["key"], [lists[r["id_chunk"]][c] for c in r["_codes"]]) for r in rows] == [(k, w or []) for k, w in ROWS]
        sizes = {n: [len(r["_codes"]) + 1 for r in rows if r["id_chunk"] == n] for n in lists}
        assert all(sum(s) <= size or len(s) == 1 for s in sizes.values())
        assert all(len(set(own)) == len(own) for own in lists.values())


def test_an_id_that_comes_again_is_one_row(spark):
    """As long as its rows together, filled up with zeros, whether the id is known or null; other rows stay as they are."""
    rows = [(1, ["b"], "x"), (2, ["b", "c"], None), (2, ["b", "c"], "y"), (None, ["c"], "z"), (None, ["c"], None)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, note string")
    vocab = spark.createDataFrame([("[CLS]", 101), ("b", 7)], "token string, token_id int")
    got = sorted(((r.id, r.ids, r.note) for r in sequences.encode_tokens(df, vocab).collect()), key=repr)
    assert got == sorted([(1, [101, 7], "x"), (2, [101, 7, 100, 0, 0, 0], "y"), (None, [101, 100, 0, 0], "z")], key=repr)


def test_rows_are_not_shuffled(spark):
    """What moves is a chunk's distinct tokens and their ids."""
    df = spark.range(200).select("id", F.array_repeat(F.concat(F.lit("w"), F.col("id") % 5), 50).alias("tokens"))
    vocab = spark.createDataFrame([(f"w{i}", 200 + i) for i in range(5)], "token string, token_id int")
    coded = sequences.encode_tokens(df, vocab.hint("merge"))
    assert {tuple(r.ids) for r in coded.collect()} == {(100, *[200 + i] * 50) for i in range(5)}
    plan = coded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    at = next(i for i, line in enumerate(plan) if "_codes" in line and "Scan parquet" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    above, least = [], depth(plan[at])
    for line in reversed(plan[:at]):
        if depth(line) < least:
            above, least = [*above, line], depth(line)
    assert "Bucketed: true" in plan[at] and above and not any("Exchange" in line for line in above)
