"""Choices at their edges: answers, floors, options, orders."""

import json

from pyspark.sql import functions as F

from brindle.functions import extract
from brindle.operators import relational


def test_reranked(spark):
    known = ["a", "b", "c", "d"]
    cases = [
        (known, json.dumps({"selected": ["c", "x", "a", "c"]}), ["c", "a"]),
        (known, json.dumps({"selected": []}), ["a", "b", "c"]),
        (known, json.dumps({"selected": ["x"]}), ["a", "b", "c"]),
        (known, '{"selected": ["c", "a"', ["a", "b", "c"]),
        (known, json.dumps({"selected": "c"}), ["a", "b", "c"]),
        (known, json.dumps({"selected": ["d", None, "c", "b", "a"]}), ["d", "c", "b"]),
        (known, json.dumps(["c"]), ["a", "b", "c"]),
        (known, None, ["a", "b", "c"]),
        ([], json.dumps({"selected": ["a"]}), []),
        (None, json.dumps({"selected": ["a"]}), []),
    ]
    df = spark.createDataFrame([(i, k, a) for i, (k, a, _) in enumerate(cases)], "i int, k array<string>, a string")
    got = {r.i: r.v for r in df.select("i", extract.reranked(F.col("k"), F.col("a"), most=3).alias("v")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_selected(spark):
    rows = [("a", 1, 0.4), ("a", 2, 0.41), ("a", 3, None), ("a", 4, 0.9), ("a", 5, 0.41), (None, 6, 0.5), ("b", 7, 0.1)]
    df = spark.createDataFrame(rows, "g string, k int, score double")
    got = {(r.g, r.k): r.place for r in relational.selected(df, "g", "score", "k", most=2).collect()}
    assert got == {("a", 4): 1, ("a", 2): 2, (None, 6): 1}


def test_available_options(spark):
    owners = spark.createDataFrame([(1, "x", "p"), (2, "y", None), (3, "z", "q"), (None, "w", "r"), (4, "x", "p")], "id int, a string, b string")
    items = spark.createDataFrame([(1, True), (1, True), (2, True), (3, False), (3, None), (None, True), (4, True)], "o int, ok boolean")
    got = {tuple(r) for r in relational.available_options(owners, items, "id", "o", ["a", "b"], F.col("ok"), ["y"]).collect()}
    assert got == {("a", "x", 2), ("b", "p", 2)}
    assert relational.available_options(owners, items.limit(0), "id", "o", ["a", "b"], F.col("ok")).count() == 0


def test_directory_orders(spark):
    df = spark.createDataFrame([(1, "b", 5, None), (2, "a", None, 0.5), (3, None, 7, 0.9), (4, "b", 7, None)], "id int, name string, latest int, value_score double")
    order = lambda s: [r.id for r in df.orderBy(*relational.directory_order(s, "name", "id")).collect()]
    assert order("date-desc") == [4, 3, 1, 2]
    assert order("match-desc") == order("value-match-desc") == [3, 2, 1, 4]
    assert order("org-desc") == [1, 4, 2, 3]
    assert order(None) == order("?") == [2, 1, 4, 3]
