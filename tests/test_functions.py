import pytest
from pyspark.sql import functions as F

from brindle.functions import numbers as N
from brindle.functions import text as T
from brindle.operators import curation, incremental, relational
from brindle.operators.components import connected_components


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"])
    return row.select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("2026-07-06", "2026-07-06 00:00:00"), ("2026-07-06T12:00:00Z", "2026-07-06 12:00:00"), ("2026-07-06T12:00:00", "2026-07-06 12:00:00"),
     ("2026-07-06T12:00:00+02:00", "2026-07-06 10:00:00"), ("2026-02-31", None), ("2026", None), ("", None), ("soon", None)],
)
def test_parse_posted(spark, text, want):
    assert one(spark, N.parse_posted(F.col("t")).cast("string"), t=text) == want


@pytest.mark.parametrize(("amount", "unit", "hours", "want"), [(2500, "HOUR", 40, 5200000), (500000, "MONTH", 1, 6000000), (12000000, "YEAR", 1, 12000000), (5, "ERA", 1, None)])
def test_annualize(spark, amount, unit, hours, want):
    assert one(spark, N.annualize(F.col("a"), F.col("u"), F.col("h")), a=amount, u=unit, h=hours) == want


def test_scalars(spark):
    assert one(spark, T.slug(F.lit("  Café - Été  No. 5! "))) == "cafe-ete-no-5"
    assert one(spark, T.clean(F.lit(" a\t\x00b \n"))) == "a b"
    assert one(spark, T.clean(F.lit(" \n"))) is None
    assert one(spark, T.normal_url(F.lit(" http://x/y// "))) == "http://x/y"
    assert one(spark, T.safe_url(F.lit("javascript:x"))) is None
    assert one(spark, T.domain(F.lit("https://www.Ex.org:80/a"))) == "ex.org"
    assert round(one(spark, T.trigram_similarity(F.lit("word"), F.lit("two words"))), 4) == 0.3636
    assert one(spark, T.tokens(F.lit("C++ and C#, Été"))) == ["cplusplus", "and", "csharp", "ete"]
    assert one(spark, T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0
    assert one(spark, T.marker_count(F.lit("the theme, and the end"), T.ENGLISH)) == 3
    assert one(spark, T.first_mapped(F.lit("Temps plein"), [("plein", "full"), ("temps", "other")])) == "full"
    assert one(spark, N.ago_days(F.lit("Posted 3 weeks ago"))) == 21
    assert one(spark, N.ago_days(F.lit("99999 days ago"))) is None
    assert one(spark, N.backoff(F.lit(20))) == 64
    assert one(spark, N.weighted_score([(F.lit(None).cast("double"), 0.5)])) is None
    assert one(spark, N.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert one(spark, N.rank_weight(F.lit(1), F.lit(0))) == 1.0
    assert round(one(spark, N.distance(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))) == round(3.141592653589793 * N.EARTH)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 6), (6, 7), (7, 7), (None, 3), (1, 2)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4}
    assert connected_components(links.where("a > 99")).count() == 0


def test_upsert_and_rename(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (4, "x")], "k long, v string")
    new = spark.createDataFrame([(1, "b"), (2, None), (3, "c")], "k long, v string")
    got = {r.k: (r.change, r.changed) for r in relational.upsert_diff(old, new, "k", ["v"]).collect()}
    assert got == {1: ("U", ["v"]), 2: ("N", []), 3: ("I", [])}
    names = spark.createDataFrame([(1, "a", "z"), (2, "b", "z"), (3, "c", "d"), (4, "e", None), (5, "f", "e")], "k long, n string, t string")
    got = {r.k: r.n for r in relational.guarded_rename(names, "k", "n", "t").collect()}
    assert got == {1: "a", 2: "b", 3: "d", 4: "e", 5: "f"}


def test_curation(spark):
    rows = spark.createDataFrame([("p", "Board Chair board"), ("p", "chair board"), ("p", "Treasurer"), ("q", "chair board"), ("p", None)], "b string, t string")
    assert curation.similar_titles(rows.withColumnRenamed("b", "blk"), "blk", "t").count() == 0  # the same words: one class
    assert {(r.b, r.t, r.title) for r in curation.title_classes(rows, "b", "t").collect()} == {("p", "Board Chair board", "Board Chair board"), ("p", "chair board", "Board Chair board"), ("p", "Treasurer", "Treasurer"), ("q", "chair board", "chair board")}
    more = spark.createDataFrame([("p", "Chair of Board"), ("p", "board chair"), ("p", "chair board"), ("p", "of it")], "blk string, t string")
    assert [(r.a, r.b) for r in curation.similar_titles(more, "blk", "t", 0.6).collect()] == [("Chair of Board", "board chair")]
    orgs = spark.createDataFrame([(1, "A", ["x"]), (2, "B", ["A", "y"]), (3, "C", None), (4, "D", None)], "k long, n string, al array<string>")
    merges = spark.createDataFrame([(2, 1), (3, 1), (1, 1)], "k long, survivor long")
    assert {(r.k, r.n, tuple(r.al)) for r in curation.merged(orgs, merges, "k", "n", "al").collect()} == {(1, "A", ("x", "B", "y", "C")), (4, "D", ())}


def test_limits(spark):
    rows = [(1, 1, "2024-01-01 00:00:00", True), (2, 1, "2024-01-01 00:00:30", True), (3, 1, "2024-01-01 00:01:00", False), (4, 2, "2024-01-01 00:01:00", False)]
    events = spark.createDataFrame(rows, "id long, u long, ts string, bad boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.id: r.prior_failures for r in incremental.trailing_failures(events, "u", "ts", F.col("bad")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


@pytest.mark.parametrize(
    ("text", "want"),
    [("25$/heure", ("HOUR", 2500, None, None, "CAD", 0.9)), ("60 000$ a 75 000$ par annee", ("YEAR", 6000000, 7500000, None, "CAD", 0.9)),
     ("28$ de l'heure, 35 heures/semaine", ("HOUR", 2800, 3500, 35, "CAD", 0.9)), ("some wage text with no numbers", (None, None, None, None, "CAD", 0.0)),
     ("$56,987.50", ("YEAR", 5698750, None, None, "CAD", 0.5)), ("26,78", ("HOUR", 2678, None, None, "CAD", 0.5)), ("40 EUR", (None, None, None, None, "EUR", 0.0)),
     ("2 001 $ par quinzaine", ("WEEK", 100050, None, None, "CAD", 0.5)), ("$1,500.01 to $2,000 biweekly", ("WEEK", 75000, 100000, None, "CAD", 0.9)),
     ("1,234,567.5 $ 12.5 an hour 1234 567 100 000", ("HOUR", 1250, 56710000000, None, "CAD", 0.5)), (" N/A", (None, None, None, None, None, 0.0)), ("9" * 40, (None, None, None, None, "CAD", 0.0))],
)
def test_pay(spark, text, want):
    from brindle.functions.pay import pay

    assert tuple(one(spark, pay(F.col("t")), t=text)) == want
