import pytest
from pyspark.sql import functions as F

from brindle.functions import names as N
from brindle.functions.places import province_code
from brindle.operators import search as S


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(("a", "b", "want"), [("word", "two words", 0.8), ("word", "word", 1.0), ("word", "", 0.0), ("", "word", 0.0), ("word", None, None)])
def test_word_similarity(spark, a, b, want):
    got = one(spark, S.word_similarity(F.lit(a), F.lit(b).cast("string")))
    assert got == want


def test_label_search(spark):
    rows = [(1, "Manage staff", ["lead teams"]), (2, None, ["staff"]), (3, "Cook", None), (4, "c", [None, "code"]), (5, None, None)]
    df = spark.createDataFrame(rows, "k long, label string, aliases array<string>")
    found = S.label_search(df, "k", F.col("label"), F.col("aliases"), "Stäff", 9).collect()
    assert [(r.k, r.matched_alias) for r in found] == [(2, "staff"), (1, None)]
    short = S.label_search(df, "k", F.col("label"), F.col("aliases"), "co", 9).collect()
    assert sorted(r.k for r in short) == [3, 4] and all(r.score >= 0.1 for r in short)
    assert S.label_search(df.limit(0), "k", F.col("label"), F.col("aliases"), "x", 9).count() == 0


@pytest.mark.parametrize(
    ("wanted", "text", "want"),
    [("libr", "The public libraries", True), ("libraries books", "books in a library", True), ('"public library"', "library public", False), ('"public library"', "our public libraries", True),
     ("library -public", "public library", False), ("cats or dogs x", "a cat", True), ("the of", "the of", True), ("", "x", False), ("water x", None, False)],
)
def test_full_text(spark, wanted, text, want):
    assert one(spark, S.matches(S.lexemes(F.lit(text).cast("string")), wanted)) is want


@pytest.mark.parametrize(
    ("name", "key"),
    [("Org | Apply (2 positions)", "org"), ("Org (2 positions) | Apply", "org"), ("Org – 3 postes", "org"), ("Habitat-Home", "habitat home"), ("Centre for Ecology (CCFE)", "centre for ecology"),
     ("Café et Thé & Co.", "cafe and the and co"), ("Group (west)", "group west"), (None, ""), ("Black Table Farm | About", "black table farm")],
)
def test_organization_key(spark, name, key):
    assert one(spark, N.organization_key(F.lit(name).cast("string"))) == key


def test_provinces(spark):
    assert [one(spark, province_code(F.lit(x))) for x in ("Québec", " on ", "Texas")] == ["QC", "ON", None]
