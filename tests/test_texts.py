import pytest
from pyspark.sql import functions as F

from brindle.functions import numbers, places
from brindle.functions import text as T
from brindle.operators import incremental, matching
from brindle.sources import selectors


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def lit(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(("text", "want"), [("1er févr. 2024", "2024-02-01"), ("March 5, 2024", "2024-03-05"), ("31 juin 2024", None), ("le 14 juillet 2023", "2023-07-14"), ("15 août 2022", "2022-08-15"), ("soon", None), (None, None)])
def test_french_day(spark, text, want):
    assert one(spark, numbers.french_day(lit(text)).cast("string")) == want


@pytest.mark.parametrize(
    ("text", "city", "kind", "us"),
    [("Remote in Canada or USA", None, "remote", False), ("Boston, MA", None, "office", True), ("télétravail", "Laval", "hybrid", False), ("Paris, Texas", None, "office", True), ("Toronto, ON", None, "office", False),
     ("Nationwide, US", None, "office", True), ("Austin TX", None, "office", True), ("Portland, OR, United States", None, "office", True), ("Work in us, or me", None, "office", True), ("Reno, NV 89501", None, "office", False),
     ("Washington, District of Columbia", None, "office", True), ("U.S. remote", None, "remote", True), ("on us", None, "office", False), ("Ottawa, Canadian office", None, "office", False), ("office 3 days, remote 2", None, "hybrid", False), (None, None, "office", False), ("Flexible", "", "hybrid", False), ("promoted remotely.", " ", "remote", False)],
)
def test_places(spark, text, city, kind, us):
    assert one(spark, places.work_type(lit(text), lit(city))) == kind
    assert one(spark, places.us_only(lit(text))) is us


def test_accents_and_languages(spark):
    folded = {"Œuvre": "OEuvre", "Straße": "Strasse", "Łódź": "Lodz", "e\u0301te\u0301": "ete", "Þ字": "Þ字", "ĀăĘșŻǎẽ": "AaEsZae", "Æsop": "AEsop"}
    for text, want in folded.items():
        assert one(spark, T.unaccent(lit(text))) == want
    say = lambda n, en, fr, accents: one(spark, T.language_of(*map(F.lit, (n, en, fr, accents))))
    assert [say(39, 9, 0, 0), say(99, 9, 0, 0), say(99, 1, 0, 1), say(99, 0, 1, 4), say(99, 4, 4, 0), say(99, 2, 3, 0), say(99, 4, 1, 9)] == [None, "en", None, "fr", "bilingual", None, "bilingual"]


def test_language_shares_are_exact(spark):
    """A share that is just met counts: 7 of 25 and 14 of 50 are 0.28."""
    df = spark.createDataFrame([(99, 18, 7, 0), (99, 36, 13, 2), (99, 36, 13, 1), (99, 2, 31, 0)], "n long, en long, fr long, a long")
    said = [r[0] for r in df.select(T.language_of(*map(F.col, df.columns))).collect()]
    assert said == ["bilingual", "bilingual", "en", "fr"]


def test_texts(spark):
    assert one(spark, places.unglued(lit("EloraEloraElora, ON"))) == "Elora, ON"
    assert one(spark, places.unglued(lit("Elora Elora"))) == "Elora Elora"
    assert one(spark, T.labeled(lit("Location: Laval  Salary: 5"), ["salary"], ["location"])) == "5"
    assert one(spark, T.labeled(lit("Location:  \nx"), ["location"], [])) is None
    assert one(spark, T.tags(F.array(lit(" Été-Job "), lit("ete job"), lit("--"), lit(None), lit("b" * 60)))) == ["ete_job", "b" * 48]
    assert one(spark, T.tags(F.lit(None).cast("array<string>"))) == []
    assert one(spark, matching.phrase_similarity(F.lit(0.2), F.lit(0.9), F.lit(0.95), F.lit(0.4))) == 0.2
    assert one(spark, matching.phrase_similarity(F.lit(0.4), F.lit(0.9), F.lit(0.95), F.lit(0.4))) == 0.95


def test_greedy_batches(spark):
    rows = [(i, "a" if i % 3 else None, None if i == 4 else float(i % 7)) for i in range(60)]
    got = incremental.greedy_batches(spark.createDataFrame(rows, "k long, g string, w double"), "g", "k", "w", 10).collect()
    assert sorted(r.k for r in got) == list(range(60))
    batches = {}
    for r in sorted(got, key=lambda r: r.k):
        batches.setdefault((r.g, r.batch), []).append(r.w or 0)
    assert all(sum(b) <= 10 for b in batches.values())
    assert all(sum(b) + batches[g, n + 1][0] > 10 for (g, n), b in batches.items() if (g, n + 1) in batches)


def test_named_references_alone_are_decoded():
    """As the SQL of page_fields has it: cut and other references stay as they are."""
    steps = [selectors.parse(s) for s in ("h1", "a@href")]
    page = "<h1>a &amp;lt; &lt;b&amp &quot;c&quot; &#65;</h1><a href='?x=1&quot;'>"
    assert selectors.fields(page, steps, ("lt", "amp")) == ["a &lt; <b&amp &quot;c&quot; &#65;", "?x=1&quot;"]
    assert selectors.fields(page, steps) == ['a &lt; <b& "c" A', '?x=1"']
    assert selectors.fields(page, steps, ())[0] == "a &amp;lt; &lt;b&amp &quot;c&quot; &#65;"
