import re

import pytest
from pyspark.sql import functions as F

from brindle.functions.stems import STOPS, stem
from brindle.operators import inverted as I
from brindle.plans import searching


def by_loop(texts, wanted, language):
    """Keys of the texts that a search finds, word by word."""
    found = set()
    for key, text in texts.items():
        words = [None if w in STOPS[language] else stem(w, language) for w in re.findall(r"[^\W_]+", (text or "").lower())]
        there = lambda p: any((w or "").startswith(p.lexemes[0][1]) for w in words) if p.prefix else any(all(words[i + at : i + at + 1] == [x] for at, x in p.lexemes) for i in range(len(words)))  # noqa: B023, E731, E501
        if any(all(there(p) != p.minus for p in parts) for parts in I.parse(wanted, language)):
            found.add(key)
    return found


TEXTS = {
    1: "The public libraries of the city", 2: "public. Library", 3: "A library, public and free", 4: None, 5: "", 6: "...", 7: "Librarians do self-help", 8: "self help help self",
    9: "help " * 5000 + "self help", 10: "public libraries of a city", 11: "public libraries city", 12: "L'été des bibliothèques municipales",
}
SEARCHES = [
    "librar", "libraries", "the", "", '""', "the of", '"public library"', '"library public"', '"libraries of the city"', "library -free", "-public", '-"public library" -help', "self-help",
    'free or "help help self"', "or library or", 'library OR -"self help"', '"help help"', "Bibliothèques municipale", '"public libraries',
]


@pytest.mark.parametrize("language", ["en", "fr", "simple"])
def test_find(spark, language):
    docs = spark.createDataFrame([*TEXTS.items(), (None, "public library")], "k long, t string")
    index = I.stored(I.build(docs, "k", F.col("t"), language), "k")
    named = {str(i): s for i, s in enumerate(SEARCHES)}
    rows = [(r.search, r.k) for r in I.find(index, "k", named, language, docs.select("k")).collect()]
    assert len(rows) == len(set(rows))
    for name, wanted in named.items():
        assert {k for s, k in rows if s == name} == by_loop(TEXTS, wanted, language), wanted


def test_stop_words_keep_their_distance(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "k long, t string")
    index = I.build(docs, "k", F.col("t"), "en")
    got = I.find(index, "k", {"s": '"libraries of the city"'}, "en")
    assert sorted(r.k for r in got.collect()) == [1, 10]  # two stop words between them in both, none in 11
    assert I.find(index, "k", {"s": "the"}, "en").columns == ["search", "k"] and I.find(index, "k", {"s": "the"}, "en").count() == 0
    assert I.find(index.limit(0), "k", {"s": "city"}, "en").count() == 0
    with pytest.raises(ValueError):
        I.find(index, "k", {"s": "-city"}, "en")


def test_scan_is_filtered(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "k long, t string")
    index = I.stored(I.build(docs, "k", F.col("t"), "simple"), "k", ranges=True)
    found = I.find(index, "k", {"s": "city library", "t": "lib"}, "simple")
    plan = found._jdf.queryExecution().simpleString()
    assert {tuple(r) for r in found.collect()} == {("t", k) for k in by_loop(TEXTS, "lib", "simple")} | {("s", k) for k in by_loop(TEXTS, "city library", "simple")}
    assert re.search(r"PushedFilters: \[[^\]]*(In|StringStartsWith)\(lexeme", plan)


def test_stemmed_search(spark, sf):
    texts = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    got = {tuple(r) for r in searching.stemmed_search(spark, sf).collect()}
    want = {(language, name, k) for language, each in searching.STEMMED.items() for name, wanted in each.items() for k in by_loop(texts, wanted, language)}
    assert got == want and len({(a, b) for a, b, _ in got}) >= 4


@pytest.mark.parametrize("language", ["en", "fr"])
def test_find_by_a_lexicon(spark, language):
    """Stems over an index of words as they stand: words of one lexeme in one text, stop words' distances, exclusions."""
    docs = spark.createDataFrame([*TEXTS.items(), (13, "library libraries"), (14, "librarie of public libraries public library"), (None, "public library")], "k long, t string")
    texts = {k: t for k, t in docs.collect() if k is not None}
    index = I.stored(I.build(docs, "k", F.col("t"), "simple"), "k")
    words = I.lexicon(index, ["en", "fr", "en"])
    assert words.columns == ["word", "en", "fr"] and words.where("word = 'the'").collect() == [("the", None, stem("the", "fr"))]
    assert words.count() == index.select("lexeme").distinct().count()
    named = {str(i): s for i, s in enumerate([*SEARCHES, '"library library"', '"public library public"'])}
    rows = [(r.search, r.k) for r in I.find(index, "k", named, language, docs.select("k"), words).collect()]
    assert len(rows) == len(set(rows))
    for name, wanted in named.items():
        assert {k for s, k in rows if s == name} == by_loop(texts, wanted, language), wanted
    assert I.find(index.limit(0), "k", {"s": "city"}, language, None, I.lexicon(index.limit(0), [language])).count() == 0


def test_stemmed_search_indexes_texts_once(spark, sf, monkeypatch):
    """However many languages there are, and each distinct word is stemmed in the lexicon only."""
    made, build = [], I.build
    monkeypatch.setattr(I, "build", lambda *a: made.append(a[-1]) or build(*a))
    searching.stemmed_search(spark, sf)
    assert made == ["simple"]


def test_rows_are_cut_by_words(spark, monkeypatch):
    """Rows of texts that a worker hands on early are those of one batch."""
    docs = spark.createDataFrame([*TEXTS.items(), (13, "the of")], "k long, t string").coalesce(1)
    whole = sorted(map(tuple, I.build(docs, "k", F.col("t"), "en").collect()))
    monkeypatch.setattr(I, "FLUSH", 3)
    assert sorted(map(tuple, I.build(docs, "k", F.col("t"), "en").collect())) == whole
    assert [r for r in whole if r[0] in (3, 8, 13)] == [(3, "free", [4]), (3, "librari", [1]), (3, "public", [2]), (8, "help", [1, 2]), (8, "self", [0, 3])]
