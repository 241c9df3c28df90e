"""Search in labels and texts, with expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import fold, jaccard, trigram_list, trigrams
from brindle.sources.tables import materialize

# Words that full-text search leaves out.
STOPS = {
    "en": "a an and are as at be by for from has he in is it its of on or that the this to was were will with".split(),
    "fr": "au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me ne nous on ou par pas pour qu que qui sa se ses son sur un une vous".split(),
}
# Endings that full-text search takes off, first by the first pattern, then by the second.
SUFFIXES = {
    "en": (r"^(.{3,}?)(?:ings?|edly|ed|ies|es|s|ly|ers?)$", r"^(.{3,}?)[ey]$"),
    "fr": (r"^(.{3,}?)(?:ements?|ations?|euses?|eurs?|ées?|és?|er|es|s)$", r"^(.{3,}?)[ei]$"),
}
#: Likeness from which two texts of trigrams resemble each other.
LIKE = 0.3


def word_similarity(word: Column, text: Column) -> Column:
    """The best share of trigrams of word and a stretch of text's trigrams; 0 where either has none, null for null."""
    a, b = trigrams(word), trigram_list(text)
    ends = lambda i: F.transform(F.sequence(i, F.size(b)), lambda j: jaccard(a, F.slice(b, i, j - i + 1)))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size(b)), lambda i: F.array_max(ends(i))))
    return F.when(word.isNull() | text.isNull(), F.lit(None).cast("double")).when(F.size(b) > 0, best).otherwise(0.0)


def label_search(df: DataFrame, key: str, label: Column, aliases: Column, wanted: str, limit: int, fallback: Column | None = None) -> DataFrame:
    """df's rows that resemble wanted by label (or fallback, where that is null) or an alias, with matched_alias and score, best first.

    Words of one or two letters also find what begins with them, at a score of 0.1. The
    alias is null where the label alone scores as much. Row by row: nothing is exploded or joined.
    """
    q = fold(F.lit(wanted))
    term = F.coalesce(label, F.lit("") if fallback is None else fallback, F.lit(""))
    others = F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: a.isNotNull())
    # greatest score first, then the smallest alias
    scored = F.array_sort(F.transform(others, lambda a: F.struct((-jaccard(trigrams(a), trigrams(q))).alias("minus"), a.alias("alias"))))
    rows = df.withColumn("_own", jaccard(trigrams(term), trigrams(q))).withColumn("_best", F.try_element_at(scored, F.lit(1)))
    other = F.coalesce(-F.col("_best.minus"), F.lit(0.0))
    begins = F.lit(len(wanted.strip()) < 3) & (F.startswith(fold(term), q) | F.exists(others, lambda a: F.startswith(fold(a), q)))
    best = F.greatest(F.col("_own"), other)
    rows = rows.withColumn("score", F.when(best >= LIKE, best).when(begins, 0.1)).where("score is not null")
    rows = rows.withColumn("matched_alias", F.when((other > F.col("_own")) & (other >= LIKE), F.col("_best.alias"))).drop("_own", "_best")
    return rows.orderBy(F.col("score").desc(), key).limit(limit)


def label_prefixes(df: DataFrame, key: str, label: Column, aliases: Column, wanted: str, limit: int) -> DataFrame:
    """The first `limit` of df's rows by key whose label or an alias begins with wanted, folded; the prefix is chosen before the limit."""
    q = fold(F.lit(wanted))
    others = F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: a.isNotNull())
    begins = F.startswith(fold(F.coalesce(label, F.lit(""))), q) | F.exists(others, lambda a: F.startswith(fold(a), q))
    return df.where(begins).orderBy(key).limit(limit)


def similar_texts(df: DataFrame, key: str, text: str, least: float = LIKE) -> DataFrame:
    """(key, other, similarity): all pairs of rows, each both ways, whose texts' trigrams have a Jaccard similarity of `least` or more.

    An inverted index of trigrams: each text's are put in order, the rarest of the table first,
    and only as many enter the index as any similar text must share one of. Texts meet by a
    trigram if their sizes, and what can still follow in both after it, allow the similarity;
    pairs that met are compared once, by their trigrams. Frequent trigrams hardly ever enter,
    and Spark splits the join's hot ones. Texts without trigrams, and null ones, resemble none.
    """
    rows = materialize(df.select(F.col(key).alias("_k"), trigrams(F.col(text)).alias("_g")).where(F.size("_g") > 0), "grams")
    found = materialize(candidates(rows, least), "candidates")
    a, b = (rows.select(F.col("_k").alias(k), F.col("_g").alias(g)) for k, g in (("_a", "_x"), ("_b", "_y")))
    met = found.join(a, "_a").join(b, "_b").withColumn("similarity", jaccard(F.col("_x"), F.col("_y"))).where(F.col("similarity") >= least)
    pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    both = met.select(F.explode(F.array(pair("_a", "_b"), pair("_b", "_a"))).alias("p"), "similarity")
    return both.select(F.col("p.a").alias(key), F.col("p.b").alias("other"), "similarity")


def candidates(rows: DataFrame, least: float) -> DataFrame:
    """(_a, _b), _a < _b: pairs of rows (_k, _g) that meet in the index of similar_texts."""
    grams = rows.select("_k", F.size("_g").alias("_n"), F.explode("_g").alias("_w"))
    often = grams.groupBy("_w").agg(F.count(F.lit(1)).alias("_f"))
    order = Window.partitionBy("_k").orderBy("_f", "_w")
    placed = grams.join(often, "_w").withColumn("_p", F.row_number().over(order))
    # a text of n trigrams shares ceil(least * n) with a similar one, so one of its first n - that + 1
    index = placed.where(F.col("_p") <= F.col("_n") - F.ceil(F.col("_n") * least - 1e-9) + 1).select("_w", "_k", "_n", "_p")
    a = index.select("_w", *[F.col(c).alias(c + "a") for c in ("_k", "_n", "_p")])
    b = index.select("_w", *[F.col(c).alias(c + "b") for c in ("_k", "_n", "_p")])
    shared = F.ceil((F.col("_na") + F.col("_nb")) * (least / (1 + least)) - 1e-9)
    left = F.least(F.col("_na") - F.col("_pa"), F.col("_nb") - F.col("_pb")) + 1
    return a.join(b, "_w").where((F.col("_ka") < F.col("_kb")) & (left >= shared)).select(F.col("_ka").alias("_a"), F.col("_kb").alias("_b")).distinct()


def _stem(w: Column, language: str) -> Column:
    for pattern in SUFFIXES[language]:
        w = F.regexp_replace(w, pattern, "$1")
    return w


def lexemes(x: Column, language: str = "en") -> Column:
    """Words of a text in order, in lower case, without stop words and endings; null gives none.

    Endings come off by a short list and not by a full stemmer: both sides of a search lose the same.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(F.filter(words, lambda w: ~w.isin(STOPS[language])), lambda w: _stem(w, language))


def matches(words: Column, wanted: str, language: str = "en") -> Column:
    """Whether lexemes match: a single word as a prefix; else words that all must be there, "phrases", -excluded ones, and or.

    A search without any words finds nothing.
    """
    wanted = wanted.strip()
    if re.fullmatch(r"[^\W_]+", wanted):
        return F.exists(words, lambda w: F.startswith(w, _stem(F.lit(wanted.lower()), language)))
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    either = F.lit(False)
    for part in re.split(r"\s+or\s+(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", wanted, flags=re.IGNORECASE):
        every, some = F.lit(True), False
        for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', part):
            lexed = lexemes(F.lit(phrase or word), language)
            found = F.contains(line, F.concat(F.lit(" "), F.array_join(lexed, " "), F.lit(" ")))
            every = every & F.when(F.size(lexed) > 0, ~found if minus else found).otherwise(F.lit(True))
            some = some or bool(re.search(r"\w", phrase or word))
        either = either | every if some else either
    return either
