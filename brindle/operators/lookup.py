"""Labels and aliases for many searches at once, by an index of trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import fold, jaccard, trigrams
from brindle.operators.search import LIKE
from brindle.sources.tables import materialize

#: Searches of fewer letters also find what begins with them, at this score.
SHORT, BEGINS = 3, 0.1


def terms(labels: DataFrame, key: str, label: Column, aliases: Column, fallback: Column | None = None) -> DataFrame:
    """(key, term, alias): each label, or what stands in for a null one, with a null alias, and each of its aliases; labels without any aliases keep their row."""
    own = F.coalesce(label, F.lit("") if fallback is None else fallback, F.lit(""))
    others = F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: a.isNotNull())
    each = F.concat(F.array(F.struct(own.alias("term"), F.lit(None).cast("string").alias("alias"))), F.transform(others, lambda a: F.struct(a.alias("term"), a.alias("alias"))))
    return labels.select(key, F.explode(each).alias("t")).select(key, "t.term", "t.alias").distinct()


def resembling(searches: DataFrame, texts: DataFrame, least: float = LIKE) -> DataFrame:
    """(q, t, score): the folded searches (q) and texts (t), both distinct, whose trigrams have a Jaccard similarity of `least` or more.

    Trigrams are put in order, the rarest of both sides first; a pair that is similar enough shares one of
    the first few of each, so only these enter the index, and only where the sizes and what
    follows allow the similarity is a pair compared.
    """
    grams = searches.select(F.lit(True).alias("s"), F.col("q").alias("x")).unionByName(texts.select(F.lit(False).alias("s"), F.col("t").alias("x"))).withColumn("g", trigrams(F.col("x")))
    rows = materialize(grams.where(F.size("g") > 0), "terms")
    each = rows.select("s", "x", F.size("g").alias("n"), F.explode("g").alias("w"))
    often = each.groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    placed = each.join(often, "w").withColumn("p", F.row_number().over(Window.partitionBy("s", "x").orderBy("f", "w")))
    index = placed.where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    a = index.where("s").select("w", *[F.col(c).alias(c + "a") for c in ("x", "n", "p")])
    b = index.where("not s").select("w", *[F.col(c).alias(c + "b") for c in ("x", "n", "p")])
    shared = F.ceil((F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-9)
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1
    met = a.join(b, "w").where(left >= shared).select(F.col("xa").alias("q"), F.col("xb").alias("t")).distinct()
    q, t = rows.where("s").select(F.col("x").alias("q"), F.col("g").alias("qg")), rows.where("not s").select(F.col("x").alias("t"), F.col("g").alias("tg"))
    return met.join(q, "q").join(t, "t").select("q", "t", jaccard(F.col("qg"), F.col("tg")).alias("score")).where(F.col("score") >= least)


def search_labels(
    labels: DataFrame, key: str, label: Column, aliases: Column, searches: DataFrame, search: str, limit: int | None = None, fallback: Column | None = None
) -> DataFrame:
    """(search, key, matched_alias, score, place): for each distinct search the labels that resemble it by themselves or an alias, best first, ties to the smaller key.

    The same as search.label_search for each, but all searches meet the terms by one index:
    equal terms of many labels are compared once, and searches of one or two letters find
    what begins with them by an equi-join on beginnings. The alias is null where the label alone
    scores as much; of aliases of one score the smallest is named. Null searches and those
    without letters find nothing. With `limit`, that many of each search.
    """
    asked = searches.select(F.col(search).alias("_s")).where("_s is not null").distinct().withColumn("q", fold(F.col("_s")))
    owned = materialize(terms(labels, key, label, aliases, fallback).withColumn("t", fold(F.col("term"))), "owned")
    texts = materialize(owned.select("t").where("t <> ''").distinct(), "texts")
    queries = asked.select("q").where("q <> ''").distinct()
    starts = texts.select("t", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(SHORT - 1)), lambda n: F.substring(F.col("t"), F.lit(1), n)))).alias("q"))
    begun = starts.join(queries.where(F.length("q") < SHORT), "q").select("q", "t", F.lit(BEGINS).alias("score"))
    pairs = resembling(queries, texts).unionByName(begun).groupBy("q", "t").agg(F.max("score").alias("score"))
    hits = pairs.join(owned, "t").join(asked, "q")
    # the best term of a label: the highest score, its own name before aliases, the smallest alias
    best = F.min_by(F.struct("alias", "score"), F.struct(-F.col("score"), F.col("alias").isNotNull(), F.coalesce("alias", F.lit(""))))
    told = hits.groupBy("_s", key).agg(best.alias("b")).select("_s", key, F.when(F.col("b.score") >= LIKE, F.col("b.alias")).alias("matched_alias"), F.col("b.score").alias("score"))
    place = F.row_number().over(Window.partitionBy("_s").orderBy(F.col("score").desc(), key))
    told = told.withColumn("place", place)
    told = told if limit is None else told.where(F.col("place") <= limit)
    return told.select(F.col("_s").alias(search), key, "matched_alias", "score", "place")
