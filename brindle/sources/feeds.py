"""Feeds, JSON records, bilingual indexes and the registry of sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import first_filled, fold

_RSS = "title string, link string, description string, pubDate string, guid string"
_ATOM = "title string, link struct<_href:string>, summary string, content string, published string, updated string, id string"


def feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """(title, url, published, body, uid) of all RSS items and Atom entries below path; blank values are null."""
    xml = spark.read.format("xml")
    rss = xml.option("rowTag", "item").schema(_RSS).load(path).select(
        first_filled(F.col("title")).alias("title"), first_filled(F.col("link")).alias("url"), first_filled(F.col("pubDate")).alias("published"),
        first_filled(F.col("description")).alias("body"), first_filled(F.col("guid"), F.col("link")).alias("uid"),
    )
    atom = spark.read.format("xml").option("rowTag", "entry").schema(_ATOM).load(path).select(
        first_filled(F.col("title")).alias("title"), first_filled(F.col("link._href")).alias("url"), first_filled(F.col("published"), F.col("updated")).alias("published"),
        first_filled(F.col("content"), F.col("summary")).alias("body"), first_filled(F.col("id"), F.col("link._href")).alias("uid"),
    )
    return rss.unionByName(atom)


def json_records(spark: SparkSession, path: str, record: str, lists: Sequence[str] = ("jobs", "results", "items", "data")) -> DataFrame:
    """Records of JSON files, each a list of them or an object that holds one under the first key of lists that it has."""
    text = spark.read.text(path, wholetext=True)
    inside = [F.get_json_object("value", f"$.{name}") for name in lists]
    found = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.coalesce(*inside))
    return text.select(F.explode(F.from_json(found, f"array<struct<{record}>>")).alias("r")).select("r.*")


def run_chain(df: DataFrame, filters: Mapping[str, Column]) -> DataFrame:
    """df with dropped_by: the first filter that a row fails (null counts as failed); null for rows that pass all."""
    return df.withColumn("dropped_by", F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in filters.items()]))


def bilingual_index(en: DataFrame, fr: DataFrame, key: str, label: str, aliases: str) -> DataFrame:
    """(key, label_en, label_fr, term, aliases_en, aliases_fr): all keys of both; a missing label falls back on the other.

    Several rows of a key in one language count as one: the first label by order, all aliases.
    Aliases that only repeat the label, whatever their case and marks, are left out.
    """

    def side(df: DataFrame, lang: str) -> DataFrame:
        own = F.min(F.nullif(F.trim(label), F.lit("")))
        every = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(aliases, F.array().cast("array<string>"))))))
        return df.where(F.col(key).isNotNull()).groupBy(key).agg(own.alias(f"label_{lang}"), every.alias(f"aliases_{lang}"))

    both = side(en, "en").join(side(fr, "fr"), key, "full")
    kept = lambda lang: F.filter(
        F.coalesce(f"aliases_{lang}", F.array().cast("array<string>")), lambda a: a.isNotNull() & (F.trim(a) != "") & ~F.coalesce(fold(a) == fold(F.col(f"label_{lang}")), F.lit(False))
    )
    return both.select(key, "label_en", "label_fr", F.coalesce("label_en", "label_fr").alias("term"), kept("en").alias("aliases_en"), kept("fr").alias("aliases_fr"))


def resolve_sources(rows: DataFrame, registry: DataFrame, wanted: str) -> DataFrame:
    """rows with source_id: that of the source whose slug, else id, else name (folded), is wanted.

    registry has id, slug and name; of several with one key the smallest id counts.
    """
    keys = F.explode(F.array(F.struct(F.lit(1).alias("p"), F.lower("slug").alias("k")), F.struct(F.lit(2).alias("p"), F.lower(F.col("id").cast("string")).alias("k")), F.struct(F.lit(3).alias("p"), fold(F.col("name")).alias("k"))))
    known = registry.select("id", keys.alias("x")).where("x.k <> ''").groupBy(F.col("x.k").alias("_k")).agg(F.min_by("id", F.struct("x.p", "id")).alias("source_id"))
    return rows.join(known, fold(F.col(wanted)) == F.col("_k"), "left").drop("_k")
