"""Duplicates, entity resolution and accent variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import fold, tokens
from brindle.operators.components import connected_components


def accent_canonical(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, folded, preferred, variants): of labels that fold alike the one with the fewest marked letters, shortest, first."""
    x = F.col(label)
    marked = F.length(x) - F.length(F.regexp_replace(x, "[^\\x00-\\x7F]", ""))
    return (
        df.where(x.isNotNull())
        .groupBy(group, fold(x).alias("folded"))
        .agg(F.min_by(x, F.struct(marked, F.length(x), x)).alias("preferred"), F.count_distinct(x).alias("variants"))
    )


def title_classes(df: DataFrame, block: str, title: str) -> DataFrame:
    """(block, t, title): each distinct title of a block, and the first by name of those that have the same words, whatever their order and number."""
    titles = df.select(block, F.col(title).alias("t")).where("t is not null").distinct()
    titles = titles.withColumn("_set", F.array_sort(F.array_distinct(tokens(F.col("t"))))).where(F.size("_set") > 0)
    return titles.join(titles.groupBy(block, "_set").agg(F.min("t").alias("title")), [block, "_set"]).select(block, "t", "title")


def similar_titles(df: DataFrame, block: str, title: str, threshold: float = 0.7) -> DataFrame:
    """(block, a, b, similarity): titles of a block whose words are that alike; each stands for all titles of the same words (see title_classes).

    Titles meet over their rarest words: with w words and similarity t at least, one of the
    first w - ceil(t * w) + 1 words in order of rarity is shared, so that very common words
    don't bring all pairs of a block together. Rows with equal titles stand for each other.
    """
    titles = title_classes(df, block, title).where("t = title")
    titles = titles.select(block, "t", F.array_distinct(tokens(F.col("t"))).alias("words"))
    each = titles.select(block, "t", F.explode("words").alias("w"))
    counts = each.groupBy(block, "w").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.join(counts, [block, "w"]).groupBy(block, "t").agg(F.sort_array(F.collect_list(F.struct("n", "w"))).alias("o"))
    keep = F.size("o") - F.ceil(F.size("o") * F.lit(threshold)).cast("int") + 1
    keys = ordered.select(block, "t", F.explode(F.slice(F.transform("o", lambda x: x["w"]), F.lit(1), keep)).alias("key"), F.transform("o", lambda x: x["w"]).alias("words"))
    a = keys.select(block, "key", F.col("t").alias("a"), F.col("words").alias("wa"))
    b = keys.select(block, "key", F.col("t").alias("b"), F.col("words").alias("wb"))
    alike = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))
    pairs = a.join(b, [block, "key"]).where("a < b").select(block, "a", "b", alike.alias("similarity"))
    return pairs.where(F.col("similarity") >= threshold).distinct()


def survivors(entities: DataFrame, edges: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """(key, survivor): every entity and the one of its cluster that stays, the first by order and then by key."""
    parts = connected_components(edges)
    grouped = entities.join(parts, F.col(key) == F.col("node"), "left").withColumn("_c", F.coalesce("component", key))
    best = grouped.groupBy("_c").agg(F.min_by(key, F.struct(*order, F.col(key))).alias("survivor"))
    return grouped.select(key, "_c").join(best, "_c").select(key, "survivor")


def absorb(rows: DataFrame, merged: DataFrame, reference: str, key: str) -> DataFrame:
    """rows with references to absorbed entities moved to their survivors."""
    moves = merged.select(F.col(key).alias("_from"), "survivor")
    return rows.join(moves, F.col(reference) == F.col("_from"), "left").withColumn(reference, F.coalesce("survivor", reference)).drop("_from", "survivor")


def merged(entities: DataFrame, merges: DataFrame, key: str, name: str, aliases: str) -> DataFrame:
    """entities without those that merges (key, survivor) absorbs; survivors have their names and aliases too, each once, but not their own name."""
    moves = merges.where(F.col(key) != F.col("survivor")).select(F.col(key).alias("_from"), F.col("survivor").alias("_to"))
    gone = entities.join(moves, F.col(key) == F.col("_from")).groupBy("_to").agg(F.array_sort(F.collect_set(F.struct(F.col(key), F.col(name).alias("n"), F.col(aliases).alias("a")))).alias("_gone"))
    kept = entities.join(moves, F.col(key) == F.col("_from"), "left_anti").join(gone, F.col(key) == F.col("_to"), "left")
    empty = F.array().cast("array<string>")
    more = F.flatten(F.transform("_gone", lambda g: F.concat(F.array(g["n"]), F.coalesce(g["a"], empty))))
    every = F.array_distinct(F.concat(F.coalesce(aliases, empty), F.coalesce(more, empty)))
    united = F.filter(every, lambda a: a.isNotNull() & (a != F.col(name)))
    return kept.select(*[united.alias(c) if c == aliases else F.col(c) for c in entities.columns])


def crosswalk(rows: DataFrame, terms: DataFrame, text: str, term: str, code: str) -> DataFrame:
    """rows with code and how: exact for a term of one code, ambiguous (and no code) for several, else none."""
    known = terms.groupBy(fold(F.col(term)).alias("_term")).agg(F.count_distinct(code).alias("_n"), F.min(code).alias("_code"))
    joined = rows.join(known, fold(F.col(text)) == F.col("_term"), "left")
    how = F.when(F.col("_n") == 1, "exact").when(F.col("_n") > 1, "ambiguous").otherwise("none")
    return joined.select(*rows.columns, F.when(F.col("_n") == 1, F.col("_code")).alias(code), how.alias("how"))
