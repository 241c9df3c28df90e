"""Directory, facets, paging and best-of operators: DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by an order that should end in a unique column."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def page(df: DataFrame, order: Sequence[Column], limit: int | None, offset: int = 0, default: int = 20) -> DataFrame:
    """A page of a sorted frame; 0 and None mean the default length. The order should end in a unique column."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(limit or default, 100))


def keyset_page(df: DataFrame, column: str, before, unique: str, limit: int) -> DataFrame:
    """The newest rows before a cursor."""
    return df.where(F.col(column) < before).orderBy(F.col(column).desc(), unique).limit(limit)


def optional_in(column: str, values: Sequence[str] | None) -> Column:
    """Whether the column is one of the values; without values all rows pass, and null passes only then."""
    return F.coalesce(F.col(column).isin(list(values)), F.lit(False)) if values else F.lit(True)


def directory(
    owners: DataFrame, items: DataFrame, owner_key: str, item_owner: str, posted: str, cutoff: Column, require_recent: bool = False
) -> DataFrame:
    """owners with n_recent (items since cutoff), latest (their last date) and total (owners listed, before any page).

    Items are counted before the join, so an owner of a third of all items is one row in it.
    require_recent leaves out owners without recent items.
    """
    counted = items.where(F.col(posted) >= cutoff).groupBy(F.col(item_owner).alias("_owner")).agg(
        F.count(F.lit(1)).alias("n_recent"), F.max(posted).alias("latest")
    )
    how = "inner" if require_recent else "left"
    joined = owners.join(counted, F.col(owner_key) == F.col("_owner"), how).drop("_owner")
    joined = joined.withColumn("n_recent", F.coalesce("n_recent", F.lit(0)))
    total = joined.agg(F.count(F.lit(1)).alias("total"))  # one row
    return joined.crossJoin(F.broadcast(total))


def facet_options(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value, n): the distinct values of each column and their rows, in one pass; nulls aren't options."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).where("p.value is not null").groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))


def cards(df: DataFrame, group: str, name: str, category: str, samples: int = 3) -> DataFrame:
    """For each group its rows, its first names, and its categories by falling count.

    Names are reduced to the first few in each task before they meet.
    """
    place = F.row_number().over(Window.partitionBy(group).orderBy(name))
    names = df.select(group, name).distinct().withColumn("place", place).where(F.col("place") <= samples)
    names = names.groupBy(group).agg(F.sort_array(F.collect_list(name)).alias("names"))
    counts = df.groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), F.col(category).alias("category"))))
    told = counts.groupBy(group).agg(
        F.sum("n").alias("n"), F.transform(ranked, lambda x: F.concat_ws(":", x["category"], (-x["minus"]).cast("string"))).alias("categories")
    )
    return told.join(names, group)


def star(facts: DataFrame, dimensions: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """facts with each (dimension, own key, its key) joined on the left; Spark broadcasts those that are small enough."""
    for dimension, own, key in dimensions:
        facts = facts.join(dimension, F.col(own) == F.col(key), "left").drop(key)
    return facts


def upsert_diff(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, change, changed): I for new keys, U for changed rows and N for equal ones, with the columns that differ.

    Nulls equal nulls; keys that only old has are left as they are and not listed.
    """
    a = old.select(key, F.lit(True).alias("_known"), *[F.col(c).alias(f"_old_{c}") for c in columns])
    both = new.select(key, *columns).join(a, key, "left")
    differ = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_old_{c}")), F.lit(c)) for c in columns]))
    change = F.when(F.col("_known").isNull(), "I").when(F.size("_changed") > 0, "U").otherwise("N")
    return both.withColumn("_changed", differ).select(key, change.alias("change"), F.when(F.col("_known"), F.col("_changed")).otherwise(F.array().cast("array<string>")).alias("changed"))


def replace_owned(rows: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """new, and the rows of owners that new doesn't mention."""
    return rows.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)


def guarded_rename(df: DataFrame, key: str, name: str, target: str) -> DataFrame:
    """df with name set to target where no other row has or would get that name; renamed says whether."""
    after = F.coalesce(F.nullif(F.trim(target), F.lit("")), F.col(name))
    claims = df.select(F.col(name).alias("_name"), key).unionByName(df.select(after.alias("_name"), key))
    contested = claims.groupBy("_name").agg(F.count_distinct(key).alias("_n")).where("_n > 1").select("_name")
    marked = df.withColumn("_after", after).join(contested.withColumn("_taken", F.lit(True)), F.col("_after") == F.col("_name"), "left").drop("_name")
    moves = F.col("_taken").isNull() & (F.col("_after") != F.col(name))
    return marked.select(*[F.when(moves, F.col("_after")).otherwise(F.col(c)).alias(c) if c == name else F.col(c) for c in df.columns], F.coalesce(moves, F.lit(False)).alias("renamed"))


def field_update(old: Mapping[str, str], process: Column, reprocess: Column) -> dict[str, Column]:
    """For {column: proposed column}: the proposed value where it's wanted and filled, else the old one."""
    out = {}
    for own, proposed in old.items():
        filled = F.nullif(F.trim(F.col(proposed).cast("string")), F.lit("")).isNotNull()
        wanted = process & filled & (reprocess | F.col(own).isNull())
        out[own] = F.when(wanted, F.col(proposed)).otherwise(F.col(own))
    return out


def needs(conditions: Mapping[str, Column]) -> Column:
    """Names of the conditions that hold, in their order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))


def equal_or_alias(left: DataFrame, right: DataFrame, left_name: str, right_name: str, aliases: str) -> DataFrame:
    """left joined with right where the names are equal, or left's is among right's aliases; each match once.

    Two equi-joins instead of one on a disjunction.
    """
    names = right.withColumn("_key", F.explode(F.array_distinct(F.concat(F.array(right_name), F.coalesce(aliases, F.array().cast("array<string>"))))))
    return left.join(names.where("_key is not null"), F.col(left_name) == F.col("_key")).drop("_key")


def word_prefix_pairs(names: DataFrame, key: str, least_words: int = 2) -> DataFrame:
    """(short, long): distinct keys of which one begins with all words of the other; prefixes are joined, not pairs compared."""
    keys = names.select(F.col(key).alias("long")).where("long is not null").distinct()
    words = F.split("long", " ")
    prefixes = keys.withColumn("n", F.size(words)).where(F.col("n") > least_words).select(
        "long", F.explode(F.transform(F.sequence(F.lit(least_words), F.col("n") - 1), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))).alias("short")
    )
    return prefixes.join(keys.select(F.col("long").alias("short")), "short").select("short", "long")


def reason_lines(df: DataFrame, reason: str) -> DataFrame:
    """(reason, n, line): each reason's rows, and both as one text; null reasons are left out."""
    counted = df.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("line", F.concat(F.col(reason), F.lit(" × "), F.col("n").cast("string")))


def name_lists(df: DataFrame, group: str, name: str) -> DataFrame:
    """(group, names): the distinct names of each group in order, as one text; groups should be small, as each becomes one value."""
    return df.select(group, name).distinct().groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(name)), ", ").alias("names"))


#: Orders of a directory by name, but for what settles ties.
DIRECTORY = ("date-desc", "value-match-desc", "match-desc", "org-desc")


def directory_order(sort: str | None, name: str, unique: str, latest: str = "latest", score: str = "value_score") -> list[Column]:
    """The order of a directory: newest item, best score or falling name first, without a value last; unknown sorts, and ties, are by name, then unique."""
    first = {"date-desc": latest, "value-match-desc": score, "match-desc": score, "org-desc": name}.get(sort or "")
    return [*([F.col(first).desc_nulls_last()] if first else []), F.col(name).asc_nulls_last(), F.col(unique)]


def available_options(owners: DataFrame, items: DataFrame, owner_key: str, item_owner: str, columns: Sequence[str], wanted: Column, excluded: Sequence[str] = ()) -> DataFrame:
    """(facet, value, n): what a facet may still choose: values of owners that have a wanted item, and those owners' number.

    Items are reduced to their owners in each task before the join, so an owner of most items is one row.
    Nulls and excluded values aren't options.
    """
    live = items.where(wanted).select(F.col(item_owner).alias("_owner")).distinct()
    found = facet_options(owners.join(live, F.col(owner_key) == F.col("_owner"), "left_semi"), columns)
    return found.where(~F.col("value").isin(list(excluded))) if excluded else found


def selected(df: DataFrame, group: str, score: str, unique: str, floor: float = 0.40, most: int = 50) -> DataFrame:
    """Each group's rows that score over the floor, the best ones, with their place; ties to the smaller unique. Null scores aren't over it."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), unique))
    return df.where(F.col(score) > floor).withColumn("place", place).where(F.col("place") <= most)
