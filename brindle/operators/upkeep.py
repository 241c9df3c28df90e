"""Reading pages of listings without going round in circles, and keeping stored rows up to date."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.relational import best_per_key


def page_guard(df: DataFrame, run: str, page: str, key: str, most_idle: int = 2) -> DataFrame:
    """Rows of a run's pages that are the first of their key, up to where most_idle pages in a row have nothing new.

    A key on several rows of its first page counts once: the row of the smallest hash. Null keys
    are left out. Pages are counted as they come, without gaps.
    """
    rows = df.where(F.col(key).isNotNull())
    first = rows.groupBy(run, key).agg(F.min(page).alias("_first"))
    fresh = first.groupBy(run, F.col("_first").alias(page)).agg(F.count(F.lit(1)).alias("_new"))
    pages = df.select(run, page).distinct().join(fresh, [run, page], "left")
    near = Window.partitionBy(run).orderBy(page).rowsBetween(1 - most_idle, 0)
    idle = (F.count(F.lit(1)).over(near) == most_idle) & (F.coalesce(F.sum("_new").over(near), F.lit(0)) == 0)
    stop = pages.withColumn("_idle", idle).where("_idle").groupBy(run).agg(F.min(page).alias("_stop"))
    kept = rows.join(first, [run, key]).where(F.col(page) == F.col("_first")).join(stop, run, "left").where(F.col("_stop").isNull() | (F.col(page) < F.col("_stop")))
    return best_per_key(kept, [run, key], [F.xxhash64(*df.columns)]).select(*df.columns)


def cursor_guard(df: DataFrame, run: str, step: str, cursor: str) -> DataFrame:
    """Steps of each run up to the first whose next cursor was given before, or is null; that step counts, later ones don't."""
    first = df.where(F.col(cursor).isNotNull()).groupBy(run, cursor).agg(F.min(step).alias("_first"))
    told = df.join(first, [run, cursor], "left")
    again = F.col(cursor).isNull() | (F.col(step) > F.col("_first"))
    stop = told.where(again).groupBy(run).agg(F.min(step).alias("_stop"))
    return told.join(stop, run, "left").where(F.col("_stop").isNull() | (F.col(step) <= F.col("_stop"))).select(*df.columns)


def probe_candidates(new: DataFrame, stored: DataFrame, owner: str, key: str, day: str, days: int, most: int) -> DataFrame:
    """(probe, key): for each new row the newest `most` stored rows of its owner whose day is near its own, or missing on either side.

    The limit is the probe's feature. Days meet by bands, so an owner's whole history isn't compared.
    """
    a = new.select(F.col(key).alias("probe"), F.col(owner).alias("_o"), F.datediff(day, F.lit("1970-01-01")).alias("_d"))
    b = stored.select(key, F.col(owner).alias("_o"), F.datediff(day, F.lit("1970-01-01")).alias("_e"))
    band = lambda c: F.floor(F.col(c) / days)
    left = a.where("_d is not null").withColumn("_b", F.explode(F.array(*[band("_d") + i for i in (-1, 0, 1)])))
    dated = left.join(b.where("_e is not null").withColumn("_b", band("_e")), ["_o", "_b"]).where(F.abs(F.col("_d") - F.col("_e")) <= days).select("probe", key)
    open_ = a.where("_d is null").join(b, "_o").select("probe", key).unionByName(a.where("_d is not null").join(b.where("_e is null"), "_o").select("probe", key))
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.col(key).desc()))
    return dated.unionByName(open_).withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def stale(df: DataFrame, derived: Mapping[str, Column]) -> DataFrame:
    """Rows of which a derived column isn't what it would be now, with the names of those columns (stale) and their new values."""
    names = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(new), F.lit(c)) for c, new in derived.items()]))
    return df.withColumn("stale", names).where(F.size("stale") > 0).withColumns(dict(derived))


def backfill(df: DataFrame, missing: Column, found: Column, columns: Sequence[str]) -> DataFrame:
    """df with columns filled from the struct found where missing holds, and filled: kept, filled or unreadable (found has none of them)."""
    some = F.lit(False)
    for c in columns:
        some = some | found[c].isNotNull()
    rows = df.withColumns({"_found": found, "_missing": F.coalesce(missing, F.lit(False))}).withColumn("filled", F.when(~F.col("_missing"), "kept").when(some, "filled").otherwise("unreadable"))
    return rows.withColumns({c: F.when(F.col("filled") == "filled", F.col("_found")[c]).otherwise(F.col(c)) for c in columns}).drop("_found", "_missing")


def facet_json(df: DataFrame, columns: Sequence[str], scope: Column | None = None) -> DataFrame:
    """(facet, all_values, scoped): each facet's distinct values as a JSON array, of all rows and of those in scope. Facets should have few values."""
    inside = F.coalesce(F.lit(True) if scope is None else scope, F.lit(False))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    values = df.select(inside.alias("_in"), pairs.alias("p")).where("p.value is not null").groupBy("p.facet", "p.value").agg(F.max("_in").alias("_in"))
    listed = lambda c: F.to_json(F.sort_array(F.collect_list(c)))
    return values.groupBy("facet").agg(listed(F.col("value")).alias("all_values"), listed(F.when(F.col("_in"), F.col("value"))).alias("scoped"))


def member_sums(df: DataFrame, group: str, value: Column, members: Column, wanted: Sequence[str]) -> DataFrame:
    """(group, one row): for each wanted member the rows that have it (n_…) and their sum of value (sum_…), in one pass."""
    has = lambda w: F.coalesce(F.array_contains(members, w), F.lit(False))
    sums = [c for w in wanted for c in (F.count_if(has(w)).alias(f"n_{w}"), F.sum(F.when(has(w), value)).alias(f"sum_{w}"))]
    return df.groupBy(group).agg(*sums)


def with_weights(rows: DataFrame, weights: DataFrame, keys: Sequence[str], weight: str, default: float = 1.0) -> DataFrame:
    """rows with the weight of their keys, or the default where there is none; of several the smallest."""
    least = weights.groupBy(*keys).agg(F.min(weight).alias(weight))
    return rows.join(least, list(keys), "left").withColumn(weight, F.coalesce(F.col(weight).cast("double"), F.lit(default)))


def run_report(results: DataFrame, found: str, best: str, failed: Column) -> DataFrame:
    """One row of a run's log: rows, values inserted, rows without any, mean of the best values, and errors; nulls are no values."""
    n = F.coalesce(F.col(found), F.lit(0))
    return results.agg(
        F.count(F.lit(1)).alias("processed"), F.coalesce(F.sum(n), F.lit(0)).alias("inserted"), F.count_if(n == 0).alias("none"), F.avg(best).alias("mean_best"),
        F.count_if(F.coalesce(failed, F.lit(False))).alias("errors"),
    )


def missing_fields(kinds: Mapping[str, str]) -> Column:
    """Names of the columns that are missing, by kind: flag and number if null, list if null or empty, text if null or blank."""
    tests = {
        "flag": lambda c: c.isNull(), "number": lambda c: c.isNull(), "list": lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0,
        "text": lambda c: F.coalesce(F.trim(c), F.lit("")) == "",
    }
    return F.array_compact(F.array(*[F.when(tests[kind](F.col(name)), F.lit(name)) for name, kind in kinds.items()]))
