"""Rows let in or turned away by named rules, in one pass, with counts; nothing stops at a bad row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from brindle.operators.loading import checked
from brindle.sources.tables import exists, materialize

#: What texts that couldn't be read are kept in.
RAW = "_raw"
# Units of pay, and kinds of work that may be unpaid.
UNITS = ("HOUR", "DAY", "WEEK", "MONTH", "YEAR")
UNPAID = ("VOLUNTEER", "INTERN", "STAGE")


class Split(NamedTuple):
    """good rows; rejected ones with broken, the names of their rules; counts by rule, and of all rows."""

    good: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def pay_checks() -> dict[str, Column]:
    """The rules of pay by name: null, as in SQL, breaks none but where a null is named."""
    unit, low, high, hours = (F.col(c) for c in ("unit_text", "min_value", "max_value", "hours_per_week"))
    return {
        "unit": unit.isin(*UNITS),
        "pair": (unit.isNull() & low.isNull()) | (unit.isNotNull() & low.isNotNull() & (low >= 0)),
        "range": high >= low,
        "zero": low.isNull() | (low > 0) | ((low == 0) & F.coalesce(F.col("employment_type").isin(*UNPAID), F.lit(False))),
        "hours": hours.between(1, 80),
    }


def parsed(df: DataFrame, text: str, schema: str) -> DataFrame:
    """df with the fields of its JSON texts; where a text is malformed, of other types, empty or null, RAW holds it (or "")."""
    kept = [c for c in df.columns if c != text]
    read = F.from_json(F.col(text), f"{schema}, {RAW} string", {"columnNameOfCorruptRecord": RAW})
    rows = df.select(*kept, text, read.alias("_r"))
    return rows.select(*kept, "_r.*", F.col(text).alias("_text")).withColumn(RAW, F.when(F.trim(F.coalesce("_text", F.lit(""))) == "", F.coalesce("_text", F.lit(""))).otherwise(F.col(RAW))).drop("_text")


def split(df: DataFrame, checks: Mapping[str, Column], unique: Sequence[str] = (), order: str | None = None) -> Split:
    """df's rows by whether they keep all checks and come first, by order, of the good rows with their unique columns.

    Later rows of the same unique columns break "conflict"; null ones never conflict, and ties
    go by the order in which rows are read. Where df has RAW, its rows that fill it break
    "malformed" and no other rule. The rows are judged and counted in the pass that writes
    them; the first of each key is found by a maximum that is taken before the shuffle.
    """
    if RAW in df.columns:
        checks = {"malformed": F.col(RAW).isNull()} | {n: F.col(RAW).isNotNull() | c for n, c in checks.items()}
    told = checked(df, checks)
    spent: list[DataFrame] = []
    if unique:
        told = materialize(told.withColumn("_row", F.monotonically_increasing_id()), "told")
        spent = [told]
        known = F.size("broken") == 0
        for c in unique:
            known = known & F.col(c).isNotNull()
        place = F.struct(*([order] if order else []), "_row")
        first = told.where(known).groupBy(*[F.col(c).alias(f"_u{i}") for i, c in enumerate(unique)]).agg(F.min(place)["_row"].alias("_first"))
        on = known
        for i, c in enumerate(unique):
            on = on & (F.col(c) == F.col(f"_u{i}"))
        late = F.coalesce(F.col("_first") != F.col("_row"), F.lit(False))
        told = told.join(first, on, "left").withColumn("broken", F.when(late, F.array(F.lit("conflict"))).otherwise(F.col("broken"))).select(*df.columns, "broken")
    seen = Observation()
    names = [*checks, *(["conflict"] if unique else [])]
    told = told.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.array_contains("broken", n)).alias(n) for n in names])
    judged = materialize(told, "judged", spent)
    kept = F.size("broken") == 0
    return Split(judged.where(kept).drop("broken", RAW), judged.where(~kept), seen.get)


def statuses(parts: Split, key: str) -> DataFrame:
    """(key, status, reason): added, or error with the names of the broken rules."""
    good = parts.good.select(key, F.lit("added").alias("status"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(parts.rejected.select(key, F.lit("error").alias("status"), F.array_join("broken", ",").alias("reason")))


def restore_rows(
    spark: SparkSession, folder: str, schemas: Mapping[str, str], checks: Mapping[str, Mapping[str, Column]], unique: Mapping[str, Sequence[str]], generated: Sequence[str] = ()
) -> dict[str, Split]:
    """The tables of a backup of JSON lines in the order of schemas, each split by its checks and unique columns; tables that aren't there are left out."""
    out = {}
    for name, schema in schemas.items():
        if exists(spark, f"{folder}/{name}"):
            rows = spark.read.schema(f"{schema}, {RAW} string").option("columnNameOfCorruptRecord", RAW).json(f"{folder}/{name}").drop(*generated)
            out[name] = split(rows, checks.get(name, {}), unique.get(name, ()))
    return out
