"""Writing batches into stored tables: status of each row, bulk updates, audits, checks, backups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.functions.text import normal_url
from brindle.operators import postings


def save_status(new: DataFrame, stored: DataFrame, refused: Column | None = None, override: bool = False) -> DataFrame:
    """(id, status, reason) for each row of new; both have the columns of brindle.operators.postings.

    skipped: missing (title, org or url), refused, known (the URL is stored; updated with
    override), repeated (an earlier row of the batch has the URL), duplicate (surely a stored
    posting or an earlier one of the batch). All others are added.
    """
    url = normal_url(F.col("url"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rows = new.select(
        "id", url.alias("_url"), (blank("title") | blank("org") | blank("url")).alias("_missing"), F.coalesce(F.lit(False) if refused is None else refused, F.lit(False)).alias("_refused")
    )
    known = stored.select(url.alias("_url")).where("_url <> ''").distinct().withColumn("_known", F.lit(True))
    # the smallest id of each URL, aggregated before the join so that a URL of many rows is one row in it
    first = rows.where("not _missing and not _refused").groupBy("_url").agg(F.min("id").alias("_first"))
    told = rows.join(known, "_url", "left").join(first, "_url", "left")
    alike = postings.surely_there(new, stored).withColumn("_alike", F.lit(True))
    reason = (
        F.when(F.col("_missing"), "missing").when(F.col("_refused"), "refused").when(F.col("_known"), "known")
        .when(F.col("id") != F.col("_first"), "repeated").when(F.col("_alike"), "duplicate")
    )
    told = told.join(alike, "id", "left").withColumn("reason", reason)
    status = F.when(F.col("reason").isNull(), "added").when((F.col("reason") == "known") & F.lit(override), "updated").otherwise("skipped")
    return told.select("id", status.alias("status"), "reason")


def bulk_update(df: DataFrame, updates: DataFrame, payload: str, key: str, fields: str) -> DataFrame:
    """df with the values of JSON arrays of objects put in by key; fields is their schema without the key.

    Missing and null values keep the old ones; malformed arrays change nothing. Of several
    objects of a key the greatest counts, field by field.
    """
    kind = df.schema[key].dataType.simpleString()
    each = updates.select(F.explode(F.from_json(payload, f"array<struct<{key}:{kind},{fields}>>")).alias("_u")).select("_u.*")
    names = [c for c in each.columns if c != key]
    each = each.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(c).alias(f"_new_{c}") for c in names])
    joined = df.join(each, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in df.columns])


def clear_with_audit(df: DataFrame, key: str, cohort: Column, columns: Sequence[str], cause: str) -> tuple[DataFrame, DataFrame]:
    """(df with the columns of the cohort's rows set to null, the cohort's keys and old values with the cause)."""
    hit = F.coalesce(cohort, F.lit(False))
    cleared = df.select(*[F.when(~hit, F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])
    return cleared, df.where(hit).select(key, F.to_json(F.struct(*columns)).alias("old"), F.lit(cause).alias("cause"))


def checked(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """df with broken: the names of the checks that a row fails; as in SQL, a check that is null isn't failed."""
    return df.withColumn("broken", F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()])))


def run_summary(statuses: DataFrame) -> DataFrame:
    """One row of a run's log: rows, added, updated and skipped."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("added", "updated", "skipped")]
    return statuses.agg(F.count(F.lit(1)).alias("rows"), *counts)


def backup(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Each table as a folder of JSON lines; nulls are written, so that restoring gives the same rows."""
    for name, df in tables.items():
        df.write.option("ignoreNullFields", "false").json(f"{folder}/{name}")


def restore(spark: SparkSession, folder: str, schemas: Mapping[str, StructType | str], generated: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The tables of a backup in the order of schemas, without generated columns; malformed lines stop the read."""
    read = spark.read.option("mode", "FAILFAST")
    return {name: read.schema(schema).json(f"{folder}/{name}").drop(*generated) for name, schema in schemas.items()}
