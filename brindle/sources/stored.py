"""A stored table by slots of its key, into which batches are put by rewriting the slots they change, and no others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.tables import exists, remove

SLOT, BATCH = "_slot", "_batch"
#: Slots of a table; choose them so that one holds about a gigabyte.
SLOTS = 64


def _slot(key: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def _write(df: DataFrame, path: str, key: str) -> None:
    """Ranges of slot and key, so that a slot may be several tasks and files, each in order of the key."""
    rows = df.repartitionByRange(SLOT, key).sortWithinPartitions(SLOT, key)
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(SLOT).parquet(path)


def create(df: DataFrame, path: str, key: str, slots: int = SLOTS) -> None:
    """Write df, whose key is unique and never null, as a stored table of batch 0."""
    _write(df.withColumn(BATCH, F.lit(0).cast("long")).withColumn(SLOT, _slot(key, slots)), path, key)


def rows(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows, without what the slots need."""
    return spark.read.parquet(path).drop(SLOT, BATCH)


def upsert(spark: SparkSession, path: str, changes: DataFrame, key: str, batch: int, slots: int = SLOTS) -> int:
    """Put a batch of rows with the table's columns in by key; gives the slots that were rewritten.

    Rows equal to the stored ones, of a null key, or of a batch that isn't later than the one
    that wrote the stored row change nothing, so a batch may come twice or late. Of several rows
    of a key the greatest counts, column by column. Only the batch's slots are read (at most
    `slots` numbers come to the driver), and only those with a real change are written. They
    are first written whole beside the table under the batch's number: if the job dies while it
    replaces slots, the same call again finishes from there. One writer at a time.
    """
    pending = f"{path}/_pending-{batch}"
    if not exists(spark, f"{pending}/_SUCCESS"):
        _prepare(spark, path, changes, key, batch, slots, pending)
    found = spark.read.parquet(pending)
    hit = [r[0] for r in found.where("_changed").select(SLOT).distinct().collect()]
    if hit:
        _write(found.where(F.col(SLOT).isin(hit)).drop("_changed"), path, key)
    remove(spark, pending)
    return len(hit)


def _prepare(spark: SparkSession, path: str, changes: DataFrame, key: str, batch: int, slots: int, pending: str) -> None:
    """Write the batch's slots as they will be, with whether each row changes."""
    table = spark.read.parquet(path)
    names = [c for c in table.columns if c not in (SLOT, BATCH)]
    values = [c for c in names if c != key]
    fresh = changes.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.max(F.struct(*values)).alias("_new"))
    touched = [r[0] for r in changes.where(F.col(key).isNotNull()).select(_slot(key, slots).alias(SLOT)).distinct().collect()]
    old = table.where(F.col(SLOT).isin(touched)).select(key, F.struct(*values).alias("_old"), F.col(BATCH).alias("_was"))
    both = old.join(fresh, key, "full")
    taken = F.col("_was").isNull() | (F.col("_new").isNotNull() & (F.col("_was") < batch) & ~F.col("_new").eqNullSafe(F.col("_old")))
    both = both.withColumn("_changed", taken).withColumn("_value", F.when(F.col("_changed"), F.col("_new")).otherwise(F.col("_old")))
    both = both.select(key, "_value.*", "_changed", F.when(F.col("_changed"), F.lit(batch)).otherwise(F.col("_was")).cast("long").alias(BATCH), _slot(key, slots).alias(SLOT))
    both.select(*names, BATCH, SLOT, "_changed").write.mode("overwrite").parquet(pending)
