"""Business rules of three states: null says that it isn't known yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eligible(proposed: Column, parent: Column) -> Column:
    """What is proposed, where the parent is eligible; false where it isn't, null while it isn't known."""
    return F.when(parent.isNull(), F.lit(None).cast("boolean")).when(parent, proposed).otherwise(F.lit(False))


def category_of(subtype: Column) -> Column:
    """The category that a subtype's second part names; EXCLUDED stays."""
    return F.when(F.upper(subtype) == "EXCLUDED", "EXCLUDED").otherwise(F.concat(F.lit("GOV_"), F.nullif(F.split_part(subtype, F.lit("_"), F.lit(2)), F.lit(""))))


def skip_reason(wanted: Column, filled: Column) -> Column:
    """Why a row needn't be tried again: null if all wanted fields were filled, else whether some were."""
    return F.when(filled >= wanted, F.lit(None).cast("string")).when(filled > 0, "partial_fill").otherwise("no_new_fields")


def demoted(items: DataFrame, owners: DataFrame, owner: str, key: str, flag: str) -> DataFrame:
    """items whose flag is false where it was true and the owner (key of owners) isn't eligible, isn't known to be, or isn't there.

    Both tables have the flag; repeated owners are eligible if all their rows are.
    """
    fine = owners.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(F.coalesce(F.col(flag), F.lit(False))).alias("_fine"))
    kept = items.join(fine, F.col(owner) == F.col("_key"), "left")
    return kept.withColumn(flag, F.when(F.col(flag) & ~F.coalesce("_fine", F.lit(False)), F.lit(False)).otherwise(F.col(flag))).drop("_key", "_fine")


def flag_requests(requests: DataFrame, items: DataFrame, owners: DataFrame, item: str, owner: str, key: str, flag: str) -> DataFrame:
    """requests (item, wanted) with status: missing, refused (wanted, but the owner isn't eligible), same, or set."""
    told = requests.join(items.select(F.col(item), F.col(owner).alias("_owner"), F.col(flag).alias("_now"), F.lit(True).alias("_there")), item, "left")
    told = told.join(owners.select(F.col(key).alias("_key"), F.col(flag).alias("_fine")), F.col("_owner") == F.col("_key"), "left")
    refused = F.col("wanted") & ~F.coalesce("_fine", F.lit(False))
    status = F.when(F.col("_there").isNull(), "missing").when(refused, "refused").when(F.col("_now").eqNullSafe(F.col("wanted")), "same").otherwise("set")
    return told.select(item, "wanted", status.alias("status"))
