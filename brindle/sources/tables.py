"""Reading the tables, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; pruning and pushdown are left to Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its scan has fewer splits than there are cores; larger inputs are left as they are.

    A small file of one row group is read by one task, which then does all the work on its texts.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """df dealt over all cores, or as many partitions as it has if these are more; what is worked out for it and what comes after are two stages."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own if that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="brindle-shared-")
    return _OWN[app]


def materialize(df: DataFrame, label: str, spent: Iterable[DataFrame] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor costs no recomputation.

    Unlike a checkpoint of serialised rows, the Parquet copy is compressed and columnar,
    and gives the optimiser its true size. Copies in spent, which nothing but df needed, are
    deleted once df is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in spent:
        discard(old)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out, lambda _, key=id(out): _PATHS.pop(key, None)), path)
    return out


def discard(df: DataFrame) -> None:
    """Delete the copy that materialize() wrote for this very frame; other frames are left alone."""
    ref, path = _PATHS.pop(id(df), (None, None))
    if ref is not None and ref() is df:
        remove(df.sparkSession, path)


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder in any of the cluster's file systems."""
    files, at = _place(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    files, at = _place(spark, path)
    files.delete(at, True)
