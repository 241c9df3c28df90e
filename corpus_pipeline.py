"""From raw documents to training sequences in five stages, each one operator over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import mixing, packing, quality, simhash, winnow
from brindle.sources.tables import materialize, spread, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents, doesn't reject."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of passages; n_chars is that of the text that is left."""
    kept = winnow.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of links between documents whose five-word shingles are 0.8 alike or more, as compared exactly.

    Documents that the lines stage has emptied are one group too, so one row of them stays.
    """
    return simhash.keep_one(docs, wordless=False)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight in the mixture asks for, shuffled."""
    return mixing.mix(docs, mixing.WEIGHTS, mixing.OTHER, extras=False)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1,024 ids: one row for each piece of a document."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_filter),
    ("lines", line_dedup),
    ("simhash", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and reread."""
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier's fit is not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None
