"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source with weight w of the mixture should give w * total rows; with n rows of its own, each
is repeated w * total / n times on average. Every row gets its own number of copies by
inverting the Poisson distribution of that mean at a uniform number hashed from seed and row,
so that a row's copies don't depend on what other rows there are, or on partitions. Copies
are then dealt out over all partitions and ordered within them by a hash of seed, row and copy.
A row's hash is over all of its columns, so that rows of one id (or of none) draw by themselves
and aren't dealt to one partition.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Means over this are met by the sum of that many more draws, each of an equal part.
MEAN = 32.0
#: Counts in the table of a draw; beyond it a mean of MEAN has less than 2 ** -53 left.
COUNTS = 120


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) with 52 hashed bits from the parts' MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def poisson_table(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, ..., COUNTS."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))

    def more(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(COUNTS)), start, more, lambda s: s["sums"])


def rates(docs: DataFrame, weights: Mapping[str, float], other_weight: float, source_col: str, total: float | None) -> DataFrame:
    """(bucket, mean, draws, sums): one row per listed source and one for all others (null), where they have rows.

    As many rows as the caller has listed sources, at most, and one: this is what may be broadcast.
    """
    listed = F.when(F.col(source_col).cast("string").isin(list(weights)), F.col(source_col).cast("string")) if weights else F.lit(None).cast("string")
    sizes = docs.groupBy(listed.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(float(other_weight))
    for name, w in weights.items():
        weight = F.when(F.col("bucket") == name, F.lit(float(w))).otherwise(weight)
    one = sizes.select("bucket", "n", weight.alias("weight"))
    sums = one.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    mean = F.col("weight") / F.col("all_weight") * (F.lit(float(total)) if total else F.col("all_n").cast("double")) / F.col("n")
    one = one.join(F.broadcast(sums)).where("all_weight > 0").select("bucket", "n", mean.alias("mean"))
    draws = F.greatest(F.lit(1), F.ceil(F.col("mean") / F.lit(MEAN)).cast("int"))
    one = one.select("bucket", "n", "mean", draws.alias("draws"))
    return one.withColumn("sums", poisson_table(F.col("mean") / F.col("draws")))


def mix(
    docs: DataFrame,
    weights: Mapping[str, float],
    other_weight: float = 0.0,
    total: float | None = None,
    seed: int = 17,
    source_col: str = "source",
    extras: bool = True,
) -> DataFrame:
    """docs with each row as often as its draw says, and (if extras) copy (from 0), copies, mean and shuffle_key.

    weights are relative; sources that aren't listed, and null ones, share other_weight.
    Weights of sources without rows are shared out among the rest. total is the number of rows
    aimed at, by default as many as docs has. Rows of weight zero, or whose draw is zero, have
    no copies: that is the operation. Rows that are equal in all columns draw alike, and their
    copies stand together; other rows, of one id or without one, draw by themselves.
    Columns that clash with the extras are replaced by them. An empty table gives none.
    """
    if any(w < 0 for w in (*weights.values(), other_weight)):
        raise ValueError("weights can't be negative")
    taken = {c.lower() for c in docs.columns}
    tag = next(t for t in (f"_m{i}_" for i in range(len(taken) + 1)) if not any(c.startswith(t) for c in taken))
    table = rates(docs, weights, other_weight, source_col, total)
    table = table.select(*[F.col(c).alias(tag + c) for c in ("bucket", "mean", "draws", "sums")])
    source = F.col(source_col).cast("string")
    listed = F.when(source.isin(list(weights)), source) if weights else F.lit(None).cast("string")
    rows = docs.join(F.broadcast(table), listed.eqNullSafe(F.col(tag + "bucket")))
    key, n = F.col(tag + "key"), F.col(tag + "n")
    rows = rows.withColumn(tag + "key", F.md5(F.concat_ws(":", *[F.col(f"`{c}`").cast("string") for c in docs.columns])))
    numbers = F.transform(F.sequence(F.lit(1), F.col(tag + "draws")), lambda j: uniform(F.lit(str(seed)), key, j.cast("string")))
    drawn = F.aggregate(numbers, F.lit(0), lambda acc, u: acc + F.size(F.filter(tag + "sums", lambda c: c < u)))
    rows = rows.withColumn(tag + "n", drawn)
    # outer, and filtered later: a filter on n would be pushed down, and every draw made twice
    copies = rows.withColumn(tag + "copy", F.explode_outer(F.when(n > 0, F.sequence(F.lit(0), n - 1)))).where(F.col(tag + "copy").isNotNull())
    copies = copies.withColumn(tag + "order", F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), key, F.col(tag + "copy").cast("string"))))
    copies = copies.repartition(F.col(tag + "order")).sortWithinPartitions(tag + "order")
    if not extras:
        return copies.select(*docs.columns)
    own = {"copy": "copy", "copies": "n", "mean": "mean", "shuffle_key": "order"}
    kept = [c for c in docs.columns if c.lower() not in own]
    return copies.select(*kept, *[F.col(tag + c).alias(name) for name, c in own.items()])


#: The production mixture: the named sources weigh alike, and all others weigh as one of them.
WEIGHTS = {f"src{k}": 1.0 for k in range(20)}
OTHER = 1.0

#: DuckDB SQL for the rows of mix() with the production weights.
MIX_SQL = f"""
with recursive weights as (
  select 'src' || k as bucket, 1.0::double as weight from range(20) t(k) union all select null, {OTHER}::double
), docs as (
  select *, row_number() over () as row, case when source in (select bucket from weights where bucket is not null) then source end as bucket from {{docs}}
), sizes as (
  select d.bucket, count(*)::double as n, any_value(w.weight) as weight
  from docs d join weights w on d.bucket is not distinct from w.bucket group by d.bucket
), means as (
  select bucket, weight / (select sum(weight) from sizes) * (select sum(n) from sizes) / n as mean from sizes
), parts as (
  select bucket, mean, greatest(1, ceil(mean / {MEAN}))::int as draws, mean / greatest(1, ceil(mean / {MEAN})) as part from means
), steps as (
  select bucket, part, 0 as k, exp(-part) as p, exp(-part) as below from parts
  union all
  select bucket, part, k + 1, p * part / (k + 1), below + p * part / (k + 1) from steps where k < {COUNTS}
), tables as (
  select bucket, list(below order by k) as sums from steps group by bucket
), draws as (
  select t.sums,
    (('0x' || substr(md5('17:' || md5(concat_ws(':', d.doc_id::varchar, d.text, d.lang, d.source, d.n_chars::varchar)) || ':' || j), 1, 13))::bigint::double + 0.5) / {float(1 << 52)} as u,
    d.row
  from docs d join parts p on d.bucket is not distinct from p.bucket
  join tables t on t.bucket is not distinct from d.bucket, unnest(range(1, p.draws + 1)) as r(j)
), counts as (
  select row, sum(len(list_filter(sums, lambda c: c < u)))::int as copies from draws group by row
)
select d.doc_id, d.text, d.lang, d.source, d.n_chars, copy::int as copy, copies from counts join docs d using (row), unnest(range(copies)) as r(copy)
"""
