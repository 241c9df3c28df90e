"""Queries of rows on their way into stored tables: rules with rejects, batches by slots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import admission
from brindle.plans.registry import query
from brindle.sources import stored
from brindle.sources.tables import shared_folder, table

_FIELDS = "url string, unit_text string, min_value long, max_value long, hours_per_week int, employment_type string"
_RULES = """
with r as (select o_orderkey, o_custkey || '-' || (o_orderkey % 3) as url, ['HOUR', 'DECADE', 'YEAR', null, 'WEEK'][o_orderkey % 5 + 1] as unit, case o_orderkey % 7 when 0 then null when 1 then 0 else cast(floor(o_totalprice) as bigint) end as low,
  case when o_orderkey % 4 = 0 then cast(floor(o_totalprice) as bigint) + 500 - o_orderkey % 1000 end as high, o_orderkey % 90 as hours, case when o_orderkey % 2 = 0 then 'INTERN' end as kind, o_orderkey % 13 = 0 as cut from orders),
b as (select *, case when cut then ['malformed'] else list_filter([case when unit not in ('HOUR', 'DAY', 'WEEK', 'MONTH', 'YEAR') then 'unit' end, case when (unit is null) <> (low is null) then 'pair' end, case when high < low then 'range' end,
  case when low = 0 and kind is null then 'zero' end, case when hours not between 1 and 80 then 'hours' end], lambda x: x is not null) end as broken from r),
f as (select url, min(o_orderkey) as first from b where len(broken) = 0 group by 1)
select o_orderkey, case when len(broken) = 0 and o_orderkey = first then 'added' else 'error' end as status,
  case when len(broken) > 0 then array_to_string(broken, ',') when o_orderkey <> first then 'conflict' end as reason from b left join f using (url)"""


@query("split_rows", _RULES)
def split_rows(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of JSON texts made from orders, some of them cut: added, or an error with the rules they break."""
    k, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    unit = F.get(F.array(*[F.lit(u).cast("string") for u in ("HOUR", "DECADE", "YEAR", None, "WEEK")]), (k % 5).cast("int"))
    fields = F.struct(
        F.concat_ws("-", "o_custkey", k % 3).alias("url"), unit.alias("unit_text"), F.when(k % 7 == 1, F.lit(0)).when(k % 7 > 1, price).alias("min_value"),
        F.when(k % 4 == 0, price + 500 - k % 1000).alias("max_value"), (k % 90).alias("hours_per_week"), F.when(k % 2 == 0, "INTERN").alias("employment_type"),
    )
    text = F.to_json(fields)
    lines = table(spark, d, "orders").select(k, F.when(k % 13 == 0, F.substr(text, F.lit(1), F.length(text) - 5)).otherwise(text).alias("line"))
    parts = admission.split(admission.parsed(lines, "line", _FIELDS), admission.pay_checks(), unique=["url"], order="o_orderkey")
    return admission.statuses(parts, "o_orderkey")


@query(
    "stored_batches",
    """
select o_orderkey, o_custkey, case when o_orderkey % 20 = 0 then -1.0 else o_totalprice end as o_totalprice from orders
union all select -1 - o_orderkey, o_custkey, o_totalprice from orders where o_orderkey % 50 = 0""",
)
def stored_batches(spark: SparkSession, d: str) -> DataFrame:
    """Orders after three batches: changed, equal and new rows; the same again; and an older one that comes late."""
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders").select(k, "o_custkey", "o_totalprice")
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    stored.create(orders, path, "o_orderkey")
    changed = orders.where(k % 10 == 0).withColumn("o_totalprice", F.when(k % 20 == 0, -1.0).otherwise(F.col("o_totalprice")))
    batch = changed.unionByName(orders.where(k % 50 == 0).withColumn("o_orderkey", -1 - k))
    for number, rows in ((2, batch), (2, batch), (1, changed.where(k % 20 == 0).withColumn("o_totalprice", F.lit(-2.0)))):
        stored.upsert(spark, path, rows, "o_orderkey", number)
    return stored.rows(spark, path)
