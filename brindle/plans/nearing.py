"""Queries of places: customers and suppliers that are near each other, and names that several places have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import numbers as N
from brindle.operators import nearby
from brindle.plans.registry import query
from brindle.sources.tables import table

_SQL = f"""
with u as (select c_custkey, 42 + (c_custkey * 37 % 1400) / 100 as a, -135 + (c_custkey * 91 % 8000) / 100 as b, [[], ['remote'], ['office'], ['remote', 'hybrid'], null][c_custkey % 5 + 1] as wants from customer where c_custkey % 17 > 0),
s as (select s_suppkey, 42 + (s_suppkey * 53 % 1400) / 100 as c, -135 + (s_suppkey * 29 % 8000) / 100 as d, ['remote', 'hybrid', 'office', null][s_suppkey % 4 + 1] as work, case when s_suppkey % 9 = 0 then 'state' else 'rooftop' end as accuracy from supplier),
m as (select *, 2 * {N.EARTH} * asin(least(1.0, sqrt(pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2)))) as metres from u, s)
select c_custkey, s_suppkey, round(metres, 3) as metres, case when work = 'remote' and list_contains(wants, 'remote') then 1.0 when work = 'remote' then null when work <> 'remote' and wants = ['remote'] then null
  when work = 'hybrid' and not coalesce(list_has_any(wants, ['hybrid', 'office']), false) then null when c_custkey % 50 = s_suppkey % 50 then 1.0 when accuracy = 'state' then null when metres <= 50000 then 1.0 else 0.5 end::double as score
from m where metres <= 150000"""


@query("near_pairs", _SQL)
def near_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers within 150 km, with distances and scores; places and kinds of work follow rules of the keys."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    lit = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    wants = F.get(F.array(lit(), lit("remote"), lit("office"), lit("remote", "hybrid"), F.lit(None).cast("array<string>")), (c % 5).cast("int"))
    left = table(spark, d, "customer").select(c, F.when(c % 17 > 0, F.lit(42) + (c * 37 % 1400) / 100).alias("a"), (F.lit(-135) + (c * 91 % 8000) / 100).alias("b"), nearby.wishes(wants).alias("wish"))
    work = F.get(lit("remote", "hybrid", "office", None), (s % 4).cast("int"))
    right = table(spark, d, "supplier").select(
        s, (F.lit(42) + (s * 53 % 1400) / 100).alias("c"), (F.lit(-135) + (s * 29 % 8000) / 100).alias("d"), work.alias("work"), F.when(s % 9 == 0, "state").otherwise("rooftop").alias("accuracy")
    )
    near = nearby.within(left, right, 150_000, ("a", "b"), ("c", "d"))
    score = nearby.wished_score(F.col("wish"), F.col("work"), c % 50 == s % 50, F.col("accuracy"), F.col("metres"))
    return near.select("c_custkey", "s_suppkey", F.round("metres", 3).alias("metres"), score.alias("score"))


@query(
    "chosen_places",
    """
with p as (select n_nationkey as k, 'York ' || (n_nationkey % 5) as city, chr((65 + n_nationkey // 5)::int) as province, 45.0 + n_nationkey as lat, -75.0 - n_nationkey as lng from nation),
m as (select c_custkey, 'york ' || (c_custkey % 6) as name, case when c_custkey % 3 = 0 then chr((65 + c_custkey % 7)::int) end as province, case when c_custkey % 4 = 1 then chr((65 + c_custkey % 5)::int) end as fallback,
  case when c_custkey % 2 = 0 then 45.2 + c_custkey % 25 end as lat, -75.3 - c_custkey % 25 as lng from customer),
r as (select c_custkey, city, p.province, p.lat, p.lng, m.lat as own_lat, m.lng as own_lng, coalesce(abs(m.lat - p.lat) < 0.5 and abs(m.lng - p.lng) < 0.5, false) as near, m.province as said,
  row_number() over (partition by c_custkey order by coalesce(m.province = p.province, false) desc, coalesce(m.fallback = p.province, false) desc, coalesce(abs(m.lat - p.lat) < 0.5 and abs(m.lng - p.lng) < 0.5, false) desc, p.province) as place from m join p on lower(city) = name)
select c_custkey, city, province, case when near and coalesce(said = province, true) then own_lat else lat end::double as lat, case when near and coalesce(said = province, true) then own_lng else lng end::double as lng, near and coalesce(said = province, true) as precise from r where place = 1""",
)
def chosen_places(spark: SparkSession, d: str) -> DataFrame:
    """The place that each mention of a name of several means."""
    n, c = F.col("n_nationkey"), F.col("c_custkey")
    letter = lambda x: F.char((F.lit(65) + x).cast("int"))
    places = table(spark, d, "nation").select(F.concat(F.lit("York "), (n % 5).cast("int")).alias("city"), letter(F.floor(n / 5)).alias("province"), (n + 45.0).alias("lat"), (F.lit(-75.0) - n).alias("lng"))
    mentions = table(spark, d, "customer").select(
        c, F.concat(F.lit("york "), (c % 6).cast("int")).alias("name"), F.when(c % 3 == 0, letter(c % 7)).alias("province"), F.when(c % 4 == 1, letter(c % 5)).alias("fallback"),
        F.when(c % 2 == 0, F.lit(45.2) + c % 25).alias("lat"), (F.lit(-75.3) - c % 25).alias("lng"),
    )
    return nearby.chosen_places(mentions, places, "c_custkey")
