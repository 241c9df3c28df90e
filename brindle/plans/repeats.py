"""Queries of near-duplicate postings whose texts leave no ratio open, so that SQL can say the same; orders stand for postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import loading, postings
from brindle.plans.registry import query
from brindle.sources.tables import table

_TITLES = ["The Board Directors (new)", "Clerk of Works", "Environmental CoordinatorNew", "Volunteer boss", "Part-time nurses' aide", "of the"]
_CORES = ["board director", "clerk work", "coordinator environmental", "boss", "aide nurse", ""]
_WORDS = ["board director new", "clerk work", "coordinator environmental", "boss volunteer", "aide nurse part time", ""]
_URLS = ["https://ca.indeed.com/x?jobId=1234{n}", "http://www.glassdoor.ca/job/clerk-9900{n}/", "https://jobs.example.org/{n}", "https://www.linkedin.com/jobs/{n}"]
_HOSTS = ["indeed.com", "glassdoor.com", "jobs.example.org", "linkedin.com"]

_POSTS = """
with p as (select o_orderkey as id, o_custkey % 600 as org, o_orderkey % 3 as t, cast(o_orderdate as date) as d, ['a', 'b', 'c', 'd'][o_orderkey // 5 % 4 + 1] as body, o_orderkey // 2 as url from orders)
"""


def _posts(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda n, values, by=k: F.get(F.array(*map(F.lit, values)), (by % n).cast("int"))
    return table(spark, d, "orders").select(
        k.alias("id"), (c % 600).cast("string").alias("org"), pick(3, ["Head clerk", "Clerk and typist", "Nurse"]).alias("title"), F.concat(F.lit("https://h/"), F.floor(k / 2).cast("string")).alias("url"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("posted"), F.repeat(pick(4, ["a", "b", "c", "d"], F.floor(k / 5)), F.lit(100)).alias("body"), F.lit(None).cast("string").alias("city"),
        F.lit(None).cast("string").alias("province"), F.lit(None).cast("string").alias("kind"), F.lit("s").alias("source"),
    )


@query(
    "posting_fields",
    f"""
select o_orderkey as id, {_WORDS}[o_orderkey % 6 + 1] as words, {_CORES}[o_orderkey % 6 + 1] as core, datediff('day', date '1970-01-01', cast(o_orderdate as date)) as day,
  case o_orderkey % 3 when 0 then 'montreal' when 1 then 'laval' end as city, case o_orderkey % 4 when 0 then 'QC' when 1 then 'ON' end as prov, {_HOSTS}[o_orderkey % 4 + 1] as host,
  case o_orderkey % 4 when 0 then '1234' || o_orderkey when 1 then '9900' || o_orderkey end as number, case when o_orderkey % 2 = 0 then '12hours,35h' else '' end as hours from orders where o_orderkey % 6 < 5""",
)
def posting_fields(spark: SparkSession, d: str) -> DataFrame:
    """What postings are compared by: words of roles, days, places, boards, listing numbers and hours."""
    k = F.col("o_orderkey")
    pick = lambda n, values: F.get(F.array(*map(F.lit, values)), (k % n).cast("int"))
    made = table(spark, d, "orders").select(
        k.alias("id"), F.lit("o").alias("org"), pick(6, _TITLES).alias("title"), F.replace(pick(4, _URLS), F.lit("{n}"), k.cast("string")).alias("url"), F.date_format("o_orderdate", "yyyy/MM/dd").alias("posted"),
        F.when(k % 2 == 0, "Work 35 h a week, or 12 hours. 35h!").otherwise("No hours: 7 days").alias("body"), pick(3, [" MONTRÉAL", "Laval", " "]).alias("city"), pick(4, ["québec", "ON", "somewhere", ""]).alias("province"),
        F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("source"), F.lit(True).alias("new"), F.lit(True).alias("known"),
    )
    rows = postings.compared(made)
    return rows.select("id", F.array_join("words", " ").alias("words"), "core", "day", "city", "prov", "host", "number", F.array_join("hours", ",").alias("hours"))


@query(
    "posting_islands",
    _POSTS
    + """, g as (select *, case when d - lag(d) over w <= 21 then 0 else 1 end as cut from p window w as (partition by org, t order by d, id)),
i as (select *, sum(cut) over (partition by org, t order by d, id rows unbounded preceding) as i from g),
c as (select org, t, i, min(id) as cluster, min(id) as keeper, count(*) as n, count(distinct url) as urls from i group by 1, 2, 3)
select id, cluster, keeper, n from i join c using (org, t, i) where urls > 1""",
)
def posting_islands(spark: SparkSession, d: str) -> DataFrame:
    """Groups of postings of one role whose days are close, one after the other; nothing else tells them apart."""
    return postings.clusters(_posts(spark, d))


_SAME = "a.org = b.org and a.t = b.t and a.body = b.body and a.url <> b.url and abs(datediff('day', a.d, b.d)) <= 21"


@query("posting_copies", _POSTS + f"select a.id, min(b.id) as duplicate_of from p a join p b on {_SAME} group by 1 having min(b.id) < a.id")
def posting_copies(spark: SparkSession, d: str) -> DataFrame:
    """Postings with the same text as an earlier one of their role, and the first of these."""
    rows = _posts(spark, d)
    return postings.confident_duplicates(rows, rows, earlier=True)


@query(
    "posting_statuses",
    _POSTS
    + f""", stored as (select * from p where id % 8 < 2), f as (select url, min(id) as first from p where id % 11 > 0 group by 1),
alike as (select distinct a.id from p a join stored b on {_SAME} union select a.id from p a join p b on {_SAME} and b.id < a.id)
select id, case when id % 11 = 0 then 'refused' when url in (select url from stored) then 'known' when id <> first then 'repeated' when id in (select id from alike) then 'duplicate' end as reason,
  case when id % 11 = 0 then 'skipped' when url in (select url from stored) then 'updated' when id <> first or id in (select id from alike) then 'skipped' else 'added' end as status
from p left join f using (url)""",
)
def posting_statuses(spark: SparkSession, d: str) -> DataFrame:
    """What a batch of postings does to a stored table."""
    rows = _posts(spark, d)
    return loading.save_status(rows, rows.where("id % 8 < 2"), refused=F.col("id") % 11 == 0, override=True)
