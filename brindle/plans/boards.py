"""The board's queries: orders stand for postings, with what their tables lack made from keys by rule."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import extract as X
from brindle.functions import rules as R
from brindle.operators import board as B
from brindle.operators import relational
from brindle.plans.registry import query
from brindle.sources.tables import table

NOW = datetime(2001, 8, 1, 12)
BRANDS = {"Indeed": r"^indeed(\.|\b)", "Charity": r"^charity"}

_JOBS = r"""
with jobs as (select o_orderkey as id, c_name as organization, o_orderpriority as title, strftime(o_orderdate, '%Y-%m-%d') as posted,
  case o_orderstatus when 'P' then 'remote' when 'F' then 'office' else 'hybrid' end as work_type, n_name as city, r_name as province,
  ['Indeed Canada', 'indeed.ca', 'CharityVillage', ' Other Board '][o_orderkey % 4 + 1] as source,
  case when c_custkey % 10 <> 0 then c_acctbal > 0 end as is_eligible, o_orderkey % 5 < 4 as has_pay,
  case when o_orderkey % 5 < 4 then cast(floor(o_totalprice) as bigint) * 100 end as min_value, ['HOUR', 'WEEK', 'YEAR'][o_orderkey % 3 + 1] as unit_text,
  case when o_orderkey % 2 = 0 then 30 end as hours_per_week, case when o_orderkey % 11 > 0 then o_orderkey * 37 % 1000 / 1000 end as match_score,
  o_orderkey * 53 % 1000 / 1000 as value_score, o_orderkey * 71 % 1000 / 1000 as skill_score
  from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey)
"""


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda n, *values: F.get(F.array(*map(F.lit, values)), (k % n).cast("int"))
    joined = relational.star(
        table(spark, d, "orders"),
        [(table(spark, d, "customer"), "o_custkey", "c_custkey"), (table(spark, d, "nation"), "c_nationkey", "n_nationkey"), (table(spark, d, "region"), "n_regionkey", "r_regionkey")],
    )
    status = F.col("o_orderstatus")
    return joined.select(
        k.alias("id"), F.col("c_name").alias("organization"), F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("posted"),
        F.when(status == "P", "remote").when(status == "F", "office").otherwise("hybrid").alias("work_type"), F.col("n_name").alias("city"), F.col("r_name").alias("province"),
        pick(4, "Indeed Canada", "indeed.ca", "CharityVillage", " Other Board ").alias("source"),
        F.when(F.col("o_custkey") % 10 != 0, F.col("c_acctbal") > 0).alias("is_eligible"), (k % 5 < 4).alias("has_pay"),
        F.when(k % 5 < 4, F.floor("o_totalprice").cast("long") * 100).alias("min_value"), pick(3, "HOUR", "WEEK", "YEAR").alias("unit_text"),
        F.when(k % 2 == 0, F.lit(30)).alias("hours_per_week"), F.when(k % 11 > 0, k * 37 % 1000 / 1000).alias("match_score"),
        (k * 53 % 1000 / 1000).alias("value_score"), (k * 71 % 1000 / 1000).alias("skill_score"),
    )


#: Selections by name, with the same in SQL.
_SEEN = f"posted >= '{B.since(NOW, 28)}'"
_YES, _PAID = "coalesce(is_eligible, false)", "coalesce(has_pay, false)"
SELECTIONS = {
    "all": (B.Filters(eligible_only=False, paid_only=False), _SEEN),
    "default": (B.Filters(), f"{_SEEN} and {_YES} and {_PAID}"),
    "week": (B.Filters(within="1-week", paid_only=False), f"posted >= '{B.since(NOW, 7)}' and {_YES}"),
    "search": (B.Filters(search=" URGENT ", searched=("title", "organization", "city"), eligible_only=False), f"{_SEEN} and {_PAID} and (contains(lower(title), 'urgent') or contains(lower(organization), 'urgent') or contains(lower(city), 'urgent'))"),
    "remote": (
        B.Filters(selected={"work_type": ["remote", "hybrid"]}, places={"province": ["ASIA", "EUROPE"]}, eligible_only=False, paid_only=False),
        f"{_SEEN} and work_type in ('remote', 'hybrid') and (work_type = 'remote' or coalesce(province in ('ASIA', 'EUROPE'), false))",
    ),
    "placed": (
        B.Filters(selected={"work_type": ["office", "hybrid"]}, places={"province": ["ASIA", "EUROPE"]}, eligible_only=False, paid_only=False),
        f"{_SEEN} and work_type in ('office', 'hybrid') and coalesce(province in ('ASIA', 'EUROPE'), false)",
    ),
    "brand": (B.Filters(sources=["Indeed Canada", "Other Board"], paid_only=False), f"{_SEEN} and {_YES} and trim(source) in ('Indeed Canada', 'indeed.ca', 'Other Board')"),
}


@query("board_filters", _JOBS + " union all ".join(f"select '{n}' as selection, id from jobs where {w}" for n, (_, w) in SELECTIONS.items()))
def board_filters(spark: SparkSession, d: str) -> DataFrame:
    """The postings that each of several selections leaves."""
    jobs, out = _jobs(spark, d), None
    for name, (f, _) in SELECTIONS.items():
        one = jobs.where(B.condition(f, NOW, BRANDS)).select(F.lit(name).alias("selection"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "board_counts",
    _JOBS
    + f"""select '{{}}' as selection, count_if({{}}) as selected, count_if({_SEEN} and {_YES} and {_PAID}) as available from jobs
union all select 'search', count_if({SELECTIONS['search'][1]}), count_if({_SEEN} and {_PAID}) from jobs""".format("default", SELECTIONS["default"][1]),
)
def board_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many postings a selection leaves, and of how many."""
    jobs = _jobs(spark, d)
    one = lambda n: B.board_counts(jobs, SELECTIONS[n][0], NOW, BRANDS).select(F.lit(n).alias("selection"), "selected", "available")
    return one("default").unionByName(one("search"))


_YEARLY = "case unit_text when 'HOUR' then min_value * coalesce(hours_per_week * 52, 2080) when 'WEEK' then min_value * 52 else min_value end"
_ORDERS = {
    "date-desc": "posted desc nulls first", "date-asc": "posted nulls last", "match-desc": "match_score desc nulls first", "value-match-desc": "value_score desc nulls first",
    "skill-match-desc": "skill_score desc nulls first", "salary-desc": "min_value desc nulls last", "salary-asc": "min_value nulls last", "org-asc": "organization nulls last",
    "org-desc": "organization desc nulls first",
}


@query(
    "board_sorts",
    _JOBS
    + " union all ".join(
        f"(select '{name}' as sort, id from jobs where {SELECTIONS['all'][1]} order by {by}, id limit 20 offset 20)"
        for name, by in [*_ORDERS.items(), ("yearly salary-desc", f"{_YEARLY} desc nulls last"), ("yearly salary-asc", f"{_YEARLY} nulls last")]
    ),
)
def board_sorts(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a selection in each of the nine orders, and by pay of a year."""
    jobs, out = _jobs(spark, d), None
    for name in [*B.SORTS, "yearly salary-desc", "yearly salary-asc"]:
        page = B.board_page(jobs, SELECTIONS["all"][0], NOW, name.split(" ")[-1], 2, 20, annual=" " in name)
        one = page.select(F.lit(name).alias("sort"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "posting_lookup",
    _JOBS + "select id, posted from jobs where organization ilike '%#0000_2%' or title ilike '%urg_nt%' order by posted desc, id limit 50",
)
def posting_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The 50 newest postings whose organisation or title holds a text with wildcards."""
    found = _jobs(spark, d).where(B.any_like(["organization"], "#0000_2") | B.any_like(["title"], "urg_nt"))
    return found.orderBy(F.col("posted").desc(), "id").limit(50).select("id", "posted")


@query(
    "directory_matches",
    "select p_partkey from part where p_name ilike '%BL_e%' or p_brand ilike '%BL_e%' or p_type ilike '%BL_e%'",
)
def directory_matches(spark: SparkSession, d: str) -> DataFrame:
    """Rows of which any of several columns holds a text."""
    return table(spark, d, "part").where(B.any_like(["p_name", "p_brand", "p_type"], "BL_e")).select("p_partkey")


@query(
    "backlog_rows",
    _JOBS
    + f"""select id, coalesce(min_value is null, false) as needs_pay from jobs where (case when id % 3 = 0 then strftime(cast(posted as date) + 30, '%Y-%m-%d') end >= '{B.since(NOW, 60)}'
  or posted >= '{B.since(NOW, 60)[:10]}') and case when id % 7 = 0 then 'parked' end is null and (min_value is null or is_eligible is null)""",
)
def backlog_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the last 60 days that still lack something and weren't parked."""
    jobs = _jobs(spark, d).withColumn("scraped", F.when(F.col("id") % 3 == 0, F.date_format(F.date_add(F.to_date("posted"), 30), "yyyy-MM-dd")))
    rows = jobs.withColumn("parked", F.when(F.col("id") % 7 == 0, "parked")).where(B.looked_back("scraped", "posted", NOW, 60) & F.col("parked").isNull())
    lacking = rows.withColumn("needs", relational.needs({"pay": F.col("min_value").isNull(), "eligible": F.col("is_eligible").isNull()})).where(F.size("needs") > 0)
    return lacking.select("id", F.array_contains("needs", "pay").alias("needs_pay"))


LEGACY = {"BUILDING-OLD": "BUILDING", "HOUSES": "BUILDING", "CARS": "AUTOMOBILE"}


@query(
    "legacy_sectors",
    "select c_custkey from (select c_custkey, case when c_custkey % 5 = 0 and c_mktsegment = 'BUILDING' then 'HOUSES' else c_mktsegment end as s from customer) where s in ('BUILDING', 'BUILDING-OLD', 'HOUSES')",
)
def legacy_sectors(spark: SparkSession, d: str) -> DataFrame:
    """Organisations of a sector, by its present and earlier ids."""
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    rows = table(spark, d, "customer").select(k, F.when((k % 5 == 0) & (s == "BUILDING"), "HOUSES").otherwise(s).alias("s"))
    return rows.where(relational.optional_in("s", B.expand_ids(["BUILDING-OLD"], LEGACY))).select("c_custkey")


@query(
    "bookmarks",
    _JOBS
    + """, marks as (select floor(value)::bigint as id, min(event_id) as place from events where user_id % 2 = 0 group by 1)
select id, place, organization from marks join jobs using (id)""",
)
def bookmarks(spark: SparkSession, d: str) -> DataFrame:
    """Postings of a list of bookmarks with their places in it; the operator's own order isn't part of the rows."""
    marks = table(spark, d, "events").where("user_id % 2 = 0").select(F.floor("value").alias("id"), F.col("event_id").alias("place"))
    return B.hydrate(marks, _jobs(spark, d), "id", "place").select("id", "place", "organization")


@query(
    "user_scores",
    """
select l_orderkey, l_partkey, l_discount from lineitem where l_suppkey = 3 and l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')""",
)
def user_scores(spark: SparkSession, d: str) -> DataFrame:
    """One user's scores of listed postings."""
    ids = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return B.scores_for(table(spark, d, "lineitem"), F.col("l_suppkey") == 3, ids, "l_orderkey").select("l_orderkey", "l_partkey", "l_discount")


@query(
    "skill_labels",
    """
with l as (select p_partkey as uri, case when p_partkey % 9 > 0 then p_brand end as label from part)
select l_orderkey, string_agg(uri || '=' || label, ',' order by uri) as labels from (select distinct l_orderkey, l_partkey from lineitem) join l on l_partkey = uri where label is not null group by 1""",
)
def skill_labels(spark: SparkSession, d: str) -> DataFrame:
    """A map of labels for each row's list of keys."""
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("uris"))
    labels = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 > 0, F.col("p_brand")).alias("label"))
    found = B.labels_of(lists, "l_orderkey", "uris", labels, "p_partkey", "label")
    entries = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"]))
    return found.select("l_orderkey", F.array_join(entries, ",").alias("labels"))


@query(
    "display_dedupe",
    """
select p_partkey from (select p_partkey, row_number() over (partition by lower(trim(p_name)) || '::' || lower(trim(p_brand)) || '::' order by p_retailprice desc, p_partkey) as n from part) where n = 1""",
)
def display_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The best row of those that would look the same."""
    key = X.display_key(F.col("p_name"), F.upper("p_brand"), F.lit(None).cast("string"))
    return B.distinct_display(table(spark, d, "part"), key, [F.col("p_retailprice").desc(), F.col("p_partkey")]).select("p_partkey")


@query(
    "starter_labels",
    """
select p_partkey, label from (select p_partkey, case when p_partkey % 3 = 0 then p_brand when p_partkey % 3 = 1 then p_type end as label from part order by label nulls last, p_partkey limit 1000) where label is not null""",
)
def starter_labels(spark: SparkSession, d: str) -> DataFrame:
    """The first thousand rows by label, in one language or else another, without those that have none."""
    k = F.col("p_partkey") % 3
    label = F.coalesce(F.when(k == 0, F.col("p_brand")), F.when(k == 1, F.col("p_type")))
    return B.starter_list(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), label, 1000).select("p_partkey", "label")


@query(
    "shared_values",
    """
with v as (select p_size as s, list(distinct p_brand order by p_brand desc) as own from part group by 1)
select a.s, array_to_string(list_filter(a.own, lambda x: list_contains(b.own, x)), ',') as shared, len(list_filter(a.own, lambda x: list_contains(b.own, x))) as n,
  a.own[1] || ':1' as best from v a join v b on b.s = a.s + 1""",
)
def shared_values(spark: SparkSession, d: str) -> DataFrame:
    """Values that two have in common, in the order of the first; and its best with its rank."""
    v = table(spark, d, "part").groupBy(F.col("p_size").alias("s")).agg(F.sort_array(F.collect_set("p_brand"), asc=False).alias("own"))
    both = v.join(v.select((F.col("s") - 1).alias("s"), F.col("own").alias("other")), "s")
    shared, best = X.shared_in_order(F.col("own"), F.col("other")), F.get(X.ranked(F.col("own")), F.lit(0))
    return both.select("s", F.array_join(shared, ",").alias("shared"), F.size(shared).cast("long").alias("n"), F.concat_ws(":", best["value"], best["rank"].cast("string")).alias("best"))


@query(
    "governance_cards",
    """
with o as (select 'GOV_' || (c_nationkey % 4) as category, c_name from customer where c_nationkey % 4 > 0)
select category, count(*) as n, array_to_string(list(distinct c_name order by c_name)[1:3], '|') as names from o group by 1""",
)
def governance_cards(spark: SparkSession, d: str) -> DataFrame:
    """Organisations of each category and three of their names, without the excluded."""
    n = F.col("c_nationkey") % 4
    rows = table(spark, d, "customer").select(R.category_of(F.when(n == 0, "EXCLUDED").otherwise(F.concat(F.lit("SUB_"), n.cast("string")))).alias("category"), "c_name", F.lit("").alias("none"))
    made = relational.cards(rows.where("category <> 'EXCLUDED'"), "category", "c_name", "none")
    return made.select("category", "n", F.array_join("names", "|").alias("names"))


@query(
    "demotions",
    """
select o_orderkey, case when o_orderkey % 2 = 0 then coalesce(o_orderkey % 13 > 0 and c_acctbal > 0, false) when o_orderkey % 3 = 0 then null else false end as is_eligible
from orders left join (select c_custkey, case when c_custkey % 10 <> 0 then c_acctbal end as c_acctbal from customer) on o_custkey = c_custkey and o_orderkey % 13 > 0""",
)
def demotions(spark: SparkSession, d: str) -> DataFrame:
    """Postings after a check that only eligible organisations have eligible ones; those without an organisation have none."""
    k = F.col("o_orderkey")
    items = table(spark, d, "orders").select(k, F.when(k % 13 > 0, F.col("o_custkey")).alias("owner"), F.when(k % 2 == 0, True).when(k % 3 == 0, None).otherwise(False).alias("is_eligible"))
    owners = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal") > 0).alias("is_eligible"))
    return R.demoted(items, owners, "owner", "c_custkey", "is_eligible").select("o_orderkey", "is_eligible")


@query(
    "flag_requests",
    """
select event_id as o_orderkey, event_id % 2 = 0 as wanted, case when o_orderkey is null then 'missing' when event_id % 2 = 0 and not coalesce(c_acctbal > 0, false) then 'refused'
  when (o_orderkey % 3 = 0) = (event_id % 2 = 0) then 'same' else 'set' end as status
from events left join orders on event_id = o_orderkey left join customer on o_custkey = c_custkey""",
)
def flag_requests(spark: SparkSession, d: str) -> DataFrame:
    """Flags set by hand, refused where the organisation isn't eligible."""
    requests = table(spark, d, "events").select(F.col("event_id").alias("o_orderkey"), (F.col("event_id") % 2 == 0).alias("wanted"))
    items = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 3 == 0).alias("flag"))
    owners = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("flag"))
    return R.flag_requests(requests, items, owners, "o_orderkey", "o_custkey", "c_custkey", "flag")


@query(
    "reason_lines",
    "select event_type, count(*) as n, event_type || ' × ' || count(*) as line from events group by 1",
)
def reason_lines(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each reason as lines of a report."""
    return relational.reason_lines(table(spark, d, "events"), "event_type")


@query("name_lists", "select n_regionkey, string_agg(n_name, ', ' order by n_name) as names from (select distinct n_regionkey, n_name from nation) group by 1")
def name_lists(spark: SparkSession, d: str) -> DataFrame:
    """The names of each group in one text."""
    return relational.name_lists(table(spark, d, "nation"), "n_regionkey", "n_name")
