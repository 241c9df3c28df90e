"""Queries of choices: labels for many searches, options that are left, orders of a directory, answers that put lists in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import extract
from brindle.operators import lookup, relational
from brindle.plans.listings import CUTOFF, _day, _orders
from brindle.plans.registry import query
from brindle.sources.tables import table

_GRAMS = "list_distinct(flatten(list_transform(string_split({x}, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_ASKED = "(select distinct p_name as wish from part union select distinct left(p_type, 2) from part)"
_TERMS = """select p_partkey, case when p_partkey % 3 = 0 then lower(p_type) else p_name end as term, null as alias from part
  union select p_partkey, lower(p_type), lower(p_type) from part where p_partkey % 4 > 0 union select p_partkey, split_part(p_name, ' ', 2), split_part(p_name, ' ', 2) from part where p_partkey % 4 > 0"""
_HITS = f"""
with s as (select wish, {_GRAMS.format(x="lower(wish)")} as a from {_ASKED}), o as ({_TERMS}), t as (select distinct term, {_GRAMS.format(x="term")} as b from o),
m as (select wish, term, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) as j, length(wish) < 3 and starts_with(term, lower(wish)) as begins from s cross join t),
h as (select wish, term, case when j >= 0.3 then j else 0.1 end as score from m where j >= 0.3 or begins),
b as (select wish, p_partkey, alias, score, row_number() over (partition by wish, p_partkey order by score desc, alias is not null, alias) as n from h join o using (term))"""


def _hits(spark: SparkSession, d: str, limit: int | None = None) -> DataFrame:
    """Parts by their names; every third has none and goes by its type; every fourth has no aliases."""
    parts, k = table(spark, d, "part"), F.col("p_partkey")
    aliases = F.when(k % 4 > 0, F.array("p_type", F.split_part("p_name", F.lit(" "), F.lit(2))))
    lower = F.transform(aliases, lambda a: F.lower(a))
    asked = parts.select(F.col("p_name").alias("wish")).union(parts.select(F.left("p_type", F.lit(2))))
    return lookup.search_labels(parts, "p_partkey", F.when(k % 3 > 0, F.col("p_name")), lower, asked, "wish", limit, F.lower("p_type"))


@query(
    "label_searches",
    f"""{_HITS}
select wish, p_partkey, case when score >= 0.3 then alias end as matched_alias, round(score, 6) as score from b where n = 1""",
)
def label_searches(spark: SparkSession, d: str) -> DataFrame:
    """All labels that each of many searches finds, by themselves, by what stands in for them, or by an alias."""
    return _hits(spark, d).select("wish", "p_partkey", "matched_alias", F.round("score", 6).alias("score"))


@query(
    "selected_labels",
    f"""{_HITS}
select wish, p_partkey, round(score, 6) as score, row_number() over (partition by wish order by score desc, p_partkey) as place from b where n = 1 and score > 0.4
qualify row_number() over (partition by wish order by score desc, p_partkey) <= 50""",
)
def selected_labels(spark: SparkSession, d: str) -> DataFrame:
    """Of each search's labels the fifty best that score over 0.4."""
    hits = _hits(spark, d).select("wish", "p_partkey", "score")
    return relational.selected(hits, "wish", "score", "p_partkey").withColumn("score", F.round("score", 6))


@query(
    "facet_availability",
    f"""
with c as (select * from customer where c_custkey in (select o_custkey from orders where o_orderdate >= timestamp '{CUTOFF}' and o_orderstatus = 'O'))
select 'c_mktsegment' as facet, c_mktsegment as value, count(*) as n from c where c_mktsegment <> 'MACHINERY' group by 2
union all select 'c_nationkey', c_nationkey::varchar, count(*) from c group by 2""",
)
def facet_availability(spark: SparkSession, d: str) -> DataFrame:
    """Sectors and countries of organisations with recent open postings."""
    wanted = (F.col("o_orderdate") >= _day()) & (F.col("o_orderstatus") == "O")
    return relational.available_options(table(spark, d, "customer"), _orders(spark, d), "c_custkey", "o_custkey", ["c_mktsegment", "c_nationkey"], wanted, ["MACHINERY"])


@query(
    "directory_orders",
    f"""
with recent as (select o_custkey, max(o_orderdate) as latest from orders where o_orderdate >= timestamp '{CUTOFF}' group by o_custkey),
c as (select c_custkey, c_name, latest, case when c_custkey % 3 > 0 then floor(c_acctbal / 1000) end as value_score from customer left join recent on c_custkey = o_custkey),
o as (select 'date-desc' as sort, c_custkey, row_number() over (order by latest desc nulls last, c_name, c_custkey) as place from c
union all select 'value-match-desc', c_custkey, row_number() over (order by value_score desc nulls last, c_name, c_custkey) from c
union all select 'org-desc', c_custkey, row_number() over (order by c_name desc, c_custkey) from c
union all select 'org-asc', c_custkey, row_number() over (order by c_name, c_custkey) from c)
select sort, c_custkey from o where place between 21 and 60""",
)
def directory_orders(spark: SparkSession, d: str) -> DataFrame:
    """A page of the directory in each of its orders."""
    score = F.when(F.col("c_custkey") % 3 > 0, F.floor(F.col("c_acctbal") / 1000))
    found = relational.directory(table(spark, d, "customer"), _orders(spark, d), "c_custkey", "o_custkey", "o_orderdate", _day()).withColumn("value_score", score)
    page = lambda s: relational.page(found, relational.directory_order(s, "c_name", "c_custkey"), 40, 20).select(F.lit(s).alias("sort"), "c_custkey")
    return reduce(DataFrame.union, map(page, ["date-desc", "value-match-desc", "org-desc", "org-asc"]))


@query(
    "reranked_lists",
    """
with l as (select l_orderkey, list(l_partkey::varchar order by l_linenumber, l_partkey) as ids, list(l_partkey::varchar order by l_quantity desc, l_partkey, l_linenumber) filter (where l_quantity > 25) as said from lineitem group by 1),
k as (select l_orderkey, ids, case when l_orderkey % 5 > 0 then list_filter(coalesce(said, []), lambda v: v[-1] <> '7') else [] end as s from l),
d as (select l_orderkey, ids, list_filter(s, lambda v, i: list_position(s, v) = i) as s from k)
select l_orderkey, array_to_string(case when len(s) > 0 then s[1:4] else ids[1:4] end, ',') as ids from d""",
)
def reranked_lists(spark: SparkSession, d: str) -> DataFrame:
    """The first four of each order's parts, in the order that an answer gives them; some answers are cut off, name nothing known, or name things twice."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.col("l_partkey").alias("p")).alias("a"), F.struct((-F.col("l_quantity")).alias("q"), F.col("l_partkey").alias("p"), "l_linenumber").alias("b"), "l_quantity")
    known = F.transform(F.sort_array(F.collect_list("a")), lambda x: x["p"].cast("string"))
    said = F.transform(F.sort_array(F.collect_list(F.when(F.col("l_quantity") > 25, F.col("b")))), lambda x: x["p"].cast("string"))
    rows = lines.groupBy("l_orderkey").agg(known.alias("known"), said.alias("said"))
    named = F.transform("said", lambda v: F.when(F.endswith(v, F.lit("7")), F.concat(F.lit("x"), v)).otherwise(v))
    answer = F.to_json(F.struct(F.concat(F.array(F.lit("nothing")), named, F.slice(named, 1, 1)).alias("selected")))
    answer = F.when(F.col("l_orderkey") % 5 > 0, answer).otherwise(F.left(answer, F.lit(20)))
    return rows.select("l_orderkey", F.array_join(extract.reranked(F.col("known"), answer, most=4), ",").alias("ids"))
