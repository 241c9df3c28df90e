"""Directory, facet, diff and best-of queries: customers stand for organisations, orders for their postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import rules as R
from brindle.functions import text as T
from brindle.operators import curation, relational
from brindle.plans.registry import query
from brindle.sources.tables import table

CUTOFF = "2001-07-04"


def _day() -> Column:
    return F.lit(CUTOFF).cast("timestamp")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


@query(
    "org_directory",
    f"""
with recent as (select o_custkey, count(*) as n_recent, max(o_orderdate) as latest from orders where o_orderdate >= timestamp '{CUTOFF}' group by o_custkey)
select c_custkey, c_name, coalesce(n_recent, 0)::bigint as n_recent, cast(cast(latest as date) as varchar) as latest, (select count(*) from customer) as total
from customer left join recent on c_custkey = o_custkey
order by recent.latest desc nulls last, c_name, c_custkey limit 50 offset 50""",
)
def org_directory(spark: SparkSession, d: str) -> DataFrame:
    """Second page of organisations by their newest posting, with recent postings and the number of all organisations."""
    found = relational.directory(table(spark, d, "customer"), _orders(spark, d), "c_custkey", "o_custkey", "o_orderdate", _day())
    rows = relational.page(found, [F.col("latest").desc_nulls_last(), F.col("c_name"), F.col("c_custkey")], 50, 50)
    return rows.select("c_custkey", "c_name", F.col("n_recent").cast("long"), F.col("latest").cast("date").cast("string").alias("latest"), "total")


@query(
    "org_directory_search",
    f"""
with recent as (select o_custkey, count(*) as n_recent, max(o_orderdate) as latest from orders where o_orderdate >= timestamp '{CUTOFF}' group by o_custkey),
found as (select c.*, r.n_recent, r.latest from customer c join recent r on c_custkey = o_custkey
  where contains(lower(c_name), '#0000') and c_mktsegment in ('BUILDING', 'MACHINERY'))
select c_custkey, c_name, n_recent, cast(cast(latest as date) as varchar) as latest, (select count(*) from found) as total from found""",
)
def org_directory_search(spark: SparkSession, d: str) -> DataFrame:
    """All organisations with recent postings whose name holds a text, in chosen sectors."""
    owners = table(spark, d, "customer").where(T.like_literal(F.col("c_name"), "#0000") & relational.optional_in("c_mktsegment", ["BUILDING", "MACHINERY"]))
    found = relational.directory(owners, _orders(spark, d), "c_custkey", "o_custkey", "o_orderdate", _day(), require_recent=True)
    return found.select("c_custkey", "c_name", "n_recent", F.col("latest").cast("date").cast("string").alias("latest"), "total")


@query(
    "facet_options",
    """
select 'o_orderstatus' as facet, o_orderstatus as value, count(*) as n from orders group by 2
union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by 2""",
)
def facet_options(spark: SparkSession, d: str) -> DataFrame:
    """What can be chosen in each facet, and how many rows each choice has."""
    return relational.facet_options(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(
    "sector_cards",
    """
with counts as (select c_mktsegment, n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by all),
told as (select c_mktsegment, sum(n)::bigint as n, string_agg(n_name || ':' || n, '|' order by n desc, n_name) as categories from counts group by 1),
names as (select c_mktsegment, string_agg(c_name, '|' order by c_name) as names from
  (select distinct c_mktsegment, c_name, dense_rank() over (partition by c_mktsegment order by c_name) as r from customer) where r <= 3 group by 1)
select c_mktsegment, n, categories, names from told join names using (c_mktsegment)""",
)
def sector_cards(spark: SparkSession, d: str) -> DataFrame:
    """For each sector its organisations, nations by falling count, and three names."""
    joined = relational.star(table(spark, d, "customer"), [(table(spark, d, "nation"), "c_nationkey", "n_nationkey")])
    made = relational.cards(joined, "c_mktsegment", "c_name", "n_name")
    return made.select("c_mktsegment", "n", F.array_join("categories", "|").alias("categories"), F.array_join("names", "|").alias("names"))


@query(
    "star_matched_view",
    """
select o_orderkey, c_name, n_name, r_name, coalesce(s.score, 0)::double as score
from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey
left join region on n_regionkey = r_regionkey
left join (select l_orderkey, max(l_discount) as score from lineitem where l_suppkey = 1 group by 1) s on l_orderkey = o_orderkey""",
)
def star_matched_view(spark: SparkSession, d: str) -> DataFrame:
    """Every posting with its organisation, place, and one user's score or 0; the user is chosen before the join."""
    scores = table(spark, d, "lineitem").where("l_suppkey = 1").groupBy("l_orderkey").agg(F.max("l_discount").alias("score"))
    customer = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    joined = relational.star(
        table(spark, d, "orders").select("o_orderkey", "o_custkey"),
        [
            (customer, "o_custkey", "c_custkey"),
            (table(spark, d, "nation"), "c_nationkey", "n_nationkey"),
            (table(spark, d, "region"), "n_regionkey", "r_regionkey"),
            (scores, "o_orderkey", "l_orderkey"),
        ],
    )
    return joined.select("o_orderkey", "c_name", "n_name", "r_name", F.coalesce("score", F.lit(0.0)).alias("score"))


@query(
    "identity_dedupe",
    """
select o_orderkey, o_custkey from (select o_orderkey, o_custkey, row_number() over
  (partition by o_custkey, o_orderpriority, date_trunc('month', o_orderdate) order by o_orderkey) as rn from orders) where rn = 1""",
)
def identity_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first posting of each identity: organisation, kind and month."""
    rows = _orders(spark, d).withColumn("month", F.date_trunc("month", "o_orderdate"))
    return relational.best_per_key(rows, ["o_custkey", "o_orderpriority", "month"], [F.col("o_orderkey")]).select("o_orderkey", "o_custkey")


@query(
    "url_dedupe_best",
    r"""
with p as (select page_id, regexp_replace(trim(url), '/+$', '') as u, length(html) as n from pages)
select page_id, u from (select *, row_number() over (partition by u order by n desc nulls last, page_id) as rn from p) where rn = 1""",
)
def url_dedupe_best(spark: SparkSession, d: str) -> DataFrame:
    """The fullest page of each normal URL."""
    pages = table(spark, d, "pages").select("page_id", T.normal_url(F.col("url")).alias("u"), F.length("html").alias("n"))
    return relational.best_per_key(pages, ["u"], [F.col("n").desc_nulls_last(), F.col("page_id")]).select("page_id", "u")


@query(
    "url_domains",
    r"""
select nullif(regexp_extract(lower(url), '^[a-z]+://(?:www\.)?([^/:?#]+)', 1), '') as host, count(*) as n, min(page_id) as first_page from pages group by 1""",
)
def url_domains(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each host."""
    return table(spark, d, "pages").groupBy(T.domain(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


@query(
    "upsert_diff",
    """
with old as (select * from orders where o_orderkey % 7 <> 0),
new as (select o_orderkey, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as o_orderstatus,
  case when o_orderkey % 10 = 0 then null else o_orderpriority end as o_orderpriority from orders)
select n.o_orderkey, case when o.o_orderkey is null then 'I' when n.o_orderstatus is distinct from o.o_orderstatus
  or n.o_orderpriority is distinct from o.o_orderpriority then 'U' else 'N' end as change,
  case when o.o_orderkey is null then '' else concat_ws(',', case when n.o_orderstatus is distinct from o.o_orderstatus then 'o_orderstatus' end,
  case when n.o_orderpriority is distinct from o.o_orderpriority then 'o_orderpriority' end) end as changed
from new n left join old o using (o_orderkey)""",
)
def upsert_diff(spark: SparkSession, d: str) -> DataFrame:
    """What an upsert would insert, change, or leave alone."""
    orders = table(spark, d, "orders")
    new = orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    found = relational.upsert_diff(orders.where("o_orderkey % 7 <> 0"), new, "o_orderkey", ["o_orderstatus", "o_orderpriority"])
    return found.withColumn("changed", F.array_join("changed", ","))


@query(
    "junction_replace",
    """
with fresh as (select l_orderkey, l_partkey + 1 as l_partkey from lineitem where l_orderkey % 3 = 0)
select l_orderkey, l_partkey from lineitem where l_orderkey not in (select l_orderkey from fresh) union all select * from fresh""",
)
def junction_replace(spark: SparkSession, d: str) -> DataFrame:
    """A bridge table after the rows of some owners are replaced."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    fresh = rows.where("l_orderkey % 3 = 0").withColumn("l_partkey", F.col("l_partkey") + 1)
    return relational.replace_owned(rows, fresh, "l_orderkey")


@query(
    "guarded_rename",
    """
with t as (select s_suppkey, s_name, case when s_suppkey % 4 = 0 then 'Supplier of ' || s_nationkey when s_suppkey % 4 = 1 then s_name || ' Ltd' end as target from supplier),
a as (select *, coalesce(nullif(trim(target), ''), s_name) as after from t),
claims as (select s_name as n, s_suppkey from a union all select after, s_suppkey from a),
taken as (select n from claims group by n having count(distinct s_suppkey) > 1)
select s_suppkey, case when after in (select n from taken) then s_name else after end as s_name,
  after not in (select n from taken) and after <> s_name as renamed from a""",
)
def guarded_rename(spark: SparkSession, d: str) -> DataFrame:
    """Renames that no other name contests, before or after."""
    k = F.col("s_suppkey") % 4
    target = F.when(k == 0, F.concat(F.lit("Supplier of "), F.col("s_nationkey").cast("string"))).when(k == 1, F.concat("s_name", F.lit(" Ltd")))
    return relational.guarded_rename(table(spark, d, "supplier").select("s_suppkey", "s_name", target.alias("target")), "s_suppkey", "s_name", "target").drop("target")


@query(
    "field_update",
    """
select p_partkey, case when p_partkey % 2 = 0 and nullif(trim(x), '') is not null and (p_partkey % 4 = 0 or b is null) then x else b end as brand from
(select p_partkey, case when p_partkey % 3 = 0 then null else p_brand end as b, case when p_partkey % 8 = 0 then ' ' else upper(p_type) end as x from part)""",
)
def field_update(spark: SparkSession, d: str) -> DataFrame:
    """New values where they're wanted and filled, old ones elsewhere."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k, F.when(k % 3 != 0, F.col("p_brand")).alias("brand"), F.when(k % 8 == 0, " ").otherwise(F.upper("p_type")).alias("_x"))
    return rows.withColumns(relational.field_update({"brand": "_x"}, k % 2 == 0, k % 4 == 0)).drop("_x")


@query(
    "needs_detection",
    """
select doc_id, concat_ws(',', case when length(text) < 200 then 'body' end, case when lang <> 'en' then 'translation' end,
  case when not contains(text, chr(10)) then 'lines' end) as needs from documents where length(text) < 200 or lang <> 'en' or not contains(text, chr(10))""",
)
def needs_detection(spark: SparkSession, d: str) -> DataFrame:
    """Documents that lack something, and what."""
    conditions = {"body": F.length("text") < 200, "translation": F.col("lang") != "en", "lines": ~F.contains("text", F.lit("\n"))}
    rows = table(spark, d, "documents").select("doc_id", relational.needs(conditions).alias("needs"))
    return rows.where(F.size("needs") > 0).select("doc_id", F.array_join("needs", ",").alias("needs"))


@query(
    "processing_status",
    """
select source, count(*) as n, count_if(length(text) >= 1000) as long_texts, count_if(lang = 'en') as english, max(doc_id) as newest,
  count(distinct lang) as languages from documents group by source having count(*) > 1""",
)
def processing_status(spark: SparkSession, d: str) -> DataFrame:
    """Several counts of each source in one pass; sources of one row are left out."""
    rows = table(spark, d, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.length("text") >= 1000).alias("long_texts"),
        F.count_if(F.col("lang") == "en").alias("english"),
        F.max("doc_id").alias("newest"),
        F.count_distinct("lang").alias("languages"),
    )
    return rows.where("n > 1")


@query(
    "keyset_page",
    "select o_orderkey, cast(cast(o_orderdate as date) as varchar) as day from orders where o_orderdate < timestamp '2000-01-01' order by o_orderdate desc, o_orderkey limit 100",
)
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """The hundred newest rows before a cursor."""
    rows = relational.keyset_page(_orders(spark, d), "o_orderdate", F.lit("2000-01-01").cast("timestamp"), "o_orderkey", 100)
    return rows.select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))


@query(
    "alias_match",
    """
with r as (select p_partkey, p_name, [p_brand, p_type] as aliases from part)
select s.n_name, count(*) as n from (select n_name from nation union all select p_brand from part group by 1) s
join (select distinct p_partkey, unnest(list_append(aliases, p_name)) as k from r) on k = s.n_name group by 1""",
)
def alias_match(spark: SparkSession, d: str) -> DataFrame:
    """Rows that have a name as their own or as an alias."""
    part = table(spark, d, "part")
    names = table(spark, d, "nation").select("n_name").unionByName(part.select(F.col("p_brand").alias("n_name")).distinct())
    rows = part.select("p_partkey", "p_name", F.array("p_brand", "p_type").alias("aliases"))
    return relational.equal_or_alias(names, rows, "n_name", "p_name", "aliases").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "word_prefixes",
    """
with k as (select distinct p_name || ' ' || p_type as long from part union select distinct p_name from part)
select a.long as short, b.long from k a join k b on starts_with(b.long, a.long || ' ') where len(string_split(a.long, ' ')) >= 2""",
)
def word_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Names that begin with all words of another."""
    part = table(spark, d, "part")
    names = part.select(F.concat_ws(" ", "p_name", "p_type").alias("long")).unionByName(part.select(F.col("p_name").alias("long")))
    return relational.word_prefix_pairs(names, "long")


@query(
    "accent_canonical",
    """
with v as (select c_mktsegment, case when c_custkey % 3 = 0 then 'Montréal' when c_custkey % 3 = 1 then 'Montreal' else 'Trois-Rivières' end as city from customer)
select c_mktsegment, lower(strip_accents(city)) as folded, count(distinct city) as variants,
  arg_min(city, (length(city) - length(regexp_replace(city, '[^\\x00-\\x7F]', '', 'g')))::varchar || city) as preferred from v group by 1, 2""",
)
def accent_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The preferred spelling of each place."""
    k = F.col("c_custkey") % 3
    city = F.when(k == 0, "Montréal").when(k == 1, "Montreal").otherwise("Trois-Rivières")
    return curation.accent_canonical(table(spark, d, "customer").select("c_mktsegment", city.alias("city")), "c_mktsegment", "city")


@query(
    "crosswalk_match",
    """
with terms as (select r_name as term, r_regionkey as code from region union all select n_name, n_regionkey from nation union all select n_name, n_nationkey from nation where n_nationkey < 5),
known as (select lower(trim(term)) as t, count(distinct code) as n, min(code) as c from terms group by 1)
select c_custkey, case when n = 1 then c end as code, case when n = 1 then 'exact' when n > 1 then 'ambiguous' else 'none' end as how
from customer left join nation on c_nationkey = n_nationkey left join known on lower(trim(case when c_custkey % 9 = 0 then 'nowhere' else n_name end)) = t""",
)
def crosswalk_match(spark: SparkSession, d: str) -> DataFrame:
    """Codes for terms, where they have just one."""
    nation = table(spark, d, "nation")
    terms = (
        table(spark, d, "region").select(F.col("r_name").alias("term"), F.col("r_regionkey").alias("code"))
        .unionByName(nation.select(F.col("n_name").alias("term"), F.col("n_regionkey").alias("code")))
        .unionByName(nation.where("n_nationkey < 5").select(F.col("n_name").alias("term"), F.col("n_nationkey").alias("code")))
    )
    rows = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = rows.select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, "nowhere").otherwise(F.col("n_name")).alias("place"))
    return curation.crosswalk(rows, terms, "place", "term", "code").drop("place")


@query(
    "similar_titles",
    """
with t as (select distinct p_brand, p_name || ' ' || p_type as t from part),
v as (select p_brand, t, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''))) as w from t),
w as (select p_brand, min(t) as t, w from v group by 1, 3)
select a.p_brand, a.t as a, b.t as b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) as similarity
from w a join w b on a.p_brand = b.p_brand and a.t < b.t where len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.5""",
)
def similar_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of one brand with half of their words in common or more, as pairs of which each stands for all titles of its words."""
    rows = table(spark, d, "part").select("p_brand", F.concat_ws(" ", "p_name", "p_type").alias("title"))
    return curation.similar_titles(rows, "p_brand", "title", 0.5).withColumn("similarity", F.round("similarity", 6))


@query(
    "cluster_survivor",
    """
with c as (select c_custkey, min(c_custkey) over (partition by c_nationkey, c_mktsegment, floor(c_acctbal / 500)) as g, c_acctbal from customer)
select c_custkey, arg_min(c_custkey, -c_acctbal) over (partition by g) as survivor from c""",
)
def cluster_survivor(spark: SparkSession, d: str) -> DataFrame:
    """The member of each cluster with the largest balance; clusters are components of a chain of links."""
    rows = table(spark, d, "customer").withColumn("band", F.floor(F.col("c_acctbal") / 500))
    first = rows.groupBy("c_nationkey", "c_mktsegment", "band").agg(F.min("c_custkey").alias("root"))
    edges = rows.join(first, ["c_nationkey", "c_mktsegment", "band"]).select(F.col("c_custkey").alias("a"), F.col("root").alias("b"))
    return curation.survivors(rows.select("c_custkey", "c_acctbal"), edges, "c_custkey", [-F.col("c_acctbal")])


@query(
    "merge_entities",
    "select case when o_custkey % 10 = 3 then o_custkey - 3 else o_custkey end as o_custkey, count(*) as n from orders group by 1",
)
def merge_entities(spark: SparkSession, d: str) -> DataFrame:
    """Postings of each organisation after some were merged into others."""
    merged = table(spark, d, "customer").where("c_custkey % 10 = 3").select("c_custkey", (F.col("c_custkey") - 3).alias("survivor"))
    moved = curation.absorb(table(spark, d, "orders").select("o_custkey"), merged, "o_custkey", "c_custkey")
    return moved.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "tri_state_rules",
    """
select d.doc_id, case when l.quality is null then null when l.quality = 1 then length(d.text) > 300 else false end as eligible,
  case when l.quality = 0 then 'EXCLUDED' else 'GOV_' || (d.doc_id % 5 + 1) end as category,
  case when d.doc_id % 4 >= 3 then null when d.doc_id % 4 > 0 then 'partial_fill' else 'no_new_fields' end as reason
from documents d left join labels l using (doc_id)""",
)
def tri_state_rules(spark: SparkSession, d: str) -> DataFrame:
    """Eligibility that waits for its parent's, categories of subtypes, and reasons to skip."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("of"), "quality")
    rows = relational.star(table(spark, d, "documents"), [(labels, "doc_id", "of")])
    subtype = F.when(F.col("quality") == 0, "EXCLUDED").otherwise(F.concat_ws("_", F.lit("SUB"), (F.col("doc_id") % 5 + 1).cast("string"), F.lit("a")))
    return rows.select(
        "doc_id",
        R.eligible(F.length("text") > 300, F.col("quality") == 1).alias("eligible"),
        R.category_of(subtype).alias("category"),
        R.skip_reason(F.lit(3), F.col("doc_id") % 4).alias("reason"),
    )


# What a text says of the kind of work, in the order in which it is looked for.
KINDS = [("urgent", "full_time"), ("high", "full_time"), ("medium", "part_time"), ("low", "casual")]


@query(
    "employment_types",
    """
select case when contains(lower(o_orderpriority), 'urgent') or contains(lower(o_orderpriority), 'high') then 'full_time'
  when contains(lower(o_orderpriority), 'medium') then 'part_time' when contains(lower(o_orderpriority), 'low') then 'casual' end as kind, count(*) as n from orders group by 1""",
)
def employment_types(spark: SparkSession, d: str) -> DataFrame:
    """Postings of each kind of work, by the first word that says one."""
    return table(spark, d, "orders").groupBy(T.first_mapped(F.col("o_orderpriority"), KINDS).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
