"""Queries of organisations: identities of URLs, clusters of names, candidates; customers stand for organisations, with names made by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import entities as E
from brindle.plans.registry import query
from brindle.sources.tables import spread, table

# Made by rule: four organisations of each number g, whose names, places and sites agree or not by g.
_ORGS_SQL = """
with raw as (select c_custkey as id, c_custkey // 4 as g, c_custkey % 4 as r, c_custkey % 7 as jobs, c_nationkey from customer),
orgs as (select *, case r when 0 then 'Grove and Sons ' || g when 1 then 'Grove & Sons ' || g when 2 then 'Grove and Sons ' || g || ' Laval'
    else case when g % 3 = 0 then 'Oak ' || g when g % 3 = 1 then 'GROVE and  sons-' || g else 'gv' || (g % 40) end end as name,
  case when r = 2 or g % 2 = 0 then 'Laval' when g % 5 = 1 then null else 'Ottawa' end as city, 'QC' as province, case when g % 4 = 1 then null when r = 2 or g % 2 = 0 then 'Laval, QC' else 'Ottawa ON' end as location,
  case g % 5 when 0 then case when r = 1 then null else 'https://www.grove' || g || '.org' end when 1 then case when r = 0 then 'http://careers.grove' || g || '.org/x' else 'grove' || g || '.org' end
    when 2 then 'https://grove' || (g + r) || '.gc.ca/' when 3 then 'https://facebook.com/grove' || g when 4 then 'https://grove' || g || '.co.uk' end as website from raw)
"""


def _orgs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    g, r = F.floor(k / 4), k % 4
    n = g.cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    short = F.when(g % 3 == 0, say("Oak ", n)).when(g % 3 == 1, say("GROVE and  sons-", n)).otherwise(say("gv", (g % 40).cast("string")))
    name = F.when(r == 0, say("Grove and Sons ", n)).when(r == 1, say("Grove & Sons ", n)).when(r == 2, say("Grove and Sons ", n, " Laval")).otherwise(short)
    laval = (r == 2) | (g % 2 == 0)
    site = (
        F.when(g % 5 == 0, F.when(r != 1, say("https://www.grove", n, ".org"))).when(g % 5 == 1, F.when(r == 0, say("http://careers.grove", n, ".org/x")).otherwise(say("grove", n, ".org")))
        .when(g % 5 == 2, say("https://grove", (g + r).cast("string"), ".gc.ca/")).when(g % 5 == 3, say("https://facebook.com/grove", n)).otherwise(say("https://grove", n, ".co.uk"))
    )
    return spread(table(spark, d, "customer")).select(
        k.alias("id"), name.alias("name"), F.when(laval, "Laval").when(g % 5 == 1, None).otherwise("Ottawa").alias("city"), F.lit("QC").alias("province"),
        F.when(g % 4 == 1, None).when(laval, "Laval, QC").otherwise("Ottawa ON").alias("location"), site.alias("website"), (k % 7).alias("jobs"), g.alias("g"), r.alias("r"),
    )


_KEYS_SQL = (
    _ORGS_SQL
    + r""", keyed as (select *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) as key,
  nullif(regexp_replace(regexp_extract(lower(website), '^(?:[a-z]+://)?([^/]+)', 1), '^www\.', ''), '') as host from orgs),
sited as (select *, array_to_string(list_filter(string_split(key, ' '), lambda w: w not in ('and', 'et')), ' ') as loose,
  case when host <> 'facebook.com' then host end as site,
  case when host <> 'facebook.com' then case when regexp_matches(host, '\.(co\.uk|gc\.ca)$') then regexp_extract(host, '[^.]+\.[^.]+\.[^.]+$') else regexp_extract(host, '[^.]+\.[^.]+$') end end as apex,
  string_split(trim(regexp_replace(lower(concat_ws(' ', city, province, location)), '[^a-z0-9]+', ' ', 'g')), ' ') as words,
  coalesce(lower(city), '') as c, coalesce(trim(regexp_replace(lower(location), '[^a-z0-9]+', ' ', 'g')), '') as loc from keyed),
reps as (select * from sited s where id = (select min(id) from sited t where t.key = s.key)),
edges as (
  select s.id as a, r.id as b from sited s join reps r using (key) where s.id <> r.id
  union select l.id, s.id from reps s join reps l on starts_with(l.key, s.key || ' ') where len(string_split(s.key, ' ')) >= 2
    and len(list_filter(string_split(substr(l.key, length(s.key) + 2), ' '), lambda w: not list_contains(l.words, w))) = 0
    and case when s.c <> '' and l.c <> '' then s.c = l.c when s.c <> '' then l.loc = '' or contains(l.loc, s.c) when l.c <> '' then s.loc = '' or contains(s.loc, l.c)
      else s.loc = '' or l.loc = '' or len(list_intersect(string_split(s.loc, ' '), string_split(l.loc, ' '))) > 0 end
  union select s.id, m.b from sited s join (select loose, min(id) as b from sited group by 1 having count(distinct key) > 1 and count(distinct apex) <= 1) m using (loose) where s.id <> m.b)
"""
)


@query("organization_edges", _KEYS_SQL + "select distinct a, b from edges")
def organization_edges(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of organisations whose names, places and sites say that they may be one."""
    return E.organization_edges(_orgs(spark, d)).select("a", "b")


@query(
    "organization_clusters",
    _KEYS_SQL.replace("with raw", "with recursive raw")
    + """, ends as (select a, b from edges union select b, a from edges), reach as (select a as id, a as root from ends union select e.b, r.root from reach r join ends e on e.a = r.id),
parts as (select id, min(root) as cluster from reach group by 1), told as (
  select cluster, arg_min(key, len(string_split(key, ' '))::varchar || ' ' || key) as label, count(*) as n, first(id order by site is null, jobs desc, id) as survivor, count(distinct apex) as apexes,
    count(distinct key) as keys, count_if(site is null) as missing, count_if(coalesce(trim(website), '') <> '') > 0 as filled from sited join parts using (id) group by 1),
why as (select *, case when apexes > 1 then 'conflicting sites' when filled and missing = n then 'shared sites' when keys > 1 then 'near names' when length(replace(label, ' ', '')) <= 4 then 'short name'
  when missing > 0 then 'missing sites' else 'same site' end as why from told)
select cluster, label, n, survivor, case why when 'conflicting sites' then 'skip' when 'same site' then 'merge' else 'review' end as bucket, why from why""",
)
def organization_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of organisations, who stays of each, and whether that can be done, should be looked at, or not."""
    return E.organization_clusters(_orgs(spark, d))


@query(
    "site_conflicts",
    _KEYS_SQL
    + "select site, count(*) as n, min(id) as first, max(id) as last, count(distinct nullif(c, '')) > 1 as cities_differ from sited where site is not null and site <> 'grove4.co.uk' group by 1 having count(*) > 1",
)
def site_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Sites of several organisations, and whether these are of several cities."""
    return E.site_conflicts(_orgs(spark, d), ["grove4.co.uk"])


_URLS = [
    ("https://{n}.example.org/a?b", "example.org", "employer_owned", "unknown"), ("HTTPS://www.Facebook.com/Org{n}/", "facebook.com/org{n}", "social_media", "facebook.com"),
    ("shop{n}.wixsite.com", "shop{n}.wixsite.com", "marketplace", "wixsite.com"), ("https://boards.greenhouse.io//acme{n}/jobs?x#y", "boards.greenhouse.io/acme{n}/jobs", "ats_board", "greenhouse.io"),
    ("https://m.env{n}.gc.ca/x", "env{n}.gc.ca", "employer_owned", "unknown"), ("http://linkedin.com/", None, "unknown", "unknown"), ("https://a.b{n}.co.uk:8080", "b{n}.co.uk", "employer_owned", "unknown"),
    ("jobs.eco.ca/p/{n}", "jobs.eco.ca/p/{n}", "shared_hosting", "eco.ca"), ("localhost", None, "unknown", "unknown"),
]


def _rule(column: int) -> str:
    value = lambda v: "null" if v is None else "replace('" + v + "', '{n}', page_id::varchar)"
    return "case page_id % 10 " + " ".join(f"when {i} then {value(u[column])}" for i, u in enumerate(_URLS)) + " end"


@query(
    "site_identities",
    f"""
select page_id, {_rule(1)} as identity, coalesce({_rule(2)}, 'unknown') as kind, coalesce({_rule(3)}, 'unknown') as platform,
  regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^(www\\.)?(m\\.)?', '') as host from pages""",
)
def site_identities(spark: SparkSession, d: str) -> DataFrame:
    """What in URLs of many forms is one organisation's own, its kind and platform; and the hosts of the pages."""
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 10
    made = F.coalesce(*[F.when(k == i, F.replace(F.lit(u[0]), F.lit("{n}"), n)) for i, u in enumerate(_URLS)])
    rows = table(spark, d, "pages").select("page_id", E.identity(made).alias("identity"), E.host(F.col("url")).alias("host"))
    return rows.select("page_id", "identity", E.identity_kind(F.col("identity")).alias("kind"), E.platform(F.coalesce("identity", F.lit("none"))).alias("platform"), "host")


@query(
    "organization_candidates",
    _KEYS_SQL
    + """, known as (select id as org, [key] || case when r = 1 then ['grove trust ' || g] else [] end as keys, case when host = 'facebook.com' then 'facebook.com/grove' || g else apex end as own, string_split(loc, ' ') as place from sited where r < 2),
posts as (select id, case when r = 2 then 'grove trust ' || g else key end as key, case when r = 0 then null when host = 'facebook.com' then 'facebook.com/grove' || g else apex end as site, c as city from sited),
pairs as (select p.*, k.*, list_contains(k.keys, p.key) as named from posts p join known k on list_contains(k.keys, p.key) or p.site = k.own),
scored as (select *, case when named then 50 else 0 end + case when named and site is not null and own is not null then case when site = own then 100 else -100 end else 0 end
  + case when list_contains(place, 'qc') then 10 else 0 end + case when city <> '' and list_contains(place, city) then 5 else 0 end as score, named and not coalesce(site <> own, false) as open from pairs),
best as (select id, first(org order by score desc, org) as org, max(score) as score, bool_or(open) as open from scored group by 1)
select id, org, score, case when score >= 100 then 'merge' when coalesce(open, false) then 'block' else 'create' end as decision from posts left join best using (id)""",
)
def organization_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Which organisation each posting is of, whether a new one may be made, or neither can be told."""
    orgs = _orgs(spark, d)
    g = F.col("g").cast("string")
    known = orgs.where("r < 2").select(F.col("id").alias("org"), "name", F.when(F.col("r") == 1, F.array(F.concat(F.lit("Grove-Trust "), g))).alias("aliases"), "website", "location")
    posts = orgs.select("id", F.when(F.col("r") == 2, F.concat(F.lit("Grove trust "), g)).otherwise(F.col("name")).alias("name"), F.when(F.col("r") > 0, F.col("website")).alias("website"), "province", "city")
    return E.resolve(posts, known)


@query(
    "alias_unions",
    """
select p_partkey, array_to_string(list_filter([p_brand, p_type, case when p_partkey % 3 = 0 then 'Ärger ' || p_brand else p_brand || '!' end], lambda x, i: i < 3 or p_partkey % 3 = 0), '|') as aliases,
  case when p_partkey % 3 = 0 then 3 else 2 end as keys from part""",
)
def alias_unions(spark: SparkSession, d: str) -> DataFrame:
    """Aliases of two rows that become one, without the name itself and repeats of any spelling."""
    k = F.col("p_partkey")
    more = F.array("p_type", F.when(k % 3 == 0, F.concat(F.lit("Ärger "), "p_brand")).otherwise(F.concat("p_brand", F.lit("!"))), F.lower("p_name"), F.lit(" "))
    found = E.alias_union(F.upper("p_name"), F.array("p_brand"), more)
    keys = E.normal_names(F.array(F.col("p_brand"), F.col("p_type"), F.get(more, F.lit(1)), F.lit(None).cast("string")))
    return table(spark, d, "part").select("p_partkey", F.array_join(found, "|").alias("aliases"), F.size(keys).alias("keys"))
