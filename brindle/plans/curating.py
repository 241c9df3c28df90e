"""Queries of names, search and near-duplicate postings; documents stand for postings, their sources for employers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import names as N
from brindle.functions import numbers, places
from brindle.functions import text as T
from brindle.operators import incremental, loading, matching, postings, search
from brindle.plans.registry import query
from brindle.sources import feeds
from brindle.sources.tables import spread, table


def _postings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return spread(table(spark, d, "documents")).select(
        k.alias("id"), F.col("source").alias("org"), F.substring_index("text", " ", 3).alias("title"), F.concat(F.lit("https://x.org/job/"), k).alias("url"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 90).cast("int")).cast("string").alias("posted"), F.col("text").alias("body"), F.when(k % 5 > 0, F.col("lang")).alias("city"),
        F.lit("ON").alias("province"), F.lit(None).cast("string").alias("kind"), (k % 3).cast("string").alias("source"),
    )


@query("posting_clusters")
def posting_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Groups of near-duplicate postings; sequence ratios have no SQL, so tests hold them against brute force."""
    return postings.clusters(_postings(spark, d))


@query("confident_duplicates")
def confident_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Postings of which there surely is an earlier copy."""
    rows = _postings(spark, d)
    return postings.confident_duplicates(rows, rows, earlier=True)


@query(
    "organization_keys",
    """
select c_custkey, 'the cafe' || lower(replace(c_name, '#', '')) || ' and sons' as key, 'the cafe' || lower(replace(c_name, '#', '')) || ' sons' as loose,
  'The Café' || c_name || ' & Sons' || case when c_custkey % 4 = 2 then ' (TCS)' else '' end as display from customer""",
)
def organization_keys(spark: SparkSession, d: str) -> DataFrame:
    """Names without what job boards add to them, and the keys that make spellings equal."""
    k = F.col("c_custkey") % 4
    noise = F.when(k == 0, " | Apply now (2 positions)").when(k == 1, " – 3 postes / About us").when(k == 2, " (TCS)").otherwise(" - Jobs  ")
    name = F.concat(F.lit("The Café"), "c_name", F.lit(" & Sons"), noise)
    return table(spark, d, "customer").select("c_custkey", N.organization_key(name).alias("key"), N.loose_key(name).alias("loose"), N.display_name(name).alias("display"))


@query(
    "unique_slugs",
    """
with s as (select c_custkey, lower(c_mktsegment) as slug, row_number() over (partition by lower(c_mktsegment) order by c_custkey) as n from customer)
select c_custkey, case when n = 1 then slug when n <= 10 then slug || '-' || n else slug || '-' || substr(sha256(c_custkey::varchar), 1, 8) end as slug from s""",
)
def unique_slugs(spark: SparkSession, d: str) -> DataFrame:
    """A slug of its own for every row, most of which share their names."""
    return N.unique_slugs(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment").select("c_custkey", "slug")


_GRAMS = "list_transform(range(1, length({w}) + 2), lambda i: substr('  ' || {w} || ' ', i, 3))"


@query(
    "word_similarity",
    f"""
with n as (select distinct p_name, string_split(p_name, ' ') as w from part), b as (select p_name, flatten(list_transform(w, lambda x: {_GRAMS.format(w="x")})) as b, {_GRAMS.format(w="'stel'")} as a from n),
e as (select p_name, a, unnest(flatten(list_transform(range(1, len(b) + 1), lambda i: list_transform(range(i, len(b) + 1), lambda j: list_distinct(b[i:j]))))) as e from b)
select p_name, round(max(len(list_intersect(a, e)) / (len(a) + len(e) - len(list_intersect(a, e)))), 6) as similarity from e group by 1""",
)
def word_similarity(spark: SparkSession, d: str) -> DataFrame:
    """How well a word fits some stretch of each distinct name."""
    return table(spark, d, "part").select("p_name").distinct().select("p_name", F.round(search.word_similarity(F.lit("stel"), F.col("p_name")), 6).alias("similarity"))


@query(
    "label_search",
    f"""
with g as (select p_partkey, string_split(lower(p_name), ' ') || string_split(lower(p_type), ' ') as w, {_GRAMS.format(w="'blue'")} as q,
  list_distinct(flatten(list_transform(string_split(lower(p_name), ' '), lambda x: {_GRAMS.format(w="x")}))) as a, list_distinct(flatten(list_transform(string_split(lower(p_type), ' '), lambda x: {_GRAMS.format(w="x")}))) as b from part),
s as (select p_partkey, len(list_intersect(a, q)) / len(list_distinct(list_concat(a, q))) as s, len(list_intersect(b, q)) / len(list_distinct(list_concat(b, q))) as t from g)
select p_partkey, round(greatest(s, t), 6) as score from s where greatest(s, t) >= 0.3 order by greatest(s, t) desc, p_partkey limit 20""",
)
def label_search(spark: SparkSession, d: str) -> DataFrame:
    """The 20 labels that resemble a word most, by their names or aliases."""
    rows = table(spark, d, "part").withColumn("aliases", F.array("p_type"))
    return search.label_search(rows, "p_partkey", F.col("p_name"), F.col("aliases"), "Blüe ", 20).select("p_partkey", F.round("score", 6).alias("score"))


_LEX = f"""list_transform(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: not list_contains({search.STOPS['en']!r}, w)),
  lambda w: regexp_replace(regexp_replace(w, '{search.SUFFIXES['en'][0]}', '\\1'), '{search.SUFFIXES['en'][1]}', '\\1'))"""


@query(
    "full_text",
    f"""
with t as (select doc_id, {_LEX} as w from documents), j as (select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as j from t)
select doc_id, len(list_filter(w, lambda x: starts_with(x, 'wat'))) > 0 as prefix,
  (list_contains(w, 'water') and not list_contains(w, 'citi') and not list_contains(w, 'cit')) or contains(j, ' public librar ') as web from j""",
)
def full_text(spark: SparkSession, d: str) -> DataFrame:
    """Which whole texts a single word's prefix and a web-style search find."""
    lexed = spread(table(spark, d, "documents")).select("doc_id", search.lexemes(F.col("text")).alias("w"))
    return lexed.select("doc_id", search.matches(F.col("w"), "wat").alias("prefix"), search.matches(F.col("w"), 'waters -cities or "public libraries"').alias("web"))


@query("save_status")
def save_status(spark: SparkSession, d: str) -> DataFrame:
    """What a batch of postings does to a stored table; near-duplicates have no SQL, so tests hold it against given rows."""
    rows = _postings(spark, d)
    return loading.save_status(rows, rows.where("id % 4 = 0"), refused=F.col("city") == "es", override=True)


@query(
    "bulk_update",
    "select e.event_id, case when e.event_id % 3 = 0 then e.event_id * 2.0 else e.value end as value, case when e.event_id % 3 = 0 then 'new' else e.event_type end as event_type from events e",
)
def bulk_update(spark: SparkSession, d: str) -> DataFrame:
    """Values put in by key from JSON arrays."""
    events = table(spark, d, "events").select("event_id", "value", "event_type")
    k = F.col("event_id")
    payload = F.to_json(F.array(F.struct(k, (k * 2.0).alias("value"), F.lit("new").alias("event_type"))))
    return loading.bulk_update(events, events.where(k % 3 == 0).select(payload.alias("p")), "p", "event_id", "value:double,event_type:string")


@query(
    "checked_rows",
    """
select o_orderkey, case when o_totalprice < 1000 then 'small' else '' end || case when o_orderstatus = 'P' then 'open' else '' end as broken from orders""",
)
def checked_rows(spark: SparkSession, d: str) -> DataFrame:
    """Which checks each row breaks."""
    checks = {"small": F.col("o_totalprice") >= 1000, "open": F.col("o_orderstatus") != "P"}
    return loading.checked(table(spark, d, "orders"), checks).select("o_orderkey", F.array_join("broken", "").alias("broken"))


@query(
    "clear_audit",
    """
select count(*) filter (where c_acctbal < 0) as audited, count(*) filter (where c_acctbal >= 0 and c_mktsegment is not null) as filled from customer""",
)
def clear_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose values were cleared and recorded, and those that keep theirs."""
    cleared, audit = loading.clear_with_audit(table(spark, d, "customer"), "c_custkey", F.col("c_acctbal") < 0, ["c_mktsegment"], "negative")
    return audit.agg(F.count(F.lit(1)).alias("audited")).crossJoin(cleared.agg(F.count("c_mktsegment").alias("filled")))  # one row each


@query(
    "bilingual_index",
    """
with en as (select p_name as k, min(p_type) as label, list_sort(list_distinct(list(p_brand))) as al from part where p_partkey % 3 > 0 group by 1),
fr as (select p_name as k, min(p_brand) as label, list_sort(list_distinct(list(p_brand))) as al from part where p_partkey % 3 < 2 group by 1)
select coalesce(en.k, fr.k) as p_name, en.label as label_en, fr.label as label_fr, coalesce(en.label, fr.label) as term, coalesce(len(en.al), 0)::int as n_en,
  coalesce(len(list_filter(fr.al, lambda a: a <> fr.label)), 0)::int as n_fr from en full join fr using (k)""",
)
def bilingual_index(spark: SparkSession, d: str) -> DataFrame:
    """Labels and aliases of two languages by key."""
    part = table(spark, d, "part")
    en = part.where("p_partkey % 3 > 0").select("p_name", F.col("p_type").alias("label"), F.array("p_brand").alias("al"))
    fr = part.where("p_partkey % 3 < 2").select("p_name", F.col("p_brand").alias("label"), F.array("p_brand").alias("al"))
    found = feeds.bilingual_index(en, fr, "p_name", "label", "al")
    return found.select("p_name", "label_en", "label_fr", "term", F.size("aliases_en").alias("n_en"), F.size("aliases_fr").alias("n_fr"))


@query(
    "source_resolution",
    """
select c_custkey, case when c_custkey % 4 = 3 then null else c_nationkey end as source_id from customer""",
)
def source_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Sources found by slug, id or name."""
    registry = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("nation-"), "n_nationkey").alias("slug"), F.concat(F.lit("Nâtion "), "n_nationkey").alias("name"))
    k, n = F.col("c_custkey") % 4, F.col("c_nationkey").cast("string")
    wanted = F.when(k == 0, F.concat(F.lit("nation-"), n)).when(k == 1, n).when(k == 2, F.concat(F.lit(" NATION "), n)).otherwise("nowhere")
    return feeds.resolve_sources(table(spark, d, "customer").select("c_custkey", wanted.alias("w")), registry, "w").select("c_custkey", "source_id")


@query(
    "work_types",
    """
select c_custkey, case c_custkey % 5 when 0 then 'hybrid' when 1 then 'remote' when 2 then 'hybrid' else 'office' end as work_type, c_custkey % 5 = 3 as us_only,
  'Calgary' || c_nationkey as place from customer""",
)
def work_types(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of work and places that texts of several forms say."""
    k = F.col("c_custkey") % 5
    text = F.when(k == 0, "Hybrid, 2 days in office").when(k == 1, "Remote, anywhere in Canada").when(k == 2, "Remote - Laval").when(k == 3, "Boston, MA").otherwise("Remoteness, Canada or USA")
    glued = F.concat(F.lit("CalgaryCalgaryCalgary "), "c_nationkey")
    return table(spark, d, "customer").select(
        "c_custkey", places.work_type(text, F.when(k == 2, "Laval")).alias("work_type"), places.us_only(text).alias("us_only"), F.replace(places.unglued(glued), F.lit(" "), F.lit("")).alias("place")
    )


@query("french_dates", "select distinct cast(cast(o_orderdate as date) as varchar) as d, cast(cast(o_orderdate as date) as varchar) as parsed from orders")
def french_dates(spark: SparkSession, d: str) -> DataFrame:
    """Days read back from French texts."""
    day = F.to_date("o_orderdate")
    months = F.array(*map(F.lit, "janv. févr. mars avril mai juin juillet août sept. oct. novembre déc.".split()))
    n = F.when(F.dayofmonth(day) == 1, "1er").otherwise(F.dayofmonth(day).cast("string"))
    text = F.concat_ws(" ", n, F.element_at(months, F.month(day)), F.year(day).cast("string"))
    return table(spark, d, "orders").select(day.cast("string").alias("d"), numbers.french_day(text).cast("string").alias("parsed")).distinct()


@query(
    "labeled_values",
    "select o_orderkey, o_orderpriority as priority, array_to_string(list_transform(string_split(lower(o_orderpriority), '-'), lambda x: regexp_replace(trim(x), '[^a-z0-9]+', '_', 'g'))[1:2], ' ') as tags from orders",
)
def labeled_values(spark: SparkSession, d: str) -> DataFrame:
    """Values after labels in a line of several, and tags in one form."""
    line = F.concat(F.lit("Clerk: x Priority :  "), "o_orderpriority", F.lit("  Status: "), "o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", T.labeled(line, ["priority"], ["clerk", "status"]).alias("priority"), F.array_join(T.tags(F.split("o_orderpriority", "-"), 48, 2), " ").alias("tags"))


@query(
    "greedy_batches",
    """
with recursive d as (select doc_id, source, floor(length(coalesce(text, '')) / 4)::double as tokens, row_number() over (partition by source order by doc_id) as n from documents),
f as (select doc_id, source, tokens, n, tokens as total, 1::bigint as batch from d where n = 1
  union all select d.doc_id, d.source, d.tokens, d.n, case when f.total + d.tokens > 4000 then d.tokens else f.total + d.tokens end, case when f.total + d.tokens > 4000 then f.batch + 1 else f.batch end
  from f join d on d.source = f.source and d.n = f.n + 1)
select doc_id, source, batch from f""",
)
def greedy_batches(spark: SparkSession, d: str) -> DataFrame:
    """Documents in their order by source, in batches of 4,000 estimated tokens."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.floor(F.coalesce(F.length("text"), F.lit(0)) / 4).alias("tokens"))
    return incremental.greedy_batches(rows, "source", "doc_id", "tokens", 4000).select("doc_id", "source", "batch")


@query(
    "skill_shortlist",
    """
with s as (select l_orderkey, l_partkey, l_discount * 10 as sim, l_tax * 12.5 as rel, l_quantity as prom from lineitem),
b as (select l_orderkey, l_partkey, max(sim * (least(greatest(prom, 1), 10) / 10) * rel) as score from s where sim >= 0.25 and rel >= 0.4 group by 1, 2),
r as (select *, row_number() over (partition by l_orderkey order by score desc, l_partkey) as n from b) select l_orderkey, l_partkey, round(score, 6) as score from r where n <= 3""",
)
def skill_shortlist(spark: SparkSession, d: str) -> DataFrame:
    """The three best skills of each owner by likeness, prominence and relevance."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_discount") * 10).alias("sim"), (F.col("l_tax") * 12.5).alias("rel"), F.col("l_quantity").alias("prom"))
    found = matching.shortlist(rows, "l_orderkey", "l_partkey", F.col("sim"), F.col("prom"), F.col("rel"), 3)
    return found.withColumn("score", F.round("score", 6))
