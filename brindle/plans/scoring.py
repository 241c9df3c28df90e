"""Scores, vectors, text measures and incremental queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import numbers as N
from brindle.functions import text as T
from brindle.functions.pay import pay
from brindle.operators import incremental, matching, search
from brindle.operators.relational import best_per_key
from brindle.plans.registry import query
from brindle.sources.tables import spread, table


@query(
    "annualize",
    """
select o_orderkey, case o_orderkey % 5 when 0 then a * coalesce(h * 52, 2080) when 1 then a * 260 when 2 then a * 52 when 3 then a * 12 else a end as yearly
from (select o_orderkey, cast(round(o_totalprice) as bigint) as a, case when o_orderkey % 3 = 0 then null else 40 end as h from orders)""",
)
def annualize(spark: SparkSession, d: str) -> DataFrame:
    """Amounts by hour to year, as yearly ones."""
    k = F.col("o_orderkey")
    unit = F.element_at(F.array(*map(F.lit, ("HOUR", "DAY", "WEEK", "MONTH", "YEAR"))), (k % 5 + 1).cast("int"))
    return table(spark, d, "orders").select(k, N.annualize(F.round("o_totalprice").cast("long"), unit, F.when(k % 3 != 0, F.lit(40))).alias("yearly"))


@query(
    "date_parse",
    """
select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y-%m-%d') end as day from orders""",
)
def date_parse(spark: SparkSession, d: str) -> DataFrame:
    """Days and times are read, other texts aren't."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, day).when(k == 1, F.concat(day, F.lit("T00:00:00Z"))).when(k == 2, F.date_format("o_orderdate", "yyyy")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(N.parse_posted(text), "yyyy-MM-dd").alias("day"))


@query(
    "rank_weights",
    """
select p_partkey, round(1.0 - (p_size - 1)::double / 50 * 0.5, 9) as falling, round(1.0 - 0.75 * (p_size - 1)::double / 49, 9) as floored from part""",
)
def rank_weights(spark: SparkSession, d: str) -> DataFrame:
    """Both weightings of a rank among fifty."""
    rank, total = F.col("p_size"), F.lit(50)
    return table(spark, d, "part").select("p_partkey", F.round(N.rank_weight(rank, total), 9).alias("falling"), F.round(N.floor_weight(rank, total), 9).alias("floored"))


@query(
    "value_match",
    """
with v as (select n_nationkey as owner, p_brand as value, min(p_size) as rank from part join nation on p_partkey % 25 = n_nationkey group by 1, 2),
r as (select *, 1.0 - (rank - 1)::double / count(*) over (partition by owner) * 0.5 as w from v),
t as (select *, sum(w) over (partition by owner) as total from r),
i as (select distinct s_suppkey as item, p_brand as value from supplier join part on s_suppkey = p_partkey % 1000),
m as (select owner, item, count(*) as shared, sum(w) as overlap, max(total) as total from t join i using (value) group by 1, 2)
select owner, item, shared, round(least(overlap / total + least(0.1 * shared, 0.3), 1.0), 6) as score from m""",
)
def value_match(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all owners and items that share a value."""
    part = table(spark, d, "part")
    values = part.join(table(spark, d, "nation"), F.col("p_partkey") % 25 == F.col("n_nationkey"))
    values = values.select(F.col("n_nationkey").alias("owner"), F.col("p_brand").alias("value"), F.col("p_size").alias("rank"))
    items = table(spark, d, "supplier").join(part, F.col("s_suppkey") == F.col("p_partkey") % 1000)
    items = items.select(F.col("s_suppkey").alias("item"), F.col("p_brand").alias("value"))
    found = matching.value_matches(values, items, "owner", "item", "value", "rank")
    return found.withColumn("score", F.round("score", 6))


@query(
    "composite_score",
    """
select l_orderkey, l_linenumber, round(case when l_quantity > 25 then (0.55 * l_discount + 0.35 * l_tax + 0.05 * 1.0) / 0.95
  else (0.55 * l_discount + 0.05 * 1.0) / 0.6 end, 9) as score from lineitem""",
)
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    """A weighted mean over the parts that are there."""
    tax = F.when(F.col("l_quantity") > 25, F.col("l_tax"))
    parts = [(F.col("l_discount"), 0.55), (tax, 0.35), (F.lit(1.0), 0.05), (F.lit(None).cast("double"), 0.05)]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(N.weighted_score(parts), 9).alias("score"))


@query(
    "geo_band_score",
    f"""
with p as (select s_suppkey, 45 + s_nationkey * 0.1 as lat, -75 + (s_suppkey % 40) * 0.1 as lng, s_suppkey % 6 = 0 as remote, s_nationkey % 5 = 1 as province from supplier),
m as (select *, 2 * {N.EARTH} * asin(least(1.0, sqrt(pow(sin(radians(lat - 45.4) / 2), 2) + cos(radians(45.4)) * cos(radians(lat)) * pow(sin(radians(lng + 75.7) / 2), 2)))) as metres from p)
select s_suppkey, round(metres, 3) as metres, case when remote then null when metres <= 50000 then 1.0 when metres <= 150000 or province then 0.5 else 0.0 end::double as score from m""",
)
def geo_band_score(spark: SparkSession, d: str) -> DataFrame:
    """Distances to one place and their bands; places follow a rule of the keys, as the tables have none."""
    lat, lng = F.lit(45.0) + F.col("s_nationkey") * 0.1, F.lit(-75.0) + (F.col("s_suppkey") % 40) * 0.1
    metres = N.distance(F.lit(45.4), F.lit(-75.7), lat, lng)
    score = N.place_score(F.col("s_suppkey") % 6 == 0, F.lit(False), F.lit(False), metres, F.col("s_nationkey") % 5 == 1)
    return table(spark, d, "supplier").select("s_suppkey", F.round(metres, 3).alias("metres"), score.alias("score"))


_TOP = """
with q as (select vec_id as query_id, embedding as qv from embeddings where {which}),
s as (select query_id, vec_id, round(list_dot_product(embedding::double[], qv::double[]) /
  (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(qv::double[], qv::double[]))), 9) as similarity from embeddings, q),
r as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as place from s)
select query_id, vec_id, similarity, place from r where place <= {k}"""


def _top(spark: SparkSession, d: str, which: str, k: int) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    queries = vectors.where(which).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return matching.top_similar(vectors, queries, k, "vec_id", "embedding", "query_id", "qv").select("query_id", "vec_id", "similarity", F.col("place").cast("long"))


@query("vector_topk", _TOP.format(which="vec_id = 0", k=80))
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 80 rows nearest one vector."""
    return _top(spark, d, "vec_id = 0", 80)


@query("vector_batch_topk", _TOP.format(which="vec_id < 18", k=5))
def vector_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 5 rows nearest each of a stated set of 18 vectors."""
    return _top(spark, d, "vec_id < 18", 5)


@query("vector_search_topk", _TOP.format(which="vec_id % 20 = 0", k=5))
def vector_search_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 5 rows nearest each row whose id is divisible by 20, among all rows."""
    return _top(spark, d, "vec_id % 20 = 0", 5)


@query(
    "vector_pooling",
    """
with x as (select label, (vec_id % 10)::double as w, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings)
select label, pos::bigint as pos, round(sum(w * x::double) / nullif(sum(w), 0), 6) as value from x group by 1, 2""",
)
def vector_pooling(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean vectors of each label."""
    found = matching.pooled(table(spark, d, "embeddings"), "label", "embedding", F.col("vec_id") % 10)
    return found.select("label", F.col("pos").cast("long"), F.round("value", 6).alias("value"))


@query(
    "skill_breadth",
    """
with p as (select distinct l_orderkey, l_partkey from lineitem), b as (select l_partkey, count(*) as n from p group by 1)
select l_orderkey, round(sum(1.0::double / n), 6) as credit from p join b using (l_partkey) group by 1""",
)
def skill_breadth(spark: SparkSession, d: str) -> DataFrame:
    """Each order's parts, rare ones worth more."""
    return matching.breadth_credit(table(spark, d, "lineitem"), "l_orderkey", "l_partkey").withColumn("credit", F.round("credit", 6))


@query(
    "distinct_on_best",
    """
select l_orderkey, l_partkey, l_quantity from (select *, row_number() over (partition by l_orderkey order by l_quantity desc, l_partkey, l_linenumber) as rn from lineitem) where rn = 1""",
)
def distinct_on_best(spark: SparkSession, d: str) -> DataFrame:
    """The largest line of each order."""
    order = [F.desc("l_quantity"), F.col("l_partkey"), F.col("l_linenumber")]
    return best_per_key(table(spark, d, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_partkey", "l_quantity")


@query(
    "trigram_similarity",
    """
with n as (select distinct p_name from part),
g as (select p_name, unnest(list_distinct(flatten(list_transform(string_split(lower(p_name), ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))) as g from n),
c as (select p_name, count(*) as n from g group by 1), o as (select a.p_name, b.p_name as other, count(*) as s from g a join g b using (g) where a.p_name <> b.p_name group by 1, 2)
select o.p_name, other, round(s / (a.n + b.n - s), 6) as similarity from o join c a on a.p_name = o.p_name join c b on b.p_name = other where s / (a.n + b.n - s) >= 0.3""",
)
def trigram_similarity(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of distinct names that resemble each other."""
    names = table(spark, d, "part").select("p_name").distinct()
    return search.similar_texts(names, "p_name", "p_name").withColumn("similarity", F.round("similarity", 6))


def _words(markers: list[str]) -> str:
    return ", ".join(f"'{m}'" for m in markers)


@query(
    "language_markers",
    f"""
with w as (select doc_id, length(text) as n, list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g'), ' '), lambda x: x <> '') as w, length(regexp_replace(lower(text), '[^{T.FRENCH_LETTERS}]', '', 'g')) as a from documents),
c as (select doc_id, n, len(list_filter(w, lambda x: x in ({_words(T.ENGLISH)}))) as en, len(list_filter(w, lambda x: x in ({_words(T.FRENCH)}))) + a * 0.5 as fr from w)
select doc_id, case when n < 40 or en + fr < 2 then null when fr >= 0.28 * (en + fr) and en >= 0.28 * (en + fr) and fr >= 3 and en >= 3 then 'bilingual'
  when fr >= 0.62 * (en + fr) then 'fr' when en >= 0.62 * (en + fr) then 'en' end as language from c""",
)
def language_markers(spark: SparkSession, d: str) -> DataFrame:
    """Languages of whole texts by their frequent words and letters."""
    low = F.lower("text")
    counted = spread(table(spark, d, "documents")).select(
        "doc_id", F.length("text").alias("n"), T.marker_count(low, T.ENGLISH).alias("en"), T.marker_count(low, T.FRENCH).alias("fr"), T.letter_count(low, T.FRENCH_LETTERS).alias("a")
    )
    return counted.select("doc_id", T.language_of(F.col("n"), F.col("en"), F.col("fr"), F.col("a")).alias("language"))


@query(
    "html_links",
    r"""select page_id, len(regexp_extract_all(html, 'href="([^"]+)"', 1)) as links, len(regexp_extract_all(html, 'hreflang="([^"]+)"', 1)) as locales from pages""",
)
def html_links(spark: SparkSession, d: str) -> DataFrame:
    """Links and locale hints of each page."""
    count = lambda p: F.coalesce(F.size(F.regexp_extract_all("html", F.lit(p), F.lit(1))), F.lit(None)).cast("long")
    return table(spark, d, "pages").select("page_id", count('href="([^"]+)"').alias("links"), count('hreflang="([^"]+)"').alias("locales"))


@query(
    "rate_limit_window",
    """
select e.event_id, (select count(*) from events f where f.user_id = e.user_id and f.event_type = 'error'
  and f.ts < e.ts and f.ts > e.ts - interval 1 hour) as prior_failures from events e""",
)
def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    """Each event's user's failures in the hour before it."""
    found = incremental.trailing_failures(table(spark, d, "events"), "user_id", "ts", F.col("event_type") == "error", 3600)
    return found.select("event_id", "prior_failures")


@query(
    "change_feed",
    """
with old as (select event_id, event_type, value from events where event_id % 6 <> 0),
new as (select event_id, event_type, case when event_id % 4 = 0 then null else value end as value from events where event_type <> 'view')
select event_id, case when o.event_id is null then 'insert' else 'update' end as change from new n left join old o using (event_id)
where o.event_id is null or n.event_type is distinct from o.event_type or n.value is distinct from o.value""",
)
def change_feed(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are new or differ, of the kinds that are wanted."""
    events = table(spark, d, "events")
    new = events.withColumn("value", F.when(F.col("event_id") % 4 != 0, F.col("value")))
    return incremental.change_feed(events.where("event_id % 6 <> 0"), new, "event_id", ["event_type", "value"], F.col("event_type") != "view")


@query(
    "queue_claim",
    """
select event_id, user_id from (select event_id, user_id, ts, event_id % 9 as attempts, case when event_id % 4 = 0 then ts + interval 1 day end as claimed_at,
  case when event_id % 3 = 0 then ts end as processed_at from events)
where processed_at is null and (claimed_at is null or claimed_at < timestamp '2024-01-20' - interval 60 second) and attempts < 8 and ts <= timestamp '2024-01-20'
order by ts, event_id limit 25""",
)
def queue_claim(spark: SparkSession, d: str) -> DataFrame:
    """The 25 oldest rows of a queue that are due: the worker's batch."""
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    queue = table(spark, d, "events").select(
        "event_id", "user_id", ts.alias("run_after"), (k % 9).alias("attempts"),
        F.when(k % 4 == 0, ts + F.expr("interval 1 day")).alias("claimed_at"), F.when(k % 3 == 0, ts).alias("processed_at"),
    )
    now = F.lit("2024-01-20").cast("timestamp")
    return incremental.claim(queue, ["run_after", "event_id"], now, 60, 8, 25).select("event_id", "user_id")


@query(
    "retention_purge",
    "select event_type, count(*) as n, count(distinct user_id) as users from events where ts >= timestamp '2024-01-30' - interval 7 day group by 1",
)
def retention_purge(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each kind after a week's retention."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kept = incremental.retained(events, "ts", F.lit("2024-01-30").cast("timestamp"), 7)
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query(
    "json_props",
    "select event_type, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as total, count(json_extract_string(props, '$.k')) as n from events group by 1",
)
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """Sums over a key of a JSON column; malformed values are null."""
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(value).alias("total"), F.count(value).alias("n"))


@query(
    "token_relevance",
    """
with w as (select item_id, list_distinct(list_filter(string_split(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) as w from benchmark)
select item_id, round(len(list_intersect(w, ['the', 'and', 'water', 'city'])) / 4, 6) as relevance from w""",
)
def token_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Share of a query's words in each text."""
    asked = F.array(*map(F.lit, ("the", "and", "water", "city")))
    return table(spark, d, "benchmark").select("item_id", F.round(T.relevance(T.tokens(F.col("text")), asked), 6).alias("relevance"))


@query(
    "pay_extraction",
    """
with t as (select o_orderkey, o_orderkey % 7 as k, cast(floor(o_totalprice) as bigint) as n from orders)
select o_orderkey, case when k = 0 then 'HOUR' when k = 1 then 'YEAR' when k = 5 then 'WEEK' when k = 6 then 'MONTH' when k = 2 then case when n >= 20000 then 'YEAR' when n >= 1500 then 'MONTH' when n >= 200 then 'WEEK' else 'HOUR' end end as unit_text,
  case when k < 3 then n * 100 + case when k = 0 then 50 else 0 end when k = 5 then cast(round_even(n * 100 / 2, 0) as bigint) when k = 6 then 123405 end as min_value,
  case when k = 1 then (n + 1000) * 100 when k = 6 then 123456700 end as max_value,
  (case when k = 3 then 'USD' when k <> 4 then 'CAD' end) as currency, (case when k < 2 or k > 5 then 0.9 when k = 2 or k = 5 then 0.5 else 0 end)::double as confidence from t""",
)
def pay_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Pay read back from texts in several forms."""
    k, n = F.col("o_orderkey") % 7, F.floor("o_totalprice").cast("long")
    text = (
        F.when(k == 0, F.concat(n.cast("string"), F.lit(",5$/heure")))
        .when(k == 1, F.concat(F.lit("$"), F.format_number(n, 0), F.lit(" to $"), F.format_number(n + 1000, 0), F.lit(" per year")))
        .when(k == 2, n.cast("string"))
        .when(k == 3, F.concat(F.lit("US$ "), n.cast("string")))
        .when(k == 5, F.concat(n.cast("string"), F.lit("$ par quinzaine")))
        .when(k == 6, F.concat(F.lit("1 234,05 $ – 1,234,567 $ par mois ou mensuel")))
        .otherwise("Competitive ")
    )
    found = table(spark, d, "orders").select("o_orderkey", pay(text).alias("p"))
    return found.select("o_orderkey", "p.unit_text", "p.min_value", "p.max_value", "p.currency", "p.confidence")
