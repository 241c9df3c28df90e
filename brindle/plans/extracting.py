"""Queries of values in texts, and of what models and people write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import extract as X
from brindle.functions import numbers as N
from brindle.plans.registry import query
from brindle.sources.tables import table

# Texts by rule of the key: forms of pay in two languages, and texts that state none.
_PAY = [
    "Salary: ${n} - $99,000 a year", "We offer\nSalaire à partir de {n} 500 $", "Taux horaire : 24,{n} $ à 28.15$", "{n}$ de l’heure", "Pay ${n}.50", "Pay: ${n}.50/hr",
    "$1,{n} to $2,000 annual", "call {n} for 3 boxes", "Rémunération selon l’échelle, {n}$", "plus de {n} $ / heure",
]


def _made(forms: list[str], key: str, number: str) -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    return f"replace([{', '.join(quote(t) for t in forms)}][{key} % {len(forms)} + 1], '{{n}}', {number})"


def _text(forms: list[str], key: str, number) -> F.Column:
    return F.replace(F.get(F.array(*map(F.lit, forms)), (F.col(key) % len(forms)).cast("int")), F.lit("{n}"), number)


def _pay_sql() -> str:
    """The same scan by lists: amounts, what stands between them, and the rank of each."""
    amount = X.AMOUNT
    line = r"translate(lower(regexp_extract(g[i], '([^0-9$\n]*)$', 1)), 'éèêë', 'eeee')"
    labelled = " or ".join(f"contains(right(line, {X.NEAR + len(w)}), '{w}')" for w in X.PAY_LABELS)
    signs, units = (", ".join(f"'{w}'" for w in ws) for ws in (X.RANGE_SIGNS, X.HOUR_UNITS))
    return rf"""
with t as (select o_orderkey, {_made(_PAY, 'o_orderkey', '(100 + o_orderkey % 800)::varchar')} as t from orders),
s as (select o_orderkey, regexp_extract_all(t, '{amount}') as a, string_split_regex(t, '{amount}') as g from t),
e as (select *, unnest(range(1, len(a) + 1)) as i from s),
r as (select *, {line} as line, i < len(a) and lower(trim(g[i + 1])) in ({signs}) as ranged from e),
k as (select *, case when ranged then a[i] || g[i + 1] || a[i + 1] else a[i] end as pay, lower(regexp_replace(ltrim(g[case when ranged then i + 2 else i + 1 end]), '[\s’'']+', ' ', 'g')) as after from r),
f as (select o_orderkey, i, trim(pay) as pay, case when {labelled} then 1 when regexp_matches(line, 'pay\s*:\s*$') and starts_with(a[i], '$') then 2
  when ranged and starts_with(a[i], '$') and starts_with(a[i + 1], '$') then 3 when regexp_extract(after, '^/ ?(\p{{L}}+)', 1) in ({units}) or starts_with(after, 'de l heure') then 4 end as rank from k)
select o_orderkey, arg_min(pay, rank * 1000 + i) filter (rank is not null) as pay from t left join f using (o_orderkey) group by o_orderkey"""


@query("pay_texts", _pay_sql())
def pay_texts(spark: SparkSession, d: str) -> DataFrame:
    """The pay that texts of many forms state."""
    text = _text(_PAY, "o_orderkey", (F.col("o_orderkey") % 800 + 100).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", X.pay_text(text).alias("pay"))


# Kinds of employment in texts, with what they should give; {n} is a number.
_KINDS = [
    ("Part-time role {n}, path to full-time", "part-time"), ("An internal post of {n} hours", None), ("Temps plein; contract of {n} months", "full-time"), ("May become a permanent full time contract {n}", None),
    ("INTERNSHIP no. {n} (seasonal)", "internship"), ("{n} volunteers attempt it", None), ("possibilité de devenir temps plein. Temporaire {n}", "temporary"), ("casual-{n} and temp work", "temporary"),
    ("opportunity for a part-time or casual contract, seasonal {n}", "seasonal"),
]


@query(
    "employment_mentions",
    "select o_orderkey, case o_orderkey % {} {} end as kind from orders".format(len(_KINDS), " ".join(f"when {i} then {'null' if k is None else repr(k)}" for i, (_, k) in enumerate(_KINDS))),
)
def employment_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The kind of employment that texts speak of now; the SQL has what each form means, as RE2 can't look around words."""
    text = _text([t for t, _ in _KINDS], "o_orderkey", F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", X.employment_kind(F.lit("Clerk"), text, F.lit(None).cast("string")).alias("kind"))


@query(
    "text_cuts",
    r"""
with t as (select doc_id, text, substr(text, 1, 120) as p from documents)
select doc_id, case when length(text) <= 41 then text else substr(text, 1, 20) || '…' || right(text, 20) end as middle,
  case when length(text) <= 120 then text when regexp_extract(p, '(?s)^(.+[.!?]) ', 1) <> '' then regexp_extract(p, '(?s)^(.+[.!?]) ', 1)
    when regexp_extract(p, '(?s)^(.+) ', 1) <> '' then regexp_extract(p, '(?s)^(.+) ', 1) || '...' else substr(p, 1, 117) || '...' end as sentence from t""",
)
def text_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut in the middle, and at a sentence's end."""
    return table(spark, d, "documents").select("doc_id", X.middle_cut(F.col("text"), 41).alias("middle"), X.sentence_cut(F.col("text"), 120).alias("sentence"))


@query(
    "plain_pages",
    r"""
with t as (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>|<style.*?>.*?</style>|<noscript.*?>.*?</noscript>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as t from pages)
select page_id, length(t) as n, md5(t) as text, length(t) < 80 or contains(lower(t), 'page not found') or contains(lower(t), 'coming soon') as empty from t""",
)
def plain_pages(spark: SparkSession, d: str) -> DataFrame:
    """Whole pages without tags, and whether there's something in them."""
    rows = table(spark, d, "pages").select("page_id", X.plain_text(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("text"), X.looks_empty(F.col("t")).alias("empty"))


@query(
    "embedding_texts",
    """
select p_partkey, nullif(substr(concat_ws(' | ', nullif(trim(case when p_partkey % 3 > 0 then p_name end), ''), p_brand, nullif(trim(case when p_partkey % 4 = 0 then ' ' else p_type end), '')), 1, 30), '') as text from part""",
)
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    """Labels and descriptions as one text."""
    k = F.col("p_partkey")
    parts = [F.when(k % 3 > 0, F.col("p_name")), F.concat(F.lit(" "), "p_brand"), F.when(k % 4 == 0, " ").otherwise(F.col("p_type"))]
    return table(spark, d, "part").select(k, X.embedding_text(*parts, most=30).alias("text"))


@query(
    "task_phrases",
    r"""
with t as (select doc_id, array_to_string(string_split(text, ' ')[1:(doc_id % 12)], ' ') as t from documents),
w as (select *, len(list_filter(string_split(regexp_replace(replace(lower(strip_accents(t)), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) as n from t)
select doc_id, n = 0 or n >= 8 or starts_with(lower(trim(t)), 'the ') or lower(trim(t)) = 'the' as task from w""",
)
def task_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Which beginnings of texts read like tasks, by their number of words and first ones."""
    phrase = F.array_join(F.slice(F.split("text", " "), F.lit(1), (F.col("doc_id") % 12).cast("int")), " ")
    return table(spark, d, "documents").select("doc_id", X.task_like(phrase, ["the "]).alias("task"))


@query(
    "wish_scores",
    """
with w as (select item_id, list_filter(string_split(regexp_replace(lower('Water near a Library, the coast'), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: length(x) > 2) as w, lower(text) as t from benchmark),
m as (select item_id, len(w) as n, len(list_filter(w, lambda x: contains(t, x))) as m from w) select item_id, round(least(m / n + least(m * 0.1, 0.3), 1.0), 9)::double as score from m""",
)
def wish_scores(spark: SparkSession, d: str) -> DataFrame:
    """How much of a wish each text meets."""
    return table(spark, d, "benchmark").select("item_id", F.round(X.wish_score(F.lit("Water near a Library, the coast"), F.col("text")), 9).alias("score"))


@query(
    "regraded",
    """
select doc_id, case when doc_id % 2 = 0 and regexp_matches(text, '(?i)\\b(the|and)\\b') and regexp_matches(text, '(?i)\\bof\\b') and not regexp_matches(text, '(?i)\\bwith\\b') then 'weak_yes'
  when doc_id % 2 = 0 then 'no' else 'yes' end as rating from documents""",
)
def regraded(spark: SparkSession, d: str) -> DataFrame:
    """Ratings that evidence raises unless a veto stands against it."""
    rating = F.when(F.col("doc_id") % 2 == 0, "no").otherwise("yes")
    return table(spark, d, "documents").select("doc_id", X.regraded(rating, F.col("text"), "no", "weak_yes", [r"\b(the|and)\b", r"\bof\b"], [r"\bwith\b"]).alias("rating"))


@query(
    "model_lists",
    """
with j as (select doc_id, list_distinct(list_filter(list_transform([lang, ' en ', source, '', lang], lambda x: trim(x)), lambda x: x <> '')) as v from documents)
select doc_id, case when doc_id % 5 = 4 then 0 else least(2, len(list_filter(v, lambda x: x in ('en', 'fr', 'src1', 'src2')))) end as n,
  case when doc_id % 5 < 4 then case when lang in ('en', 'fr') then lang else 'en' end end as first from j join documents using (doc_id)""",
)
def model_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists read from JSON answers, fenced, bare or broken: known values, each once, two at most."""
    k = F.col("doc_id") % 5
    body = F.to_json(F.struct(F.array("lang", F.lit(" en "), "source", F.lit(""), "lang").alias("values")))
    answer = F.when(k == 0, body).when(k < 4, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("{oops"), body))
    found = X.model_list(answer, "values", ["en", "fr", "src1", "src2"], 2)
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.get(found, F.lit(0)).alias("first"))


@query(
    "tidy_phrases",
    """
with p as (select p_partkey, p_name as a, p_partkey % 14 - 1 as n, p_brand as b from part)
select p_partkey, 1 + case when length(b) >= 3 then 1 else 0 end as kept, a as evidence, case when n < 0 then 5 else least(greatest(n, 1), 10) end as prominence from p""",
)
def tidy_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of a model: short and task-like ones left out, evidence and prominence filled in."""
    k = F.col("p_partkey") % 14 - 1
    row = lambda a, b, c: F.struct(a.alias("phrase"), b.alias("evidence"), c.cast("int").alias("prominence"))
    made = F.array(
        row(F.concat(F.lit(" "), "p_name"), F.lit(" "), F.when(k >= 0, k)), row(F.lit("ab"), F.lit("x"), F.lit(1)), row(F.col("p_brand"), F.lit("x"), F.lit(1)),
        row(F.lit("led a team"), F.lit("x"), F.lit(1)), row(F.lit(None).cast("string"), F.lit("x"), F.lit(1)),
    )
    rows = table(spark, d, "part").select("p_partkey", X.tidy_phrases(made, ["led "]).alias("p"))
    first = F.get("p", F.lit(0))
    return rows.select("p_partkey", F.size("p").alias("kept"), first["evidence"].alias("evidence"), first["prominence"].alias("prominence"))


_SHAPES = ['{"k": 1, "a": "x"}', '{"k": [1, 2]}', '{"k": {"b": 1}}', '{"k": null}', '{"k": "s"}', "{broken", '{"k": true, "0": 1}', "[1]", '{"k": 1.5}']


@query(
    "json_shapes",
    f"""
with s as (select event_id, [{', '.join(f"'{s}'" for s in _SHAPES)}][event_id % 9 + 1] as j from events), v as (select event_id, case when json_valid(j) then j end as j from s)
select event_id, case json_type(j, '$.k') when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null'
  when 'UBIGINT' then 'number' when 'DOUBLE' then 'number' end as kind, case when json_type(j) = 'OBJECT' then array_to_string(list_sort(json_keys(j)), ',') end as keys from v""",
)
def json_shapes(spark: SparkSession, d: str) -> DataFrame:
    """What a key of JSON texts holds, and the objects' keys."""
    text = F.get(F.array(*map(F.lit, _SHAPES)), (F.col("event_id") % 9).cast("int"))
    return table(spark, d, "events").select("event_id", X.json_kind(text, "k").alias("kind"), F.array_join(X.json_keys(text), ",").alias("keys"))


@query(
    "json_merges",
    """
select event_id, case when event_id % 3 = 0 then '{"k":"' || event_id || '","kind":"' || event_type || '"}' when event_id % 3 = 1 then '{"kind":"' || event_type || '"}' else '{"a":"x","k":"1","kind":"' || event_type || '"}' end as merged,
  event_type || case when event_id % 2 = 0 then ',seen' else '' end || case when event_type <> 'late' and event_id % 2 > 0 then ',seen' else '' end as flags from events""",
)
def json_merges(spark: SparkSession, d: str) -> DataFrame:
    """Keys put into JSON objects, and a flag into lists, once."""
    k = F.col("event_id")
    body = F.when(k % 3 == 0, F.concat(F.lit('{"kind": "old", "k": '), k.cast("string"), F.lit("}"))).when(k % 3 == 2, '{"k": 1, "a": "x"}')
    flags = F.when(k % 2 == 0, F.array("event_type", F.lit("seen"))).otherwise(F.array("event_type"))
    return table(spark, d, "events").select("event_id", X.json_put(body, {"kind": F.col("event_type"), "none": F.lit(None)}).alias("merged"), F.array_join(X.flagged(flags, "seen"), ",").alias("flags"))


@query(
    "vector_checks",
    "select vec_id, vec_id % 4 = 0 as sound from embeddings",
)
def vector_checks(spark: SparkSession, d: str) -> DataFrame:
    """Which vectors have their width and finite numbers only."""
    k, v = F.col("vec_id") % 4, F.col("embedding")
    made = F.when(k == 0, v).when(k == 1, F.slice(v, 1, 60)).when(k == 2, F.transform(v, lambda x, i: F.when(i != 5, x))).otherwise(F.transform(v, lambda x: x / F.lit(float("inf")) * F.lit(float("inf"))))
    return table(spark, d, "embeddings").select("vec_id", X.sound_vector(made, 64).alias("sound"))


@query(
    "match_scores",
    """
with p as (select l_orderkey, l_linenumber, case when l_linenumber % 2 = 1 then l_discount * 10 end as v, l_tax * 10 as s, case when l_quantity > 40 then 1.0 end as w,
  case when l_orderkey % 3 = 0 then l_quantity / 50 end as p, l_discount * 10 as sim, l_linenumber % 3 as reuse from lineitem)
select l_orderkey, l_linenumber, round(least(case when v is not null and w is null and p is null then v * 0.6 + s * 0.4
  else (coalesce(0.55 * v, 0) + 0.35 * s + coalesce(0.05 * w, 0) + coalesce(0.05 * p, 0)) / (case when v is null then 0 else 0.55 end + 0.35 + case when w is null then 0 else 0.05 end + case when p is null then 0 else 0.05 end) end, 1.0), 6)::double as score,
  round(greatest(0, (sim - 0.6) / 0.4) * case reuse when 0 then 0.35 when 1 then 0.6 else 1.0 end, 6)::double as fallback, cast(floor(least(greatest(sim, 0), 1) * 100 + 0.5) as int) as percent from p""",
)
def match_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of several parts with the older mixture where there are only two, skills by their own vectors, and percents."""
    sim, line = F.col("l_discount") * 10, F.col("l_linenumber")
    value, work, place = F.when(line % 2 == 1, sim), F.when(F.col("l_quantity") > 40, F.lit(1.0)), F.when(F.col("l_orderkey") % 3 == 0, F.col("l_quantity") / 50)
    reuse = F.when(line % 3 == 0, "transversal").when(line % 3 == 1, "cross-sector").otherwise("occupation")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(N.match_score(value, F.col("l_tax") * 10, work, place), 6).alias("score"),
        F.round(N.fallback_score(sim, reuse), 6).alias("fallback"), N.percent(sim).alias("percent"),
    )


@query(
    "day_cutoffs",
    "select event_type, count(*) as n from events where ts >= date_trunc('day', timestamp '2024-01-25 17:30:00') - interval 7 day group by 1",
)
def day_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """Events since the beginning of the day a week ago."""
    now = F.lit("2024-01-25 17:30:00").cast("timestamp")
    rows = table(spark, d, "events").where(F.col("ts").cast("timestamp") >= N.day_cutoff(now, 7))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "wage_labels",
    "select o_orderkey, case when o_orderkey % 4 < 3 then nullif(trim(case when o_orderkey % 4 = 2 then '' else o_orderpriority || case when o_orderkey % 4 = 1 then ' wage: x' else '' end end), '') end as wage from orders",
)
def wage_labels(spark: SparkSession, d: str) -> DataFrame:
    """Wages without the label before them."""
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(F.lit(" Salary:\t"), "o_orderpriority")).when(k == 1, F.concat("o_orderpriority", F.lit(" wage:  x"))).when(k == 2, "PAY: ")
    return table(spark, d, "orders").select("o_orderkey", X.without_label(text).alias("wage"))
