"""Queries of full-text search by an inverted index, over whole documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import LETTERS
from brindle.operators import inverted, stretches
from brindle.plans.registry import query
from brindle.sources.tables import spread, table

#: Searches by name, for words as they stand.
PLAIN = {"prefix": "erat", "phrase": '"of the"', "mixed": 'the -and or "by for the"', "hyphen": "on-the with", "without": '-the -"la de"', "none": '"" or'}
#: Searches by language, for stems.
STEMMED = {
    "en": {"prefix": "things", "phrase": '"all right reserve"', "distance": '"licensing under the Apaches"', "mixed": 'ering -reserved or "erat the erring"', "stops": '"of the"'},
    "fr": {"prefix": "mentons", "both": "mentons ments", "mixed": "éeaux -mentons or tions", "stops": "le la"},
}


@query(
    "phrase_search",
    r"""
with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from documents), t as (select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as j from w)
select 'prefix' as search, doc_id from t where len(list_filter(w, lambda x: starts_with(x, 'erat'))) > 0
union all select 'phrase', doc_id from t where contains(j, ' of the ')
union all select 'mixed', doc_id from t where (contains(j, ' the ') and not contains(j, ' and ')) or contains(j, ' by for the ')
union all select 'hyphen', doc_id from t where contains(j, ' on the ') and contains(j, ' with ')
union all select 'without', doc_id from t where not contains(j, ' the ') and not contains(j, ' la de ')""",
)
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents that prefixes, phrases, exclusions and alternatives find, by words as they stand."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    index = inverted.stored(inverted.build(docs, "doc_id", F.col("text"), "simple"), "doc_id")
    return inverted.find(index, "doc_id", PLAIN, "simple", table(spark, d, "documents").select("doc_id"))


@query("stemmed_search")
def stemmed_search(spark: SparkSession, d: str) -> DataFrame:
    """(language, search, doc_id): what English and French searches of an index of all documents find; tests hold it against a loop over texts."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    index = inverted.stored(inverted.build(docs, "doc_id", F.col("text"), "simple"), "doc_id")
    words = inverted.lexicon(index, list(STEMMED))

    def one(language: str) -> DataFrame:
        found = inverted.find(index, "doc_id", STEMMED[language], language, table(spark, d, "documents").select("doc_id"), words)
        return found.select(F.lit(language).alias("language"), "search", "doc_id")

    return reduce(DataFrame.unionByName, map(one, STEMMED))




def _two_letters(x: str) -> str:
    """SQL that writes letters as two where folding does; strip_accents leaves them."""
    return reduce(lambda y, p: f"replace({y}, '{p[0]}', '{p[1]}')", LETTERS.items(), x)


#: Words that whole documents are searched for by their trigrams.
WORDS = ("between", "licence", "erat")


@query(
    "stretch_similarity",
    rf"""
with words as (select unnest(['between', 'licence', 'erat']) as word),
a as (select word, list_distinct(list_transform(range(1, length(word) + 2), lambda i: substr('  ' || word || ' ', i, 3))) as a from words),
t as (select doc_id, list_filter(string_split(regexp_replace(lower(strip_accents({_two_letters("coalesce(text, '')")})), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') as w from documents),
l as (select doc_id, flatten(list_transform(w, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))) as g from t),
g as materialized (select doc_id, p, gram, coalesce(lag(p) over (partition by doc_id, gram order by p), 0) as before from (select doc_id, unnest(g) as gram, generate_subscripts(g, 1) as p from l)),
h as materialized (select word, len(a) as m, doc_id, p, gram from a join g on list_contains(a, gram)),
x as (select h.word, m, doc_id, p, max(case when h.gram = e.gram then p end) over (partition by doc_id, h.word, e.gram order by p) as first from h join (select word, unnest(a) as gram from a) e on h.word = e.word),
s as (select word, m, doc_id, p, first, row_number() over (partition by word, doc_id, p order by first desc) as s from x where first is not null),
w as (select word, m, doc_id, s, first, min(p) as last from s group by all),
u as (select w.word, w.doc_id, s / (m + count(g.p)) as score from w join a on w.word = a.word left join g on g.doc_id = w.doc_id and g.p between first and last and before < first and not list_contains(a, gram) group by w.word, m, w.doc_id, s, first, last),
b as (select word, doc_id, max(score) as score from u group by all)
select d.doc_id, words.word, case when d.text is not null then round(coalesce(score, 0), 6) end as similarity from documents d cross join words left join b on b.doc_id = d.doc_id and b.word = words.word""",
)
def stretch_similarity(spark: SparkSession, d: str) -> DataFrame:
    """How well each of some words fits a stretch of each whole document."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return stretches.word_scores(docs, "doc_id", F.col("text"), WORDS).withColumn("similarity", F.round("similarity", 6))
