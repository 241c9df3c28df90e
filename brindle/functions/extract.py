"""Values in free text, and tidying what models and people write; null gives null unless a docstring says otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.pay import AMOUNT
from brindle.functions.text import bound, clean, tokens

# What may stand before an amount of pay, in English and French, without accents.
PAY_LABELS = ["salaire", "salaire horaire", "salaire mensuel", "salaire mensuelle", "salaire de base", "remuneration", "taux horaire", "compensation", "wage", "salary"]
# A label that says so only with a colon, and signs, lower-case words and units of amounts.
COLON_LABELS = ["pay"]
RANGE_SIGNS = ["-", "–", "—", "to", "à"]
HOUR_UNITS = ["heure", "hr", "h"]
#: How far before its amount a label may stand.
NEAR = 80


def pay_text(x: Column) -> Column:
    """The amount or range of pay that a text states; null without one.

    Amounts are found first, with the text between them. Two that only a range sign parts are
    a range. An amount counts by what stands next to it: a label up to NEAR characters before
    it in its line, with no digit or dollar sign between; else a colon label right before it;
    else that it is a range of leading dollar signs; else that it is by the hour. The first
    amount of the best kind is it.
    """
    amounts, gaps = F.regexp_extract_all(x, F.lit(AMOUNT), F.lit(0)), F.split(x, AMOUNT)

    def among(s: Column) -> Column:
        amount, gap = lambda i: F.get(s["amounts"], i), lambda i: F.get(s["gaps"], i)

        def kind(i: Column) -> Column:
            ranged = F.coalesce(F.lower(F.trim(gap(i + 1))).isin(*RANGE_SIGNS) & amount(i + 1).isNotNull(), F.lit(False))
            line = F.translate(F.lower(F.regexp_extract(gap(i), r"([^0-9$\n]*)$", 1)), "éèêë", "eeee")
            labelled, colon = F.lit(False), F.lit(False)
            for label in PAY_LABELS:
                labelled = labelled | F.contains(F.right(line, F.lit(NEAR + len(label))), F.lit(label))
            for label in COLON_LABELS:
                colon = colon | F.endswith(F.regexp_replace(line, r"\s*:\s*$", ":"), F.lit(f"{label}:"))
            after = F.lower(F.regexp_replace(F.ltrim(gap(F.when(ranged, i + 2).otherwise(i + 1))), r"[\s’']+", " "))
            hourly = F.regexp_extract(after, r"^/ ?(\p{L}+)", 1).isin(*HOUR_UNITS) | F.startswith(after, F.lit("de l heure"))
            leads = F.startswith(amount(i), F.lit("$"))
            rank = F.when(labelled, 1).when(colon & leads, 2).when(ranged & leads & F.startswith(amount(i + 1), F.lit("$")), 3).when(hourly, 4)
            text = F.trim(F.when(ranged, F.concat(amount(i), gap(i + 1), amount(i + 1))).otherwise(amount(i)))
            return F.struct(rank.alias("rank"), i.alias("at"), text.alias("text"))

        places = F.when(F.size(s["amounts"]) > 0, F.sequence(F.lit(0), F.size(s["amounts"]) - 1))
        return F.array_min(F.filter(F.transform(places, kind), lambda k: k["rank"].isNotNull()))["text"]

    return bound(F.struct(amounts.alias("amounts"), gaps.alias("gaps")), among)


def without_label(x: Column, labels: Sequence[str] = ("compensation", "salary", "wage", "pay")) -> Column:
    """A cleaned text without the first label and its colon; blank as null."""
    return F.nullif(F.trim(F.regexp_replace(clean(x), rf"(?i)^(?:{'|'.join(labels)}):", "")), F.lit(""))


# Kinds of employment with the words that say them.
KINDS = {
    "full-time": ["full-time", "full time", "temps plein"],
    "part-time": ["part-time", "part time", "temps partiel"],
    "internship": ["internship", "intern"],
    "volunteer": ["volunteer", "volunteering"],
    "contract": ["contract", "contractor"],
    "temporary": ["temporary", "temp", "temporaire"],
    "seasonal": ["seasonal"],
    "casual": ["casual"],
}
# Words that speak of what a job may become, and words that may stand between them and its kind.
HEDGES = (
    "possibility potential opportunity option chance path prospect possibilité possibilite potentiel occasion may might could can would peut pourrait"
    " transition transitioning convert converting route voie"
).split()
FILLERS = (
    "of to for de d a an into au à en vers be become becoming convert converting transition transitioning move moving grow growing advance advancement lead"
    " leading devenir passer évoluer"
).split()


def hedged_pattern() -> str:
    """A clause that says what a job may become, for lower-case texts whose words are a space apart."""
    kinds = "|".join([w for words in KINDS.values() for w in words if w not in ("temp", "intern")] + ["intern", "permanent"])
    run = rf"(?:{kinds})(?: (?:or )?(?:{kinds}))*"
    return rf" (?:{'|'.join(HEDGES)})(?: (?:{'|'.join(FILLERS)})){{0,5}} {run} "


def employment_kind(*texts: Column) -> Column:
    """The kind of employment that texts name first, as whole words, outside of clauses on what the job may become; null without one."""
    parts = F.regexp_replace(F.lower(F.concat_ws("\n", *texts)), r"[.,;:!?()\[\]\n]+", " | ")  # clauses end there
    words = F.regexp_replace(parts, r"[^\p{L}\p{N}_|-]+", " ")
    line = F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), hedged_pattern(), "  ")

    def first(t: Column) -> Column:
        found = [F.struct(F.instr(t, f" {w} ").alias("at"), F.lit(i).alias("i"), F.lit(kind).alias("kind")) for i, (kind, ws) in enumerate(KINDS.items()) for w in ws]
        return F.array_min(F.filter(F.array(*found), lambda x: x["at"] > 0))["kind"]

    return bound(line, first)


def middle_cut(x: Column, most: int) -> Column:
    """A text of most characters, with … for what is cut from its middle."""
    half = (most - 1) // 2
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.left(x, F.lit(half)), F.lit("…"), F.right(x, F.lit(half))))


def sentence_cut(x: Column, most: int) -> Column:
    """Up to most characters, to the last sentence's end among them; else to the last space, with three dots."""
    part = F.substring(x, 1, most)
    sentence = F.regexp_extract(part, r"(?s)^(.+[.!?]) ", 1)
    words = F.regexp_extract(part, r"(?s)^(.+) ", 1)
    cut = F.when(sentence != "", sentence).when(words != "", F.concat(words, F.lit("..."))).otherwise(F.concat(F.substring(x, 1, most - 3), F.lit("...")))
    return F.when(F.length(x) <= most, x).otherwise(cut)


def plain_text(html: Column) -> Column:
    """A page's text without tags, scripts and styles, with white space as one space."""
    gone = "|".join(rf"<{t}.*?>.*?</{t}>" for t in ("script", "style", "noscript"))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, f"(?is){gone}", " "), r"(?s)<[^>]+>", " "), r"\s+", " "))


# What pages say that are there but empty.
EMPTY_PAGES = [
    "page not found", "error 404", "404 not found", "erreur 404", "coming soon", "under construction", "page introuvable", "bientôt disponible", "bientot disponible",
]


def looks_empty(text: Column, least: int = 80) -> Column:
    """Whether a page's text says that there's nothing, or is too short; null counts as empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    said = F.lit(False)
    for mark in EMPTY_PAGES:
        said = said | F.contains(low, F.lit(mark))
    return (F.length(low) < least) | said


def embedding_text(*parts: Column, most: int = 7500) -> Column:
    """The parts that aren't blank, trimmed and joined by bars, most characters at most; null without any part."""
    joined = F.concat_ws(" | ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])
    return F.nullif(F.substring(joined, 1, most), F.lit(""))


def display_key(*parts: Column) -> Column:
    """Trimmed lower-case parts joined by two colons; null parts are empty."""
    return F.concat_ws("::", *[F.lower(F.trim(F.coalesce(p, F.lit("")))) for p in parts])


def task_like(x: Column, beginnings: Sequence[str], most: int = 8) -> Column:
    """Whether a phrase reads like a task: no words, most words or more, or one of the beginnings; null counts as no words."""
    words, low = F.size(tokens(x)), F.lower(F.trim(F.coalesce(x, F.lit(""))))
    begins = F.lit(False)
    for b in beginnings:
        begins = begins | F.startswith(low, F.lit(b)) | (low == b.strip())
    return (words == 0) | (words >= most) | begins


def wished_words(wish: Column) -> Column:
    """Words of three letters or more of a wish, in order; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(wish, F.lit(""))), r"[^a-z0-9_]+"), lambda w: F.length(w) > 2)


def wish_score(wish: Column, text: Column) -> Column:
    """Share of the wish's words that a text holds anywhere, and a tenth for each, three at most; at most 1, null without words."""
    words = wished_words(wish)
    met = F.size(F.filter(words, lambda w: F.contains(F.lower(F.coalesce(text, F.lit(""))), w)))
    return F.when(F.size(words) > 0, F.least(met / F.size(words) + F.least(met * 0.1, F.lit(0.3)), F.lit(1.0)))


def regraded(rating: Column, said: Column, of: str, to: str, needs: Sequence[str], vetoes: Sequence[str]) -> Column:
    """to, where the rating is of, every pattern of needs is said and none of vetoes; else the rating. Null says nothing."""
    low = F.coalesce(said, F.lit(""))
    holds = rating == of
    for p in needs:
        holds = holds & low.rlike(f"(?i){p}")
    for p in vetoes:
        holds = holds & ~low.rlike(f"(?i){p}")
    return F.when(holds, F.lit(to)).otherwise(rating)


def model_list(answer: Column, key: str, allowed: Sequence[str] | None = None, most: int = 5) -> Column:
    """The list under key of a model's JSON answer, in a fence or not: trimmed, distinct, known ones only, most at most; malformed answers give none."""
    body = F.regexp_extract(F.trim(answer), r"(?s)^(?:```[a-z]*\s*)?(.*?)(?:\s*```)?$", 1)
    found = F.coalesce(F.from_json(body, f"struct<`{key}`:array<string>>")[key], F.array().cast("array<string>"))
    tidy = F.array_distinct(F.filter(F.transform(found, lambda v: F.trim(v)), lambda v: F.coalesce(v, F.lit("")) != ""))
    return F.slice(tidy if allowed is None else F.array_intersect(tidy, F.array(*map(F.lit, allowed))), 1, most)


def reranked(known: Column, answer: Column, key: str = "selected", most: int = 5) -> Column:
    """known in the order that a model's JSON answer names its members under key: distinct known ones, most at most.

    An answer that is malformed, or names none of them, keeps the first of known in their order.
    Items that aren't texts name none. Null known gives none.
    """
    ids = F.coalesce(known, F.array().cast("array<string>"))
    items = F.from_json(F.get_json_object(answer, f"$.{key}"), "array<string>")
    said = F.array_intersect(F.coalesce(items, F.array().cast("array<string>")), ids)
    kept = F.filter(said, lambda v: v.isNotNull())
    return F.slice(F.when(F.size(kept) > 0, kept).otherwise(ids), 1, most)


def tidy_phrases(phrases: Column, beginnings: Sequence[str] = (), least: int = 3) -> Column:
    """Structs (phrase, evidence, prominence): trimmed, evidence falls back on the phrase, prominence 1 to 10 (5 if null).

    Phrases of fewer than least letters, and those that read like tasks, go. Null gives none.
    """
    own = lambda p: F.trim(F.coalesce(p["phrase"], F.lit("")))
    made = F.transform(
        F.coalesce(phrases, F.array().cast("array<struct<phrase:string,evidence:string,prominence:int>>")),
        lambda p: F.struct(
            own(p).alias("phrase"),
            F.coalesce(F.nullif(F.trim(p["evidence"]), F.lit("")), own(p)).alias("evidence"),
            F.least(F.greatest(F.coalesce(p["prominence"], F.lit(5)), F.lit(1)), F.lit(10)).alias("prominence"),
        ),
    )
    return F.filter(made, lambda p: (F.length(p["phrase"]) >= least) & ~task_like(p["phrase"], beginnings))


def ranked(xs: Column) -> Column:
    """An ordered list as structs of value and rank from 1."""
    return F.transform(xs, lambda v, i: F.struct(v.alias("value"), (i + 1).alias("rank")))


def flagged(flags: Column, flag: str) -> Column:
    """The flags with one more, once; null gives that one."""
    return F.array_union(F.coalesce(flags, F.array().cast("array<string>")), F.array(F.lit(flag)))


def shared_in_order(own: Column, other: Column) -> Column:
    """Those of own that other has, in own's order."""
    return F.filter(own, lambda v: F.array_contains(other, v))


def json_kind(x: Column, key: str) -> Column:
    """What a key of a JSON object holds: object, array, string, number, boolean or null; null where it's missing or the text is malformed."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(x), f"$.{key}", "variant"))
    name = F.lower(F.regexp_extract(kind, r"^([A-Za-z]+)", 1))
    return F.when(name == "void", "null").when(name.isin("bigint", "decimal", "double", "float"), "number").otherwise(F.nullif(name, F.lit("")))


def json_keys(x: Column) -> Column:
    """Sorted keys of a JSON object; null for anything else."""
    return F.array_sort(F.json_object_keys(x))


def json_put(x: Column, values: Mapping[str, Column]) -> Column:
    """A JSON object of strings with keys put in; malformed and null objects count as empty, null values stay out."""
    known = F.coalesce(F.from_json(x, "map<string,string>"), F.create_map().cast("map<string,string>"))
    new = F.create_map(*[c for k, v in values.items() for c in (F.lit(k), v.cast("string"))])
    new = F.map_filter(new, lambda _, v: v.isNotNull())
    kept = F.map_filter(known, lambda k, _: ~F.map_contains_key(new, k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, new)))))


def sound_vector(v: Column, width: int) -> Column:
    """Whether a vector has its width and only finite components; null hasn't."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(v) == width) & finite, F.lit(False))
