"""Pay in short English and French texts, as Columns that stay in whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.text import bound

# What says a unit wherever it stands, in the order in which units are looked for, and what says it as whole words.
UNIT_PARTS = {
    "HOUR": ["heure", "horaire", "hourly", "per hour"],
    "DAY": ["daily", "per day"],
    "WEEK": ["semaine", "hebdo", "weekly", "per week"],
    "MONTH": ["mensuel", "monthly", "per month"],
    "YEAR": ["année", "annee", "annuel", "annual", "yearly", "per year"],
}
UNIT_WORDS = {"HOUR": ["/h", "/hr"], "DAY": ["jour", "/day"], "WEEK": ["/week"], "MONTH": ["mois", "/month"], "YEAR": ["par an", "/year"]}
#: The unit of amounts of so many cents or more where no word says it; HOUR below.
LEAST = {"YEAR": 2_000_000, "MONTH": 150_000, "WEEK": 20_000}
#: What says a currency other than CAD, as whole words.
CURRENCIES = {"USD": ["USD", "US$"], "EUR": ["EUR", "€"], "GBP": ["GBP", "£"]}
#: Words of hours a week in each language: the hours, what joins them, the week.
WEEKLY = [(["h", "heure", "heures"], ["/", "par"], "semaine"), (["hour", "hours", "hr", "hrs"], ["/", "per"], "week")]
#: Words that say nothing of the amount.
VAGUE = (
    "competitive|to be discussed|à discuter|selon expérience|selon l'expérience|à déterminer|to be determined|negotiable|à négocier"
    "|tbd|n/a|na|not available|à confirmer|to be confirmed|selon la convention|selon l'échelle"
)

#: What says that an amount is for two weeks, wherever it stands.
TWO_WEEKS = ["quinzaine", "biweekly", "bi-weekly", "bihebdomadaire", "bi-hebdomadaire", "every two weeks"]

_BLANKS = " \u00a0\u202f"
#: An amount with its sign before or after it.
AMOUNT = r"\$\d+(?:[,.]\d+)*|\d+(?:[ ,.]\d+)*\s*\$"
#: A run of digits with single separators between them; what these mean is settled afterwards.
_RUN = rf"\d+(?:[{_BLANKS},.]\d+)*"


def _cents(s: Column) -> Column:
    """Cents of a number's digits and decimals. Over twelve digits give null."""
    return F.when(F.length(s["whole"]) <= 12, F.concat(s["whole"], F.rpad(s["rest"], 2, "0")).cast("long"))


def _amounts(run: Column) -> Column:
    """Cents of the numbers of a run, from one pass over its groups of digits and the separators before them.

    A blank or comma before three digits groups, if the number began with three at most and has
    no other separator; a comma or dot before one or two digits begins decimals, but for a comma
    after grouping ones. Anything else begins a number.
    """
    groups, between = F.regexp_extract_all(run, F.lit(r"\d+"), F.lit(0)), F.regexp_extract_all(run, F.lit(rf"[{_BLANKS},.]"), F.lit(0))
    steps = F.zip_with(between, F.slice(groups, F.lit(2), F.size(groups)), lambda sign, n: F.struct(F.when(sign.isin(*_BLANKS), " ").otherwise(sign).alias("sign"), n.alias("n")))
    state = lambda done, whole, sign, rest: F.struct(done.alias("done"), whole.alias("whole"), sign.alias("sign"), rest.alias("rest"))
    none = F.lit("")

    def step(s: Column, p: Column) -> Column:
        plain = s["rest"] == ""
        more = plain & (p["sign"] != ".") & (F.length(p["n"]) == 3) & F.when(s["sign"] == "", F.length(s["whole"]) <= 3).otherwise(s["sign"] == p["sign"])
        decimals = plain & (p["sign"] != " ") & (F.length(p["n"]) <= 2) & ~((s["sign"] == ",") & (p["sign"] == ","))
        return (
            F.when(more, state(s["done"], F.concat(s["whole"], p["n"]), p["sign"], none))
            .when(decimals, state(s["done"], s["whole"], s["sign"], p["n"]))
            .otherwise(state(F.concat(s["done"], F.array(_cents(s))), p["n"], none, none))
        )

    return F.aggregate(steps, state(F.array().cast("array<bigint>"), F.get(groups, F.lit(0)), none, none), step, lambda s: F.concat(s["done"], F.array(_cents(s))))


def _says(low: Column, words: list[str]) -> Column:
    """Whether a lower-case text holds any of the words anywhere."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))


def whole_words(words: list[str]) -> str:
    """A pattern of any of the words, with no letter, digit or underscore next to an end that is one itself."""
    edge = lambda c, look: look if c.isalnum() else ""
    return "(?iu)" + "|".join(edge(w[0], r"(?<![\p{L}\d_])") + "".join(c if c.isalnum() or c in " /€£" else "\\" + c for c in w) + edge(w[-1], r"(?![\p{L}\d_])") for w in words)


def _unit(x: Column, low: Column) -> Column:
    return F.coalesce(*[F.when(_says(low, parts) | x.rlike(whole_words(UNIT_WORDS[name])), F.lit(name)) for name, parts in UNIT_PARTS.items()])


def _hours(low: Column) -> Column:
    """Hours a week: a number, and one after the other the words that WEEKLY has of one language."""

    def among(t: Column) -> Column:
        def read(hours: list[str], joins: list[str], week: str) -> Column:
            at = lambda i, k: F.get(t, i + k)
            fits = lambda i: at(i, 0).rlike("^[0-9]+$") & at(i, 1).isin(*hours) & at(i, 2).isin(*joins) & F.startswith(at(i, 3), F.lit(week))
            places = F.when(F.size(t) > 3, F.filter(F.sequence(F.lit(0), F.size(t) - 4), fits))
            return F.get(t, F.get(places, F.lit(0))).try_cast("int")

        return F.coalesce(*[read(*w) for w in WEEKLY])

    return bound(F.regexp_extract_all(low, F.lit(r"[0-9]+|\p{L}+|[^\s0-9\p{L}]"), F.lit(0)), among)


def pay(x: Column) -> Column:
    """A struct of unit_text, min_value and max_value (cents), hours_per_week, currency and confidence.

    The least and largest of all positive numbers count, hours among them; max_value is null
    for a single one. Without numbers all but a unit that words say, and the currency, is null
    and confidence is 0. Texts that say nothing, and null, have no unit or currency either.
    Amounts in other currencies than CAD are left out; amounts for two weeks become weekly ones,
    halves to the even cent.
    """
    amounts = F.filter(F.flatten(F.transform(F.regexp_extract_all(x, F.lit(_RUN), F.lit(0)), lambda run: _amounts(run))), lambda c: c > 0)
    vague = x.isNull() | x.rlike(rf"(?iu)^\s*({VAGUE})\s*$")
    low = F.lower(x)
    currency = F.coalesce(*[F.when(x.rlike(whole_words(words)), F.lit(name)) for name, words in CURRENCIES.items()], F.lit("CAD"))
    facts = F.struct(
        amounts.alias("amounts"), _unit(x, low).alias("said"), currency.alias("currency"), vague.alias("vague"),
        _hours(low).alias("hours"), F.coalesce(_says(low, TWO_WEEKS), F.lit(False)).alias("halved"),
    )

    def told(f: Column) -> Column:
        least = F.array_min(f["amounts"])
        guess = F.coalesce(*[F.when(least >= n, F.lit(u)) for u, n in LEAST.items()], F.when(least.isNotNull(), F.lit("HOUR")))
        most = F.when(F.size(f["amounts"]) > 1, F.array_max(f["amounts"]))
        own = f["currency"] == "CAD"
        known = ~f["vague"] & own
        weekly = lambda c: F.when(f["halved"], F.bround(c / 2).cast("long")).otherwise(c)
        return F.struct(
            F.when(known, F.when(f["halved"], "WEEK").otherwise(F.coalesce(f["said"], guess))).alias("unit_text"),
            F.when(known, weekly(least)).alias("min_value"),
            F.when(known, weekly(most)).alias("max_value"),
            F.when(known, f["hours"]).alias("hours_per_week"),
            F.when(~f["vague"], f["currency"]).alias("currency"),
            F.when(f["vague"] | least.isNull() | ~own, 0.0).when(f["said"].isNotNull(), 0.9).otherwise(0.5).alias("confidence"),
        )

    return bound(facts, told)
