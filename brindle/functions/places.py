"""Places in texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.text import fold

# Provinces by code, with their folded names.
PROVINCES = {
    "AB": ["alberta"],
    "BC": ["british columbia", "colombie-britannique"],
    "MB": ["manitoba"],
    "NB": ["new brunswick", "nouveau-brunswick"],
    "NL": ["newfoundland and labrador", "newfoundland", "terre-neuve-et-labrador"],
    "NS": ["nova scotia", "nouvelle-ecosse"],
    "NT": ["northwest territories", "territoires du nord-ouest"],
    "NU": ["nunavut"],
    "ON": ["ontario"],
    "PE": ["prince edward island", "ile-du-prince-edouard"],
    "QC": ["quebec"],
    "SK": ["saskatchewan"],
    "YT": ["yukon"],
}


def province_code(x: Column) -> Column:
    """The code of a province's code or name, whatever its case and marks; else null."""
    t = fold(x)
    return F.coalesce(*[F.when(t.isin(code.lower(), *names), F.lit(code)) for code, names in PROVINCES.items()])

#: What names the country alone.
HOME = ["canada", "ca"]


def peeled(x: Column) -> Column:
    """A folded place without the country at its end, however often it stands there."""
    return F.regexp_replace(fold(F.coalesce(x, F.lit(""))), rf"(?:[\s,]*(?:^|[\s,])(?:{'|'.join(HOME)}))+[\s,]*$", "")


def province_alone(x: Column) -> Column:
    """The code of a place that is just a province, with or without the country; else null."""
    return province_code(peeled(x))


def country_alone(x: Column) -> Column:
    """Whether a place is just the country; null and blank aren't."""
    return (peeled(x) == "") & (F.trim(F.coalesce(x, F.lit(""))) != "")


def place_alias(x: Column, aliases: Mapping[str, str], as_prefix: Sequence[str] = ()) -> Column:
    """What a folded place stands for: exactly, or for those in as_prefix also where a comma or blank and more follows; else null."""
    key = fold(x)
    exact = F.coalesce(*[F.when(key == a, F.lit(v)) for a, v in aliases.items()])
    begun = [F.when(F.startswith(key, F.lit(f"{a},")) | F.startswith(key, F.lit(f"{a} ")), F.lit(aliases[a])) for a in as_prefix]
    return F.coalesce(exact, *begun)


def needs_city(x: Column, remote: Column, filled: Sequence[Column], province: Column) -> Column:
    """Whether a place still has to be looked up.

    Blank ones, the country alone and remote work don't; a province alone only if its code isn't
    there; others if any of filled is missing.
    """
    blank = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""
    lacking = F.lit(False)
    for c in filled:
        lacking = lacking | blank(c)
    return ~(blank(x) | remote | country_alone(x)) & F.when(province_alone(x).isNotNull(), blank(province)).otherwise(lacking)


# Words of remote work, words of hybrid work, and pairs that say hybrid in this order.
REMOTE = "remote; remotely; virtual; anywhere; télétravail; telework; work from home; wfh; home office; canada wide; canada-wide".split("; ")
HYBRID = "hybrid; flexible; flex".split("; ")
HYBRID_PAIRS = [("remote", "office"), ("office", "remote"), ("days", "office"), ("days", "onsite"), ("days", "on-site"), ("work from home", "office"), ("office", "work from home")]
# States by code; CA is left out of the codes, as it may be Canada.
STATES = {
    "AL": "alabama", "AK": "alaska", "AZ": "arizona", "AR": "arkansas", "CA": "california", "CO": "colorado", "CT": "connecticut", "DC": "district of columbia", "DE": "delaware",
    "FL": "florida", "GA": "georgia", "HI": "hawaii", "IA": "iowa", "ID": "idaho", "IL": "illinois", "IN": "indiana", "KS": "kansas", "KY": "kentucky", "LA": "louisiana",
    "MA": "massachusetts", "MD": "maryland", "ME": "maine", "MI": "michigan", "MN": "minnesota", "MO": "missouri", "MS": "mississippi", "MT": "montana", "NC": "north carolina",
    "ND": "north dakota", "NE": "nebraska", "NH": "new hampshire", "NJ": "new jersey", "NM": "new mexico", "NV": "nevada", "NY": "new york", "OH": "ohio", "OK": "oklahoma",
    "OR": "oregon", "PA": "pennsylvania", "RI": "rhode island", "SC": "south carolina", "SD": "south dakota", "TN": "tennessee", "TX": "texas", "UT": "utah", "VA": "virginia",
    "VT": "vermont", "WA": "washington", "WI": "wisconsin", "WV": "west virginia", "WY": "wyoming",
}


def _says(x: Column, phrases: Sequence[str]) -> Column:
    """Whether a lower-case text has any of the phrases as whole words."""
    return x.rlike(rf"(?<![\p{{L}}\d])(?:{'|'.join(phrases)})(?![\p{{L}}\d])")


def work_type(x: Column, city: Column) -> Column:
    """hybrid, remote or office; remote work with a city is hybrid, and nothing said is office."""
    t = F.lower(F.coalesce(x, F.lit("")))
    some_city = F.coalesce(F.trim(city), F.lit("")) != ""
    hybrid = _says(t, HYBRID)
    for first, then in HYBRID_PAIRS:
        hybrid = hybrid | (_says(t, [first]) & t.rlike(rf"\b{first}.*\b{then}\b"))
    return F.when(hybrid, "hybrid").when(_says(t, REMOTE), F.when(some_city, "hybrid").otherwise("remote")).otherwise("office")


# Names of the country, as words without dots; "us" alone counts only as a whole part in capitals.
COUNTRY = ["united states", "united states of america", "usa"]


def us_only(x: Column) -> Column:
    """Whether a place is in the United States, and Canada isn't named too; null and blank aren't.

    The country's name counts anywhere; a state's name at the beginning of a part after a comma, a
    state's code as a part, or a part's last word before the country or the end of the text.
    """
    t = F.lower(F.coalesce(x, F.lit("")))
    dotless = F.replace(F.replace(t, F.lit("u.s.a."), F.lit("usa")), F.lit("u.s."), F.lit("usa "))
    parts = F.slice(F.transform(F.split(dotless, ","), lambda p: F.trim(F.regexp_replace(p, r"[.;:!?\s]+", " "))), F.lit(2), 1_000)
    words = F.filter(F.split(F.regexp_replace(dotless, r"[\s,]+", " "), " "), lambda w: w != "")
    codes = F.array(*[F.lit(c.lower()) for c in STATES if c != "CA"])
    named = F.exists(parts, lambda p: F.exists(F.array(*map(F.lit, STATES.values())), lambda s: F.startswith(F.concat(p, F.lit(" ")), F.concat(s, F.lit(" ")))))
    coded = F.exists(F.transform(parts, lambda p: F.split_part(p, F.lit(" "), F.lit(1))), lambda w: F.array_contains(codes, w)) & F.exists(
        parts, lambda p: F.array_contains(codes, F.split_part(p, F.lit(" "), F.lit(1))) & ((F.instr(p, " ") == 0) | _says(p, COUNTRY))
    )
    last = F.try_element_at(words, F.lit(-1))
    ends = (F.size(words) > 1) & F.array_contains(codes, F.regexp_replace(last, "[.;:!?]+$", ""))
    alone = F.regexp_extract(F.coalesce(x, F.lit("")), r",\s*(US)\s*$", 1) != ""
    return F.coalesce((_says(dotless, COUNTRY) | named | coded | ends | alone) & ~_says(t, ["canada", "canadas", "canadian", "canadians"]), F.lit(False))


def unglued(x: Column) -> Column:
    """A word that is repeated without a gap ("LavalLaval") once."""
    return F.regexp_replace(x, r"(?iu)(?<![\p{L}\d])(\p{L}{3,}?)\1+(?![\p{L}\d])", "$1")
