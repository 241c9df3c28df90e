"""Names of organisations: what boards add to them, keys for equality, and slugs."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import slug, unaccent

# What page titles add to a name after a bar, slash or dash.
AFTER_ANY = [
    "apply", "apply now", "postuler", "postulez", "linktree", "linktr.ee", "carrd", "carrd.co", "bio.link", "lnk.bio", "about", "about us", "home",
    "accueil", "welcome", "bienvenue", "career", "careers", "job", "jobs", "emploi", "emplois", "contact", "contact us", "social impact",
]
# What they add after a bar or slash only.
AFTER_BAR = [
    "candidat", "candidature", "candidater", "submit", "submit application", "submit a application", "submit an application", "beacons.ai",
    "solo.to", "allmylinks", "official site", "our story", "who we are", "get involved", "facebook", "instagram",
]
# What is counted in names.
COUNTED = "position positions poste postes opening openings vacancy vacancies role roles offre offres".split()


def _any(phrases: Iterable[str]) -> str:
    """A pattern of any of the phrases, longest first."""
    return "|".join(re.escape(p).replace(r"\ ", r"\s+") for p in sorted(phrases, key=lambda p: (-len(p), p)))


def _endings() -> str:
    """A pattern of everything at a name's end that isn't the name, in any order and number."""
    dash = r"(?:\s+[-–—]|[–—])\s*"
    counted = rf"\d+\s+(?:{_any(COUNTED)})"
    kinds = [
        rf"\s*[|/]\s*(?:{_any(AFTER_ANY + AFTER_BAR)})", rf"{dash}(?:{_any(AFTER_ANY)})",
        rf"\s*\(\s*{counted}\s*\)", rf"\s*\[\s*{counted}\s*\]", rf"\s*[-–—]\s*{counted}",
    ]
    return rf"(?i)(?:{'|'.join(kinds)})+\s*$"


def display_name(x: Column) -> Column:
    """The name without calls to apply, page names and counts of openings at its end, in any order and number; null as empty."""
    return F.trim(F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), _endings(), ""))


def _without_acronym(x: Column) -> Column:
    """A name without the bracket at its end, if that holds 2 to 15 capitals, digits and signs that join them, two capitals or more."""
    inside = F.regexp_extract(x, r"[(\[]([^()\[\]]*)[)\]]\s*$", 1)
    capitals = F.length(F.regexp_replace(inside, "[^A-Z]", ""))
    acronym = (capitals >= 2) & (F.length(inside) <= 15) & inside.rlike("^[A-Z]") & (F.length(F.regexp_replace(inside, "[A-Z0-9.&/-]", "")) == 0)
    return F.when(acronym, F.regexp_replace(x, r"\s*[(\[][^()\[\]]*[)\]]\s*$", "")).otherwise(x)


def organization_key(x: Column) -> Column:
    """Folded words of the display name without a capital acronym at its end; "&" and "et" are "and"."""
    t = F.lower(unaccent(_without_acronym(display_name(x))))
    t = F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), r"\bet\b", " and ")
    t = F.regexp_replace(F.regexp_replace(t, "[-_/]+", " "), "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(t, " +", " "))


def loose_key(x: Column) -> Column:
    """organization_key without "and"."""
    return F.trim(F.regexp_replace(F.regexp_replace(organization_key(x), r"\band\b", " "), " +", " "))


def unique_slugs(df: DataFrame, key: str, name: str, numbered: int = 10) -> DataFrame:
    """df with slug: the first by key has the plain one, the next few a number, all others a piece of their key's hash.

    Only the first few of each slug are ranked, which Spark cuts down to before its shuffle;
    they are joined back by key, so a slug that most rows share is no hot group.
    """
    first = df.select(key, slug(F.col(name)).alias("_slug"))
    place = F.row_number().over(Window.partitionBy("_slug").orderBy(key))
    ranked = first.withColumn("_n", place).where(F.col("_n") <= numbered).select(key, "_n")
    base, n = slug(F.col(name)), F.col("_n")
    suffix = F.when(n == 1, "").when(n.isNotNull(), F.concat(F.lit("-"), n)).otherwise(F.concat(F.lit("-"), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8)))
    return df.join(ranked, key, "left").withColumn("slug", F.concat(base, suffix)).drop("_n")
