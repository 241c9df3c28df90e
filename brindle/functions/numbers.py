"""Dates, money, ranks, scores and distances on Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.text import unaccent

#: Metres of the sphere that distances are taken on.
EARTH = 6378168.0


def parse_posted(x: Column) -> Column:
    """A day, or a time with or without zone, as a timestamp in UTC; anything else, and days that don't exist, as null."""
    day = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(x, F.lit("yyyy-MM-dd")))
    zoned = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(x))
    naive = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?$"), F.try_to_timestamp(F.concat(x, F.lit("Z"))))
    return F.coalesce(day, zoned, naive)


def ago_days(x: Column) -> Column:
    """Days that "N units ago" means, a month as 30; null for other texts and numbers over four digits."""
    found = r"(\d+)\s*(day|week|month)s? ago"
    n = F.nullif(F.regexp_extract(F.lower(x), found, 1), F.lit(""))
    unit = F.regexp_extract(F.lower(x), found, 2)
    return F.when(F.length(n) <= 4, n.cast("int") * F.when(unit == "week", 7).when(unit == "month", 30).otherwise(1))


def annualize(amount: Column, unit: Column, hours: Column) -> Column:
    """Yearly amount in cents; hours a week default to 2,080 a year. Unknown units give null."""
    amount = amount.cast("long")
    yearly = F.coalesce(hours.cast("long") * 52, F.lit(2080))
    return (
        F.when(unit == "HOUR", amount * yearly)
        .when(unit == "DAY", amount * 260)
        .when(unit == "WEEK", amount * 52)
        .when(unit == "MONTH", amount * 12)
        .when(unit == "YEAR", amount)
    )


def rank_weight(rank: Column, total: Column) -> Column:
    """1 for the first of a ranking, falling to over one half; 1 where there's no ranking."""
    slope = F.lit(1.0) - (rank.cast("double") - 1) / F.nullif(total, F.lit(0)).cast("double") * 0.5
    return F.coalesce(slope, F.lit(1.0))


def floor_weight(rank: Column, total: Column) -> Column:
    """The other weighting: from 1 to a quarter over the ranking; one half where there's none."""
    steps = F.nullif(total - 1, F.lit(0)).cast("double")
    share = F.when(total == 1, F.lit(1.0)).otherwise(F.lit(1.0) - F.lit(0.75) * (rank.cast("double") - 1) / steps)
    return F.coalesce(share, F.lit(0.5))


def weighted_score(parts: Sequence[tuple[Column, float]]) -> Column:
    """Mean of the parts that aren't null, by weight; null without any."""
    top = sum((F.coalesce(p * F.lit(w), F.lit(0.0)) for p, w in parts), F.lit(0.0))
    low = sum((F.when(p.isNotNull(), F.lit(w)).otherwise(0.0) for p, w in parts), F.lit(0.0))
    return F.try_divide(top, low)


def match_score(value: Column, skill: Column, work: Column, place: Column) -> Column:
    """Value and skill as 60 and 40 where there's nothing else; else weighted_score with 0.55, 0.35, 0.05, 0.05. At most 1, and 0 without any."""
    only = value.isNotNull() & skill.isNotNull() & work.isNull() & place.isNull()
    mixed = weighted_score([(value, 0.55), (skill, 0.35), (work, 0.05), (place, 0.05)])
    return F.least(F.when(only, value * 0.6 + skill * 0.4).otherwise(F.coalesce(mixed, F.lit(0.0))), F.lit(1.0))


#: What a skill counts by how widely it is used, where only its own vector speaks for it.
REUSE = {"transversal": 0.35, "cross-sector": 0.6}


def fallback_score(similarity: Column, reuse: Column) -> Column:
    """soft_threshold from 0.6, weighted by how widely the skill is used."""
    factor = F.lit(1.0)
    for level, w in REUSE.items():
        factor = F.when(reuse == level, w).otherwise(factor)
    return soft_threshold(similarity, 0.6) * factor


def clamped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def percent(share: Column) -> Column:
    """A share as whole percents from 0 to 100, halves rounded up."""
    return F.floor(clamped(share, 0.0, 1.0) * 100 + 0.5).cast("int")


def day_cutoff(now: Column, days: int) -> Column:
    """The beginning of the day so many days before now."""
    return F.date_trunc("day", now) - F.make_dt_interval(days=F.lit(days))


def value_score(overlap: Column, total: Column, shared: Column) -> Column:
    """Overlap's share and a bonus of a tenth for each shared value, three at most; at most 1."""
    bonus = F.least(F.lit(0.1) * shared, F.lit(0.3))
    return F.least(F.coalesce(F.try_divide(overlap, total), F.lit(0.0)) + bonus, F.lit(1.0))


def soft_threshold(similarity: Column, floor: float, factor: float = 1.0) -> Column:
    """0 up to floor, then in proportion up to factor."""
    return F.greatest(F.lit(0.0), (similarity - F.lit(floor)) / F.lit(1.0 - floor)) * F.lit(factor)


def backoff(attempts: Column) -> Column:
    """Seconds to wait before another attempt: doubling six times, an hour at most."""
    return F.least(F.pow(F.lit(2.0), F.least(attempts, F.lit(6))), F.lit(3600.0)).cast("long")


def distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres along a great circle."""
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    h = F.pow(F.sin(dlat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng), F.lit(2))
    return F.lit(2 * EARTH) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def place_score(remote: Column, wants_remote_only: Column, same_city: Column, metres: Column, same_province: Column) -> Column:
    """1, 0.5, 0 or null: nothing is said of remote work; the same city or 50 km count in full, 150 km or the province half."""
    return (
        F.when(remote, F.lit(None).cast("double"))
        .when(wants_remote_only, 0.0)
        .when(same_city | (metres <= 50_000), 1.0)
        .when((metres <= 150_000) | same_province, 0.5)
        .otherwise(0.0)
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null for zero vectors and other lengths."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.try_divide(dot, norm(a) * norm(b))


# Beginnings of French and English months without marks, in their order.
MONTHS = ["jan", "fe[vb]", "mar", "a[vp]r", "ma[iy]", "ju(?:in|n)", "jui?l", "ao?u", "sep", "oct", "nov", "dec"]


def french_day(x: Column) -> Column:
    """A day from a text such as "1er févr. 2024" or "March 5, 2024"; other texts, and days that don't exist, give null."""
    t = F.lower(unaccent(x))
    month = F.regexp_extract(t, r"([a-z]{3,})\.?,?\s+(?:\d{1,2},?\s+)?\d{4}", 1)
    number = F.coalesce(*[F.when(month.rlike(f"^{m}"), F.lit(i)) for i, m in enumerate(MONTHS, 1)])
    day = F.coalesce(F.nullif(F.regexp_extract(t, r"(?<!\d)(\d{1,2})(?:er)?\s+[a-z]{3,}\.?,?\s+\d{4}", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"[a-z]{3,}\.?\s+(\d{1,2}),?\s+\d{4}", 1), F.lit("")))
    year = F.nullif(F.regexp_extract(t, r"\s(\d{4})(?!\d)", 1), F.lit(""))
    return F.try_to_timestamp(F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
