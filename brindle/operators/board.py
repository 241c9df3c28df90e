"""A board of postings: what people select becomes one condition, one order and one page, which Spark pushes down and prunes."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.numbers import annualize
from brindle.operators.relational import best_per_key, optional_in

#: Days after which no posting is shown, and the windows that people choose.
CEILING = 28
WINDOWS = {"1-week": 7, "2-weeks": 14, "3-weeks": 21, "1-month": 28}
#: Windows of activity of owners, in days; None is no limit.
ACTIVITY = {"all": None, "28d": 28, "90d": 90}
#: The nine orders, and those that need a signed-in user's scores.
SCORES = {"match-desc": "match_score", "value-match-desc": "value_score", "skill-match-desc": "skill_score"}
SORTS = ("date-desc", "date-asc", *SCORES, "salary-desc", "salary-asc", "org-asc", "org-desc")
PAGES, PAGE_ROWS = 1000, 100


@dataclass(frozen=True)
class Filters:
    """What is selected; empty selections select everything."""

    search: str = ""
    searched: Sequence[str] = ()
    selected: Mapping[str, Sequence[str]] = field(default_factory=dict)
    places: Mapping[str, Sequence[str]] = field(default_factory=dict)  # don't hold for remote work, if that is selected
    sources: Sequence[str] = ()
    within: str = "any"
    eligible_only: bool = True
    paid_only: bool = True


def any_like(columns: Sequence[str], part: str) -> Column:
    """Whether any column holds part, whatever its case; % and _ in part are wild, as in SQL. An empty part selects all."""
    found = F.lit(not part)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{part}%"), F.lit(False))
    return found


def holds_text(columns: Sequence[str], part: str) -> Column:
    """As any_like, with % and _ as ordinary characters and blanks around part left out."""
    part = part.strip().lower()
    found = F.lit(not part)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c), F.lit(part)), F.lit(False))
    return found


def since(now: datetime, days: int) -> str:
    """The moment so many days before now, in the form of the column posted."""
    return (now - timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%S.000Z")


def recent(posted: str, now: datetime, within: str = "any") -> Column:
    """Postings under the ceiling and in the chosen window; days are compared as texts, which keeps the condition in the scan."""
    days = min(WINDOWS.get(within, CEILING), CEILING)
    return (F.col(posted) >= since(now, CEILING)) & (F.col(posted) >= since(now, days))


def looked_back(scraped: str, posted: str, now: datetime, days: int) -> Column:
    """Rows seen since a moment, or posted since its day; both compared as texts."""
    return F.coalesce(F.col(scraped) >= since(now, days), F.lit(False)) | F.coalesce(F.col(posted) >= since(now, days)[:10], F.lit(False))


def available(eligible_only: bool, paid_only: bool, eligible: str = "is_eligible", paid: str = "has_pay") -> Column:
    """The universe of "x of y": eligible postings, and those with pay, where that is asked for; null is neither."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return (yes(eligible) if eligible_only else F.lit(True)) & (yes(paid) if paid_only else F.lit(True))


def brand(source: Column, brands: Mapping[str, str]) -> Column:
    """The brand whose pattern (any case) is the first to match a source's name; else the trimmed name, blank as null."""
    name = F.nullif(F.trim(source), F.lit(""))
    return F.coalesce(*[F.when(name.rlike(f"(?i){p}"), F.lit(b)) for b, p in brands.items()], name)


def of_brands(source: Column, selected: Sequence[str], brands: Mapping[str, str]) -> Column:
    """Whether a source is of a selected brand, given by the brand's or any of its sources' names."""
    if not selected:
        return F.lit(True)
    meant = {next((b for b, p in brands.items() if re.search(p, s.strip(), re.IGNORECASE)), s.strip()) for s in selected}
    return F.coalesce(brand(source, brands).isin(sorted(meant)), F.lit(False))


def expand_ids(selected: Sequence[str], legacy: Mapping[str, str]) -> list[str]:
    """Selected ids, the ids that replace them, and all old ids that these replace; blanks left out, in order."""
    out: dict[str, None] = {}
    for s in filter(None, (s.strip() for s in selected)):
        new = legacy.get(s, s)
        out.update(dict.fromkeys([new, *(old for old, n in legacy.items() if n == new), s]))
    return list(out)


def condition(f: Filters, now: datetime, brands: Mapping[str, str] | None = None) -> Column:
    """Whether a posting is selected; it has the columns that f names, and posted, work_type, source, is_eligible and has_pay."""
    out = holds_text(f.searched, f.search) & recent("posted", now, f.within) & available(f.eligible_only, f.paid_only)
    for c, values in f.selected.items():
        out = out & optional_in(c, values)
    place = F.lit(True)
    for c, values in f.places.items():
        place = place & optional_in(c, values)
    if "remote" in f.selected.get("work_type", ()):
        place = place | F.coalesce(F.col("work_type") == "remote", F.lit(False))
    return out & place & of_brands(F.col("source"), f.sources, brands or {})


def order(sort: str, unique: str = "id", annual: bool = False) -> list[Column]:
    """The order of a sort's name; unknown names are date-desc.

    Rows without pay come last either way, and where annual is true pay is compared by the
    year; other nulls are the largest. unique settles ties.
    """
    pay = annualize(F.col("min_value"), F.col("unit_text"), F.col("hours_per_week")) if annual else F.col("min_value")
    keys = {
        "date-asc": F.col("posted").asc_nulls_last(),
        "salary-desc": pay.desc_nulls_last(),
        "salary-asc": pay.asc_nulls_last(),
        "org-asc": F.col("organization").asc_nulls_last(),
        "org-desc": F.col("organization").desc_nulls_first(),
        **{s: F.col(c).desc_nulls_first() for s, c in SCORES.items()},
    }
    return [keys.get(sort, F.col("posted").desc_nulls_first()), F.col(unique)]


def board_page(df: DataFrame, f: Filters, now: datetime, sort: str, page: int = 1, rows: int = 20, annual: bool = False, brands: Mapping[str, str] | None = None) -> DataFrame:
    """One page of the selected postings; page and rows are held within PAGES and PAGE_ROWS."""
    page, rows = min(max(page, 1), PAGES), min(max(rows, 1), PAGE_ROWS)
    return df.where(condition(f, now, brands)).orderBy(*order(sort, annual=annual)).offset((page - 1) * rows).limit(rows)


def board_counts(df: DataFrame, f: Filters, now: datetime, brands: Mapping[str, str] | None = None) -> DataFrame:
    """(selected, available): one row, from one pass."""
    universe = recent("posted", now, f.within) & available(f.eligible_only, f.paid_only)
    return df.agg(F.count_if(condition(f, now, brands)).alias("selected"), F.count_if(universe).alias("available"))


def parse(params: Mapping[str, Sequence[str]], signed_in: bool, legacy: Mapping[str, str] | None = None) -> dict:
    """A page's parameters from raw ones: page from 1, a known sort (by name for those without scores), a known window, current ids."""
    one = lambda k, default="": (list(params.get(k, ())) or [default])[0]
    number = re.match(r"\s*-?\d+", one("page", "1"))
    sort = one("sortBy", "value-match-desc" if signed_in else "org-asc")
    if sort not in SORTS or sort in SCORES and not signed_in:
        sort = "org-asc"
    window = one("activity", "all") if one("activity", "all") in ACTIVITY else "all"
    sectors = dict.fromkeys((legacy or {}).get(s.strip(), s.strip()) for s in params.get("sector", ()) if s.strip())
    return {
        "page": max(1, int(number[0])) if number else 1, "search": one("q"), "eligible_only": one("all") != "true", "sort": sort,
        "activity": window, "days": ACTIVITY[window], "sectors": list(sectors),
    }


def hydrate(ids: DataFrame, rows: DataFrame, key: str, place: str) -> DataFrame:
    """rows of the listed ids in the list's order, which place gives; ids without a row are left out, repeated ones count once."""
    first = ids.groupBy(key).agg(F.min(place).alias(place))
    return rows.join(first, key).orderBy(place, key)


def labels_of(df: DataFrame, key: str, uris: str, labels: DataFrame, uri: str, label: str) -> DataFrame:
    """(key, labels): a map of label by URI for each row's list; unknown URIs and null labels are left out."""
    each = df.select(key, F.explode(F.array_distinct(uris)).alias("_uri")).join(labels.select(F.col(uri).alias("_uri"), F.col(label).alias("_label")).where("_label is not null"), "_uri")
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("_uri", "_label")))).alias("labels"))


def distinct_display(df: DataFrame, key: Column, order_: Sequence[Column]) -> DataFrame:
    """The best row of each display key by an order that ends in a unique column."""
    return best_per_key(df.withColumn("_display", key), ["_display"], order_).drop("_display")


def starter_list(df: DataFrame, label: Column, most: int) -> DataFrame:
    """The first rows by label (null last), of which those without one are left out afterwards."""
    return df.withColumn("label", label).orderBy(F.col("label").asc_nulls_last(), *df.columns[:1]).limit(most).where("label is not null")


def scores_for(matches: DataFrame, user: Column, ids: DataFrame, key: str) -> DataFrame:
    """A user's rows of matches for listed keys."""
    return matches.where(user).join(ids.select(key).distinct(), key, "left_semi")
