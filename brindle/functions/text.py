"""Text functions on Columns; null gives null unless a docstring says otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks, and the letters that are left of them: all in these blocks whose decomposition begins with a plain one.
_PAIRS = [(c, d[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()]
# Letters that are no letter with a mark, and what they fold to.
LETTERS = {"œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "ß": "ss", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ı": "i"}

# Frequent words that mark a language, and letters that mark French.
FRENCH = (
    "le la les un une des du au aux et ou mais donc car que qui dont pour dans sur avec sans sous chez par plus très aussi cette ces nous vous ils elles être avoir"
    " faire organisation organisme entreprise mission valeurs solidarité communautaire"
).split()
ENGLISH = (
    "the a an and or but for with without from this that these those we you they are is was were been have has had will would can could organization organisation"
    " company mission values about our"
).split()
FRENCH_LETTERS = "àâäæçéèêëïîôœùûüÿ"


def unaccent(x: Column) -> Column:
    """Latin letters without their marks, whether composed or not; œ, æ and ß as two letters."""
    single = {**dict(_PAIRS), **{k: v for k, v in LETTERS.items() if len(v) == 1}}
    out = F.translate(F.regexp_replace(x, r"(?<=[A-Za-z])[\u0300-\u036f]+", ""), "".join(single), "".join(single.values()))
    for letter, two in LETTERS.items():
        if len(two) == 2:
            out = F.replace(out, F.lit(letter), F.lit(two))
    return out


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x worked out once however often f refers to it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def fold(x: Column) -> Column:
    """Lower case without marks, trimmed."""
    return F.trim(F.lower(unaccent(x)))


def clean(x: Column) -> Column:
    """Control characters dropped, white space as one space, blank as null."""
    spaced = F.regexp_replace(F.regexp_replace(x, r"[\x00-\x08\x0E-\x1F\x7F]", ""), r"\s+", " ")
    return F.nullif(F.trim(spaced), F.lit(""))


def slug(x: Column) -> Column:
    """Lower-case letters and digits in groups, joined by one hyphen."""
    kept = F.regexp_replace(F.lower(unaccent(x)), "[^a-z0-9 ]", "")
    return F.regexp_replace(F.trim(kept), " +", "-")


def normal_url(x: Column) -> Column:
    """Trimmed, without slashes at the end."""
    return F.regexp_replace(F.trim(x), "/+$", "")


def safe_url(x: Column) -> Column:
    """The URL if its scheme is http, https or mailto, else null."""
    return F.when(F.lower(F.trim(x)).rlike("^(https?://|mailto:)"), F.trim(x))


def domain(x: Column) -> Column:
    """Host of a URL in lower case, without www; empty as null."""
    host = F.regexp_extract(F.lower(x), r"^[a-z]+://(?:www\.)?([^/:?#]+)", 1)
    return F.nullif(host, F.lit(""))


def first_filled(*xs: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in xs])


def tokens(x: Column) -> Column:
    """Folded words; names of languages and frameworks with signs stay whole. Null gives no words."""
    text = F.lower(F.coalesce(x, F.lit("")))
    for sign, word in (("c++", "cplusplus"), ("c#", "csharp"), ("f#", "fsharp"), (".net", "dotnet")):
        text = F.replace(text, F.lit(sign), F.lit(word))
    return F.filter(F.split(F.regexp_replace(unaccent(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays as sets; two empty ones give 0."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def relevance(label: Column, query: Column) -> Column:
    """Share of the query's distinct words that the label has."""
    asked = F.array_distinct(query)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, label)), F.size(asked)), F.lit(0.0))


def trigram_list(x: Column) -> Column:
    """Three-letter pieces of each folded word in order, two blanks before it and one after."""
    words = F.filter(F.split(F.regexp_replace(fold(x), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    pieces = F.transform(
        words,
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
    )
    return F.flatten(pieces)


def trigrams(x: Column) -> Column:
    """The distinct ones of trigram_list."""
    return F.array_distinct(trigram_list(x))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def marker_count(x: Column, markers: Sequence[str]) -> Column:
    """Words of a lower-case text that are among the markers."""
    return F.regexp_count(x, F.lit(rf"(?<!\p{{L}})(?:{'|'.join(markers)})(?!\p{{L}})"))


def letter_count(x: Column, letters: str) -> Column:
    """How many of a text's characters are among the letters."""
    return F.length(x) - F.length(F.translate(x, letters, ""))


def language_of(chars: Column, en: Column, fr: Column, accents: Column, least_chars: int = 40, sure: float = 0.62, both: float = 0.28) -> Column:
    """en, fr or bilingual by the markers' counts, a French letter as half a marker; null for short texts, few markers and unclear mixtures.

    Counts should be columns of their own, so that each text is read once for each. Shares are
    decimals: 7 of 25 are 0.28, but less than 0.28 * 25 as doubles.
    """
    exact = lambda x: F.lit(Decimal(str(x)))
    french = fr + accents * exact(0.5)
    total = french + en
    two = (french >= exact(both) * total) & (en >= exact(both) * total) & (french >= 3) & (en >= 3)
    said = F.when(two, "bilingual").when(french >= exact(sure) * total, "fr").when(en >= exact(sure) * total, "en")
    return F.when((chars >= least_chars) & (total >= 2), said)


def url_locale(url: Column) -> Column:
    """en, fr or bilingual by the parts of a URL's path that name a language, with or without a region; else null."""
    path = F.concat(F.regexp_extract(F.lower(url), r"^(?:[a-z]+://)?[^/?#]*([^?#]*)", 1), F.lit("/"))
    fr, en = path.rlike(r"/(?:fr(?:-[a-z]+)?|fran[cç]ais)/"), path.rlike(r"/(?:en(?:-[a-z]+)?|english|anglais)/")
    return F.when(fr & en, "bilingual").when(fr, "fr").when(en, "en")


def like_literal(x: Column, part: str) -> Column:
    """Whether the folded text holds part; % and _ are ordinary characters."""
    return F.contains(fold(x), fold(F.lit(part)))


def first_mapped(x: Column, mapping: Sequence[tuple[str, str]]) -> Column:
    """The value of the first pair whose key the folded text holds; order matters."""
    out = F.lit(None).cast("string")
    for part, value in reversed(mapping):
        out = F.when(F.contains(fold(x), F.lit(part)), value).otherwise(out)
    return out


def labeled(x: Column, labels: Sequence[str], stops: Sequence[str]) -> Column:
    """What follows the first of the labels and a colon, up to the line's end or the next label of stops; blank as null.

    Labels are patterns and may be in any case.
    """
    found = F.regexp_extract(x, rf"(?im)(?<![\p{{L}}\d])(?:{'|'.join(labels)})\h*:\h*(.*?)\h*(?:$|(?<![\p{{L}}\d])(?:{'|'.join([*labels, *stops])})\s*:)", 1)
    return F.nullif(F.trim(found), F.lit(""))


def tags(xs: Column, longest: int = 48, most: int = 8) -> Column:
    """Distinct tags in snake case in their order, each at most longest letters and most of them; null gives none."""
    snake = F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda t: F.substring(F.regexp_replace(F.regexp_replace(fold(t), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, longest))
    return F.slice(F.array_distinct(F.filter(snake, lambda t: t != "")), 1, most)
