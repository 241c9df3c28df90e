"""Stemmers of English and French: the published suffix-stripping steps with their regions; a word at a time, for Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

# Words that searches leave out.
ENGLISH_STOPS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves"
    " what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while"
    " of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there"
    " when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
FRENCH_STOPS = (
    "au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses sur ta te"
    " tes toi ton tu un une vos votre vous c d j l à m n s t y étée étées étant suis es êtes sont serai seras sera serons serez seront serais serait serions seriez seraient"
    " étais était étions étiez étaient fus fut fûmes fûtes furent sois soit soyons soyez soient fusse fusses fussions fussiez fussent ayant eu eue eues eus ai avons avez"
    " ont aurai auras aura aurons aurez auront aurais aurait aurions auriez auraient avais avait aviez avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse"
    " eusses eût eussions eussiez eussent"
).split()
STOPS = {"en": frozenset(ENGLISH_STOPS), "fr": frozenset(FRENCH_STOPS), "simple": frozenset()}

# Fixed values of the English steps: words of their own, and what each ending becomes.
EN_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
EN_WHOLE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
EN_SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
EN_THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
EN_FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

# Fixed values of the French steps: endings by what is done to them.
FR_GONE = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
FR_AGENT = "atrice ateur ation atrices ateurs ations".split()
FR_NOUNS = {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}
FR_OTHERS = "ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments".split()
FR_I_VERBS = (
    "îmes ît îtes i ie Ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse"
    " issent isses issez issiez issions issons it"
).split()
FR_E_VERBS = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
FR_A_VERBS = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()

class _Endings(frozenset):
    """Endings, with one tuple of them all and their lengths from the longest on."""

    def __init__(self, *_):
        self.all, self.lengths = tuple(self), sorted({len(e) for e in self}, reverse=True)


def _ending(w: str, endings: _Endings) -> str | None:
    """The longest of the endings that w has; where there is one, a look for each length finds it."""
    if w.endswith(endings.all):
        for k in endings.lengths:
            if w[-k:] in endings:
                return w[-k:]
    return None


EN_POSSESSIVES, EN_PAST, EN_SECONDS, EN_THIRDS, EN_FOURTHS = map(_Endings, (("'", "'s", "'s'"), ("eed", "eedly", "ed", "edly", "ing", "ingly"), EN_SECOND, EN_THIRD, EN_FOURTH))
FR_ALL_NOUNS, FR_I_ENDINGS, FR_VERBS = map(_Endings, ([*FR_GONE, *FR_AGENT, *FR_NOUNS, *FR_OTHERS], FR_I_VERBS, [*FR_E_VERBS, *FR_A_VERBS, "ions"]))
FR_RESTS = _Endings(("ion", "ier", "ière", "Ier", "Ière", "e"))

EN_VOWELS = frozenset("aeiouy")
FR_VOWELS = frozenset("aeiouyâàëéêèïîôûù")
#: A vowel and a non-vowel after it; what _french_marks may have to change.
EN_MET, FR_MET = (re.compile("[{0}][^{0}]".format("".join(sorted(v)))) for v in (EN_VOWELS, FR_VOWELS))
FR_MARKED = re.compile("[ëï]|qu|[{0}][uiy]|y[{0}]".format("".join(sorted(FR_VOWELS))))




def _after(w: str, start: int, met: re.Pattern) -> int:
    """Where the region after the first non-vowel that follows a vowel, from start on, begins."""
    found = met.search(w, start)
    return found.end() if found else len(w)


def _short(w: str) -> bool:
    """Whether w ends in a short syllable."""
    v = EN_VOWELS
    if len(w) == 2:
        return w[0] in v and w[1] not in v
    return len(w) > 2 and w[-3] not in v and w[-2] in v and w[-1] not in v and w[-1] not in "wxY"


def english(w: str) -> str:
    """The stem of an English word in lower case."""
    if len(w) < 3:
        return w
    if w in EN_WORDS:
        return EN_WORDS[w]
    w = w.lstrip("'")
    if "y" in w:
        letters = list(w)
        for i, c in enumerate(letters):
            if c == "y" and (i == 0 or letters[i - 1] in EN_VOWELS):
                letters[i] = "Y"
        w = "".join(letters)
    begins = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(begins) if begins else _after(w, 0, EN_MET)
    r2 = _after(w, r1, EN_MET)
    spoken = lambda x: not EN_VOWELS.isdisjoint(x)

    if end := _ending(w, EN_POSSESSIVES):
        w = w[: -len(end)]
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and spoken(w[:-2]):
        w = w[:-1]
    if w in EN_WHOLE:
        return w

    end = _ending(w, EN_PAST)
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and spoken(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
            w = w[:-1]
        elif r1 >= len(w) and _short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in EN_VOWELS:
        w = w[:-1] + "i"

    end = _ending(w, EN_SECONDS)
    if end and len(w) - len(end) >= r1:
        rest = w[: -len(end)]
        if (end != "ogi" or rest.endswith("l")) and (end != "li" or rest[-1:] in tuple("cdeghkmnrt")):
            w = rest + EN_SECOND[end]
    end = _ending(w, EN_THIRDS)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + EN_THIRD[end]
    end = _ending(w, EN_FOURTHS)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _french_marks(w: str) -> str:
    """w with capitals for u, i and y that don't count as vowels; ë and ï as H and a letter."""
    if not FR_MARKED.search(w):
        return w
    out = list(w.replace("ë", "He").replace("ï", "Hi"))
    vowel = lambda i: 0 <= i < len(out) and out[i] in FR_VOWELS
    for i, c in enumerate(out):
        if (c in "ui" and vowel(i - 1) and vowel(i + 1)) or (c == "y" and (vowel(i - 1) or vowel(i + 1))) or (c == "u" and i and out[i - 1] == "q"):
            out[i] = c.upper()
    return "".join(out)


def french(w: str) -> str:
    """The stem of a French word in lower case."""
    w = _french_marks(w)
    if w[:3] in ("par", "col", "tap") or (len(w) > 2 and w[0] in FR_VOWELS and w[1] in FR_VOWELS):
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in FR_VOWELS), len(w))
    r1 = _after(w, 0, FR_MET)
    r2 = _after(w, r1, FR_MET)
    changed, verbs = w, True
    done = _french_nouns(w, rv, r1, r2)
    if done is not None:
        changed, verbs = done
    if verbs:
        end = _ending(changed[rv:], FR_I_ENDINGS)
        at = len(changed) - len(end) if end else 0
        if end and at > rv and changed[at - 1] not in FR_VOWELS and changed[at - 1] != "H":
            changed = changed[:at]
        else:
            changed = _french_verbs(changed, rv, r2)
    if changed != w:
        changed = changed[:-1] + {"Y": "i", "ç": "c"}.get(changed[-1:], changed[-1:])
    else:
        changed = _french_rest(changed, rv, r2)
    if changed.endswith(("enn", "onn", "ett", "ell", "eill")):
        changed = changed[:-1]
    i = len(changed)
    while i and changed[i - 1] not in FR_VOWELS:
        i -= 1
    if i and i < len(changed) and changed[i - 1] in "éè":
        changed = changed[: i - 1] + "e" + changed[i:]
    return (changed.replace("He", "ë").replace("Hi", "ï").replace("H", "") if "H" in changed else changed).lower()


def _french_nouns(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool] | None:
    """(w without an ending of nouns, adjectives or adverbs, whether endings of verbs may follow), or None if there is none to take."""
    end = _ending(w, FR_ALL_NOUNS)
    if end is None:
        return None
    at = len(w) - len(end)
    rest = w[:at]

    def drop(x: str, tail: str, other: str | None = None) -> str:
        """x without tail where that stands in the second region, else with other in its place."""
        if not x.endswith(tail):
            return x
        head = x[: -len(tail)]
        return head if len(head) >= r2 else x if other is None else head + other

    if end in FR_GONE:
        return (rest, False) if at >= r2 else None
    if end in FR_AGENT:
        return (drop(rest, "ic", "iqU"), False) if at >= r2 else None
    if end in FR_NOUNS:
        return (rest + FR_NOUNS[end], False) if at >= r2 else None
    if end in ("ement", "ements"):
        if at < rv:
            return None
        if rest.endswith("iv"):
            out = drop(rest, "iv")
            return (drop(out, "at") if out != rest else out), False
        if rest.endswith("eus"):
            return (rest[:-3] if at - 3 >= r2 else rest[:-3] + "eux" if at - 3 >= r1 else rest), False
        if rest.endswith(("abl", "iqU")):
            return (rest[:-3] if at - 3 >= r2 else rest), False
        if rest.endswith(("ièr", "Ièr")) and at - 3 >= rv:
            return rest[:-3] + "i", False
        return rest, False
    if end in ("ité", "ités"):
        if at < r2:
            return None
        if rest.endswith("abil"):
            return drop(rest, "abil", "abl"), False
        return (drop(rest, "ic", "iqU") if rest.endswith("ic") else drop(rest, "iv")), False
    if end in ("if", "ive", "ifs", "ives"):
        if at < r2:
            return None
        out = drop(rest, "at")
        return (drop(out, "ic", "iqU") if out != rest else out), False
    if end == "eaux":
        return rest + "eau", False
    if end == "aux":
        return (rest + "al", False) if at >= r1 else None
    if end in ("euse", "euses"):
        return (rest, False) if at >= r2 else (rest + "eux", False) if at >= r1 else None
    if end in ("issement", "issements"):
        return (rest, False) if at >= r1 and rest[-1:] not in FR_VOWELS else None
    if end in ("amment", "emment"):
        return (rest + ("ant" if end[0] == "a" else "ent"), True) if at >= rv else None
    return (rest, True) if at > rv and rest[-1] in FR_VOWELS else None


def _french_verbs(w: str, rv: int, r2: int) -> str:
    end = _ending(w[rv:], FR_VERBS)
    if end is None:
        return w
    rest = w[: -len(end)]
    if end == "ions":
        return rest if len(rest) >= r2 else w
    return rest[:-1] if end in FR_A_VERBS and rest.endswith("e") and len(rest) > rv else rest


def _french_rest(w: str, rv: int, r2: int) -> str:
    if w.endswith("s") and len(w) > 1 and (w[-3:-1] == "Hi" or w[-2] not in "aiouès"):
        w = w[:-1]
    end = _ending(w[rv:], FR_RESTS)
    if end is None:
        return w
    rest = w[: -len(end)]
    if end == "ion":
        return rest if len(rest) >= r2 and len(rest) > rv and rest[-1:] in ("s", "t") else w
    return rest if end == "e" else rest + "i"


@lru_cache(maxsize=200_000)
def stem(w: str, language: str) -> str:
    """The stem of a word in lower case by language (en, fr; simple: the word itself), remembered for the worker's next batches."""
    return english(w) if language == "en" else french(w) if language == "fr" else w
