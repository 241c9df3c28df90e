import pytest

from brindle.functions import stems as S

ENGLISH = (
    "consign consign consigned consign consigning consign consignment consign consist consist consistency consist consistently consist consolation consol consolidate consolid"
    " consolingly consol conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirators conspir constables constabl constancy constanc constant constant"
    " kneeling kneel knightly knight knitted knit knives knive knocking knock knotted knot knowledge knowledg knuckle knuckl dying die generously generous communities communiti"
    " happy happi cries cri ties tie gas gas kiwis kiwi hopping hop hoping hope falling fall relational relat agreed agre news news proceed proceed say say by by early earli"
)
FRENCH = (
    "continu continu continua continu continuait continu continuant continu continuation continu continuel continuel continuelle continuel continuellement continuel"
    " continuité continu contour contour contournait contourn contraindre contraindr contraint contraint contraintes contraint contraire contrair contraires contrair"
    " contraria contrari main main maintenaient mainten maintenant mainten maintenir mainten maintien maintien majesté majest majestueuse majestu majestueusement majestu"
    " majestueux majestu majeur majeur major major majordome majordom majorité major malheureusement malheur chevaux cheval nouveaux nouveau constamment const"
)


@pytest.mark.parametrize(("language", "pairs"), [("en", ENGLISH), ("fr", FRENCH)])
def test_published_pairs(language, pairs):
    words = pairs.split()
    assert {w: S.stem(w, language) for w in words[::2]} == dict(zip(words[::2], words[1::2]))


def test_odd_words():
    for language in ("en", "fr", "simple"):
        for w in ("", "a", "y", "yy", "s", "ss", "'", "'s", "1990", "é", "iiii", "qu", "eed", "ing", "ement", "ions", "ë", "hï"):
            assert isinstance(S.stem(w, language), str)
    assert S.stem("libraries", "en") == S.stem("library", "en") and S.stem("libraries", "simple") == "libraries"
