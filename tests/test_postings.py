import itertools
import random
import re
from datetime import date, timedelta
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import sequences
from brindle.operators import postings as P

SCHEMA = "id long, org string, title string, url string, posted string, body string, city string, province string, kind string, source string"
LONG = "We look for someone who keeps the books, answers the phone and plans the yearly meeting of our members in town. "


def words(title):
    out = set()
    for w in re.sub(r"[^a-z0-9]+", " ", title.lower()).split():
        if w in P.STOP:
            continue
        w = w[:-3] if len(w) > 5 and w.endswith("new") else w
        w = w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w
        if w and w not in P.STOP:
            out.add(w)
    return out


def linked(a, b):
    wa, wb = words(a["title"] or ""), words(b["title"] or "")
    if a["org"] is None or a["org"] != b["org"] or not a["url"] or not b["url"] or a["url"] == b["url"] or not wa or not wb or (wa ^ wb) - set(P.FLUFF):
        return False
    if a["posted"] and b["posted"] and abs((date.fromisoformat(a["posted"]) - date.fromisoformat(b["posted"])).days) > 21:
        return False
    alike = len(wa & wb) / len(wa | wb)
    order = SequenceMatcher(None, " ".join(sorted(wa)), " ".join(sorted(wb))).ratio()
    x, y = ((r["body"] or "").lower()[:2500] for r in (a, b))
    x, y = " ".join(x.split()), " ".join(y.split())
    ratio = SequenceMatcher(None, x, y).ratio() if min(len(x), len(y)) >= 80 else 0
    if a["city"] and b["city"] and a["city"].lower() != b["city"].lower() and ratio < 0.55:
        return False
    return alike >= 0.7 or order >= 0.85 or (alike >= 0.5 and ratio >= 0.55) or (order >= 0.7 and ratio >= 0.6)


def brute(rows):
    root = {r["id"]: r["id"] for r in rows}
    for a, b in itertools.combinations(rows, 2):
        if linked(a, b):
            x, y = sorted((root[a["id"]], root[b["id"]]))
            root = {k: x if v == y else v for k, v in root.items()}
    groups = {}
    for k, v in root.items():
        groups.setdefault(v, []).append(k)
    return {k: min(g) for g in groups.values() if len(g) > 1 for k in g}


def rows_of_many_kinds():
    titles = ["Board Directors (volunteer)", "Board of Director", "CoordinatorNew", "Coordinator", "Coordinator volunteer full part time", "Treasurer", "the of", None]
    bodies = [LONG * 3, LONG * 2 + "Other words stand here instead of the rest. " * 4, "short", None, "x y z " * 60]
    out = []
    for i in range(120):
        day = None if i % 11 == 0 else f"2024-0{1 + i % 5}-{1 + i * 7 % 28:02d}"
        out.append((i, ["a", "b", None][i % 17 % 3], titles[i % 8], f"https://h/{i}" if i % 23 else None, day, bodies[i * 3 % 5], ["Ottawa", "ottawa", "Laval", None][i // 3 % 4], "ON", None, "s"))
    return out


def test_clusters_against_brute_force(spark):
    raw = rows_of_many_kinds()
    df = spark.createDataFrame(raw, SCHEMA)
    got = P.clusters(df.withColumn("extra", F.lit(1)))
    names = df.columns
    assert {r.id: r.cluster for r in got.collect()} == brute([dict(zip(names, r)) for r in raw])
    assert P.clusters(df.limit(0)).count() == 0


def test_roles(spark):
    df = spark.createDataFrame([("Environmental CoordinatorNew", "coordinator environmental"), ("The Boss of Directors", "boss director"), (None, "")], "t string, w string")
    assert all(r.got == r.w for r in df.select("w", F.array_join(P.role_tokens(F.col("t")), " ").alias("got")).collect())
    hosts = spark.createDataFrame([("https://ca.indeed.com/x",), ("http://www.indeed.ca",), ("https://jobs.example.org/1",), (None,)], "u string")
    assert [r[0] for r in hosts.select(P.board(F.col("u"))).collect()] == ["indeed.com", "indeed.com", "jobs.example.org", None]


def test_confident(spark):
    base = (1, "a", "Clerk", "https://x.org/1", "2024-01-01", LONG * 2, "Ottawa", "ON", None, "s")
    known = spark.createDataFrame([base], SCHEMA)

    def change(i, **values):
        r = dict(zip(known.columns, base)) | {"id": i, "url": f"https://x.org/{i}"} | values
        return tuple(r[c] for c in known.columns)

    new = [change(2), change(3, city="Laval"), change(4, posted="2024-03-01"), change(5, body=LONG * 2 + "Work 30 hours."), change(6, title="Treasurer"), change(7, body=None), change(8, city=None),
           change(9, province="Ontario"), change(10, province="somewhere"), change(11, url="https://x.org/1/"), change(12, posted=None, body="<b>" + LONG * 2 + "</b>")]
    got = P.confident_duplicates(spark.createDataFrame(new, SCHEMA), known)
    assert {r.id: r.duplicate_of for r in got.collect()} == dict.fromkeys([2, 5, 8, 9, 12], 1)


def test_confident_against_brute_force(spark):
    def sure(a, b):
        wa, wb = words(a["title"] or ""), words(b["title"] or "")
        if a["org"] is None or a["org"] != b["org"] or not a["url"] or not b["url"] or a["url"] == b["url"] or not wa or not wb or (wa ^ wb) - set(P.FLUFF):
            return False
        if a["posted"] and b["posted"] and abs((date.fromisoformat(a["posted"]) - date.fromisoformat(b["posted"])).days) > 21:
            return False
        if len(wa & wb) / len(wa | wb) < 0.7 and SequenceMatcher(None, " ".join(sorted(wa)), " ".join(sorted(wb))).ratio() < 0.85:
            return False
        if a["city"] and b["city"] and a["city"].lower() != b["city"].lower():
            return False
        x, y = (" ".join((r["body"] or "").lower().split()) for r in (a, b))
        return min(len(x), len(y)) >= 80 and SequenceMatcher(None, x, y).ratio() >= 0.9

    raw = [r[:3] + (f"https://h/{r[0] // 2}" if r[3] else None,) + r[4:] for r in rows_of_many_kinds()]
    df = spark.createDataFrame(raw, SCHEMA)
    rows = [dict(zip(df.columns, r)) for r in raw]
    want = {}
    for b, a in itertools.combinations(rows, 2):
        if sure(a, b):
            want.setdefault(a["id"], b["id"])
    assert len(want) > 10
    want = {a: min(b["id"] for b in rows if b["id"] < a and sure(rows[a], b)) for a in want}
    assert {r.id: r.duplicate_of for r in P.confident_duplicates(df, df, earlier=True).collect()} == want


def test_keeper(spark):
    """A full body, then values, summary, length, and the latest; ties to the smallest id."""
    rows = [(1, LONG * 3, None, "", "2024"), (2, LONG * 2, ["a"], None, "2024"), (3, LONG * 2, ["a"], "s", "2024"), (4, LONG * 2, ["a"], "s", "2025"), (5, LONG * 2, ["a"], "s", "2025"), (6, "x", ["a"], "s", "2026")]
    df = spark.createDataFrame(rows, "id long, body string, values array<string>, summary string, scraped string").selectExpr(
        "*", "'a' as org", "'Clerk' as title", "concat('https://h/', id) as url", "'2024-01-01' as posted", "null as city", "null as province", "null as kind", "null as source")
    assert {(r.cluster, r.keeper, r.n) for r in P.clusters(df).collect()} == {(1, 4, 6)}
    assert {(r.cluster, r.keeper, r.n) for r in P.clusters(df.drop("values", "summary", "scraped")).collect()} == {(1, 1, 6)}


def test_days_alone_make_no_pairs(spark, monkeypatch):
    """One role with one text on many days: contents are compared once, and classes are chained from day to day."""
    seen = []
    monkeypatch.setattr(P, "_titled", lambda pairs, f=P._titled: seen.append(pairs.count()) or f(pairs))
    rows = [(i, "o", "Head clerk", f"https://h/{i}", str(date(2024, 1, 1) + timedelta(days=i * 2 if i < 40 else 200 + i)), "x" * 200, None, None, None, "s") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, org string, title string, url string, posted string, body string, city string, province string, kind string, source string")
    found = {r.id: r.duplicate_of for r in P.confident_duplicates(df, df, earlier=True).collect()}
    assert found == {i: max(0, i - 10) if i < 40 else 40 for i in range(60) if i not in (0, 40)}
    assert {(r.id, r.cluster, r.n) for r in P.clusters(df).collect()} == {(i, 0, 40) if i < 40 else (i, 40, 20) for i in range(60)}
    assert max(seen) <= 60, seen


def _texts(seed, n):
    """Texts of two languages' letters and of many signs, each with edited, turned and repeated copies."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice(["th", "he", "in", "er", "q", "zx", "k", "é", "ou", ".", "0", "the", "jj"]) for _ in range(draw.randint(1, 4)))
    out = []
    for _ in range(n):
        a = [word() for _ in range(draw.choice([0, 3, 30, 100, 300]))] if draw.random() < 0.7 else [chr(0x4E00 + int(draw.paretovariate(0.5)) % 400) for _ in range(300)]
        b = [x for w in a for x in ([w] if draw.random() > 0.05 else [word(), w] if draw.random() < 0.5 else [])]
        cut = draw.randrange(len(b) + 1)
        out += [" ".join(x) for x in (a, b, b[cut:] + b[:cut], (a * 3)[: len(a) * 2])]
    return out


def test_ratio_is_difflibs():
    texts = _texts(1, 12)
    for a, b in itertools.product(texts, texts):
        want = 1.0 if a == b else SequenceMatcher(None, a, b).ratio()
        assert sequences.ratio(a, b) == want
        for need in (0.55, 0.7, 0.9):
            assert sequences.ratio(a, b, need) == (want if want >= need else None)


def test_bounds_lose_nothing():
    texts = _texts(2, 40)
    a, b = sequences.Block(texts[::2]), sequences.Block(texts[1::2])
    for need in (0.3, 0.7, 0.9):
        asked = np.full((len(a.texts), len(b.texts)), need)
        there, back = sequences.possible(a, b, (asked, asked.T), True)
        (own,) = sequences.possible(a, a, asked)
        for i, j in itertools.product(range(0, len(a.texts), 3), range(len(b.texts))):
            x, y, z = a.texts[i], b.texts[j], a.texts[j]
            assert there[i, j] or sequences.ratio(x, y, need) is None
            assert back[j, i] or sequences.ratio(y, x, need) is None
            assert own[i, j] or sequences.ratio(x, z, need) is None
    assert 0 < there.mean() < 0.2


def test_whole_texts_decide(spark):
    """Texts that part after 2,500 characters are unlike, texts of which only the beginnings are unlike are alike."""
    draw = random.Random(5)
    word = lambda i: "".join(draw.choices("abcdefghijklmnopqrst", k=draw.randint(2, 9))) + draw.choice("uvwxyz0123456789") * (i % 9 == 0)
    text, other = ([word(i) for i in range(4000)] for _ in range(2))
    assert len(" ".join(text[:450])) > 2500
    bodies = [text, text[:450] + other[450:], [word(i) if i < 450 and i % 9 in (3, 5) else w for i, w in enumerate(text)]]
    rows = [(i, "a", "Clerk", f"https://x.org/{i}", "2024-01-01", " ".join(body), None, None, None, "s") for i, body in enumerate(bodies)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.id: r.duplicate_of for r in P.confident_duplicates(df, df, earlier=True).collect()} == {2: 0}


@pytest.mark.parametrize("earlier", [True, False])
def test_texts_in_blocks_against_brute_force(spark, monkeypatch, earlier):
    """Blocks of a few texts each; boards, cities, days, URLs and copies differ, and known postings need not be new."""
    monkeypatch.setattr(P, "ROWS", 8)
    monkeypatch.setattr(P, "CHARS", 8000)
    draw = random.Random(7)
    bodies = [t for t in _texts(3, 15) if len(t) > 200]
    make = lambda i: (i, "a", draw.choice(["Head clerk", "Clerks of the head"]), f"https://x.org/{i * 4 // 5}", str(date(2024, 1, 1) + timedelta(days=draw.randrange(60))) if i % 9 else None, bodies[i % len(bodies)],
                      draw.choice(["Ottawa", "Laval", None]), draw.choice(["ON", "ON", "somewhere", None]), draw.choice([None, None, "full"]), draw.choice(["s", "t", None]))
    raw = [make(i) for i in range(150)]
    df = spark.createDataFrame(raw, SCHEMA)
    known = df.where("id % 3 > 0")
    rows = [dict(zip(df.columns, r)) for r in raw]
    plain = [re.sub(r"\s+", " ", r["body"]).strip() for r in rows]

    def sure(a, b):
        if a["url"] == b["url"] or a["posted"] and b["posted"] and abs((date.fromisoformat(a["posted"]) - date.fromisoformat(b["posted"])).days) > 21 or a["kind"] and b["kind"] and a["kind"] != b["kind"]:
            return False
        vague = "somewhere" in (a["province"], b["province"])
        same = a["city"] and a["city"] == b["city"] and not vague
        if a["city"] and b["city"] and not same:
            return False
        x, y = plain[a["id"]], plain[b["id"]]
        cross = a["source"] and b["source"] and a["source"] != b["source"]
        return x == y or SequenceMatcher(None, x, y).ratio() >= (0.7 if same and cross else 0.9)

    want = {}
    for a, b in itertools.product(rows, rows):
        if b["id"] % 3 and (b["id"] < a["id"] or not earlier) and a["id"] not in want and sure(a, b):
            want[a["id"]] = b["id"]
    assert len(set(want.values())) > 10
    assert {r.id: r.duplicate_of for r in P.confident_duplicates(df, known, earlier=earlier).collect()} == want
    there = {a["id"] for a, b in itertools.product(rows, rows) if (b["id"] % 3 or b["id"] < a["id"]) and sure(a, b)}
    assert {r.id for r in P.surely_there(df, known).collect()} == there
