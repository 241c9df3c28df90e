from datetime import datetime

from pyspark.sql import functions as F

from brindle.functions import extract as X
from brindle.operators import board as B
from brindle.operators import entities as E
from brindle.operators import relational

NOW = datetime(2026, 3, 1, 12)


def test_parameters():
    got = B.parse({"page": ["0"], "sortBy": ["match-desc"], "activity": ["1y"], "sector": [" old ", "new", "", "x"]}, False, {"old": "new"})
    assert got == {"page": 1, "search": "", "eligible_only": True, "sort": "org-asc", "activity": "all", "days": None, "sectors": ["new", "x"]}
    got = B.parse({"page": ["3x"], "activity": ["90d"], "all": ["true"], "q": ["a"]}, True)
    assert (got["page"], got["days"], got["sort"], got["eligible_only"], got["search"]) == (3, 90, "value-match-desc", False, "a")
    assert B.expand_ids(["old", " "], {"old": "new", "older": "new"}) == ["new", "old", "older"] and B.expand_ids(["x"], {}) == ["x"]


def test_pages_and_nulls(spark):
    rows = [(i, f"2026-02-{i % 28 + 1:02d}", "remote" if i % 2 else None, None if i % 3 else "Laval", " ", True, True, None if i == 5 else i * 100, "YEAR", None, None, None, None, "o") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, posted string, work_type string, city string, source string, is_eligible boolean, has_pay boolean, min_value long, unit_text string, hours_per_week int, match_score double, value_score double, skill_score double, organization string")
    f = B.Filters(selected={"work_type": ["remote"]}, places={"city": ["Laval"]})
    assert {r.id for r in df.where(B.condition(f, NOW)).collect()} == {i for i in range(40) if i % 2}
    assert df.where(B.condition(B.Filters(selected={"work_type": ["office"]}), NOW)).count() == 0
    assert df.where(B.condition(B.Filters(sources=["A"]), NOW)).count() == 0
    for annual in (False, True):
        for sort in ("salary-desc", "salary-asc"):
            got = B.board_page(df, B.Filters(), NOW, sort, 1, 1000, annual).collect()
            assert got[-1].id == 5 and len(got) == 38  # two are older than the ceiling, as texts compare
    assert B.board_page(df, B.Filters(), NOW, "?", 5000, 0).count() == 0
    assert B.board_page(df.limit(0), B.Filters(), NOW, "org-asc").count() == 0


def test_conditions_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "'2026-02-10' as posted", "'a' as work_type", "'b' as source", "true as is_eligible", "true as has_pay").write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(B.condition(B.Filters(eligible_only=False, paid_only=False), NOW))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(posted" in plan


def test_hydration_keeps_order(spark):
    ids = spark.createDataFrame([(3, 0), (1, 1), (9, 2), (3, 3)], "id long, place long")
    assert [r.id for r in B.hydrate(ids, spark.range(5), "id", "place").collect()] == [3, 1]


def test_identities(spark):
    urls = {
        "https://wildlife.panierdachat.app": ("wildlife.panierdachat.app", "marketplace"), "https://www.facebook.com/Wild.ca?x=1": ("facebook.com/wild.ca", "social_media"),
        "careers.hatch.com": ("hatch.com", "employer_owned"), "http://user@a.b.example.org:80/": ("example.org", "employer_owned"), "https://canada.gc.ca": ("canada.gc.ca", "employer_owned"),
        "https://wix.com": (None, "unknown"), "": (None, "unknown"), None: (None, "unknown"), "http://...": (None, "unknown"),
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = {r.u: (r.i, r.k) for r in df.select("u", E.identity(F.col("u")).alias("i"), E.identity_kind(E.identity(F.col("u"))).alias("k")).collect()}
    assert got == urls


def test_clusters_of_few_rows(spark):
    schema = "id long, name string, city string, province string, location string, website string, jobs long"
    rows = [
        (1, "Community-University Television", None, None, None, "https://cutv.org", 1), (2, "Community University Television Montréal", "Montréal", "QC", None, None, 5),
        (3, "Roots & Shoots", None, None, None, "https://a.org", 0), (4, "Roots and Shoots", None, None, None, "https://b.org", 0),
        (5, "ABC", None, None, None, "https://abc.org", 0), (6, "A.B.C.", None, None, None, "https://abc.org", 0), (7, "abc", None, None, None, "https://abc.org", 0),
        (8, "Same Name", None, None, None, "https://x.org", 0), (9, "Same  name", None, None, None, "https://jobs.x.org", 9), (10, None, None, None, None, None, 0), (11, "!!", None, None, None, None, 0),
    ]
    got = {r.cluster: (r.label, r.n, r.survivor, r.bucket) for r in E.organization_clusters(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("community university television", 2, 1, "review"), 5: ("abc", 2, 5, "review"), 8: ("same name", 2, 9, "merge")}
    assert E.organization_clusters(spark.createDataFrame([], schema)).count() == 0


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    for text, want in {
        "Salary: $50,000 - $60,000": "$50,000 - $60,000", "Wage: $25/hr": "$25", "Salaire : 25,63 $": "25,63 $", "Rémunération : 26.28$ à 28.15$": "26.28$ à 28.15$",
        "Salaire à partir de 75 000$": "75 000$", "28$ de l'heure": "28$", "$50,000 - $60,000 annual": "$50,000 - $60,000", "we pay well": None, "": None,
    }.items():
        assert one(X.pay_text(lit(text))) == want, text
    for text, want in {
        "Part-time role with a path to full-time": "part-time", "international internal team": None, "may become a contract position": None, "Full time, permanent": "full-time",
        "possibility of becoming a full-time contract position. Casual work": "casual", "temp": "temporary", "": None,
    }.items():
        assert one(X.employment_kind(lit(text))) == want, text
    assert one(X.middle_cut(lit("abcdefghij"), 5)) == "ab…ij" and one(X.middle_cut(lit("abc"), 5)) == "abc"
    assert one(X.sentence_cut(lit("One. Two three"), 9)) == "One." and one(X.sentence_cut(lit("abcdefgh"), 6)) == "abc..."
    assert one(X.looks_empty(lit(None).cast("string"))) and one(X.json_kind(lit("{oops"), "k")) is None
    assert one(X.json_put(lit(None).cast("string"), {"a": lit(1)})) == '{"a":"1"}'
    assert one(X.wish_score(lit(None).cast("string"), lit("x"))) is None


def test_report_lines(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "r string")
    assert [tuple(r) for r in relational.reason_lines(df, "r").collect()] == [("a", 2, "a × 2")]


def test_selectors():
    from brindle.sources import selectors as S

    page = '<div class="job big"><h2 id=t>Clerk &amp; <b>Boss</b></h2><a rel=next href="/2">More</a><p>One<p class=pay>20 $</div><h2>Other</h2><![x[><p data-k="v">last'
    asked = {"h2": "Clerk & Boss", ".job.big h2#t": "Clerk & Boss", "a[rel=next]@href": "/2", "div .pay": "20 $", "h2 p": None, "p[data-k='v']": "last", "img@src": None, "* b": "Boss"}
    assert S.fields(page, [S.parse(s) for s in asked]) == list(asked.values())
    assert S.fields(None, [S.parse("p")]) == [None]


def test_guards(spark):
    from brindle.operators import upkeep

    rows = [("a", p, k) for p, ks in enumerate(["xy", "yz", "xx", "yx", "n"]) for k in ks] + [("b", 0, None), ("b", 1, "q")]
    df = spark.createDataFrame(rows, "run string, page long, key string")
    assert {tuple(r) for r in upkeep.page_guard(df, "run", "page", "key").collect()} == {("a", 0, "x"), ("a", 0, "y"), ("a", 1, "z"), ("b", 1, "q")}
    steps = spark.createDataFrame([("a", i, c) for i, c in enumerate(["c1", "c2", "c1", "c3"])] + [("b", 0, None), ("b", 1, "c")], "run string, step long, cursor string")
    assert {(r.run, r.step) for r in upkeep.cursor_guard(steps, "run", "step", "cursor").collect()} == {("a", 0), ("a", 1), ("a", 2), ("b", 0)}
    assert upkeep.page_guard(df.limit(0), "run", "page", "key").count() == 0


def test_hosts_are_worked_out_once(spark):
    """However often an expression refers to a URL's host, its patterns run once a row."""
    df = spark.createDataFrame([("https://www.a.org/x",)], "u string")
    for made, most in ((E.identity, 2), (E.evidence, 1), (lambda u: E.apex(E.evidence(u)), 1), (lambda u: E.identity_kind(E.identity(u)), 2), (lambda u: E.platform(E.identity(u)), 2)):
        plan = df.select(made(F.col("u")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= plan.count("regexp_extract(") <= most


ORGS = "id long, name string, city string, province string, location string, website string, jobs long"


def test_joins_of_organizations_read_what_was_worked_out(spark):
    """What sites say isn't worked out anew for each of the joins."""
    orgs = spark.createDataFrame([(1, "A b", "Laval", "QC", "Laval", "https://a.org", 1), (2, "A b Laval", "Laval", "QC", "Laval", "a.org", 0)], ORGS)
    known = orgs.select(F.col("id").alias("org"), "name", F.lit(None).cast("array<string>").alias("aliases"), "website", "location")
    for df in (E.organization_edges(orgs), E.resolve(orgs, known)):
        assert df.count() and "regexp_extract" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_by_name_and_site(spark):
    """A candidate that both name and site give counts by its name; one of the name with another site closes nothing; equal scores go to the smallest id."""
    posts = spark.createDataFrame(
        [(1, "Oak", None, None, None, "https://oak.org", 0), (2, "Oak", "Laval", "QC", None, None, 0), (3, "Oak", None, None, None, "https://elm.org", 0), (4, None, None, None, None, "oak.org", 0), (5, "Fir", None, None, None, None, 0)], ORGS
    )
    known = spark.createDataFrame(
        [(7, "OAK", ["Oak"], "http://www.oak.org/x", "Laval QC"), (8, "Pine", ["oak!"], None, None), (9, "Oak Trust", None, "jobs.oak.org", "Laval")], "org long, name string, aliases array<string>, website string, location string"
    )
    got = {r.id: (r.org, r.score, r.decision) for r in E.resolve(posts, known).collect()}
    assert got == {1: (7, 150, "merge"), 2: (7, 65, "block"), 3: (8, 50, "block"), 4: (7, 0, "create"), 5: (None, None, "create")}
