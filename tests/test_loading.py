from pyspark.sql import functions as F

from brindle.operators import loading as L
from brindle.sources import feeds as S

LONG = "We look for someone who keeps the books, answers the phone and plans the yearly meeting of our members in town. "
SCHEMA = "id long, org string, title string, url string, posted string, body string, city string, province string, kind string, source string"


def test_save_status(spark):
    row = lambda i, url, **v: tuple((dict(id=i, org="a", title="Clerk", url=url, posted="2024-01-01", body=LONG * 2, city=None, province=None, kind=None, source="s") | v).values())
    stored = spark.createDataFrame([row(1, "https://x/1")], SCHEMA)
    new = [row(10, "https://x/1/"), row(11, "https://x/11"), row(12, None), row(13, "https://x/13", org="b"), row(14, "https://x/13", org="b"), row(15, "https://x/15", org="b"), row(16, "https://x/16", city="Boston, MA")]
    got = L.save_status(spark.createDataFrame(new, SCHEMA), stored, F.col("city").contains("MA"))
    want = {10: ("skipped", "known"), 11: ("skipped", "duplicate"), 12: ("skipped", "missing"), 13: ("added", None), 14: ("skipped", "repeated"), 15: ("skipped", "duplicate"), 16: ("skipped", "refused")}
    assert {r.id: (r.status, r.reason) for r in got.collect()} == want
    assert tuple(L.run_summary(got).first()) == (7, 1, 0, 6)


def test_save_status_compares_whole_texts(spark):
    """Postings that are equal for over 2,500 characters and then go apart are two."""
    row = lambda i, url, body: (i, "a", "Clerk", url, "2024-01-01", body, None, None, None, "s")
    head = " ".join(str(i * 7919) for i in range(500))
    one, other = (" ".join(str(i * k) for i in range(2000)) for k in (104729, 1299709))
    stored = spark.createDataFrame([row(1, "https://x/1", f"{head} {one}")], SCHEMA)
    new = spark.createDataFrame([row(2, "https://x/2", f"{head} {other}"), row(3, "https://x/3", f"{head} {one} and more")], SCHEMA)
    assert {r.id: (r.status, r.reason) for r in L.save_status(new, stored).collect()} == {2: ("added", None), 3: ("skipped", "duplicate")}


def test_bulk_update_and_backup(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 2.0), (3, None, None)], "k long, s string, v double")
    updates = spark.createDataFrame([('[{"k":1,"v":5},{"k":9,"v":1},{"k":2,"v":null}]',), ("oops",), (None,)], "p string")
    done = L.bulk_update(df, updates, "p", "k", "v:double")
    assert sorted(map(tuple, done.collect())) == [(1, "a", 5.0), (2, "b", 2.0), (3, None, None)]
    L.backup({"t": df}, str(tmp_path / "b"))
    back = L.restore(spark, str(tmp_path / "b"), {"t": df.schema}, generated=["v"])["t"]
    assert back.columns == ["k", "s"] and sorted(r.k for r in back.collect()) == [1, 2, 3]


def test_feeds(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "rss.xml").write_text("<rss><channel><item><title>A &amp; B</title><link>https://x/1</link><pubDate>Mon</pubDate></item><item><title> </title></item></channel></rss>")
    (tmp_path / "f" / "atom.xml").write_text('<feed><entry><title>C</title><link href="https://x/2"/><updated>2024</updated><summary>s</summary></entry></feed>')
    got = S.feed_entries(spark, str(tmp_path / "f"))
    assert sorted((r.title or "", r.url, r.published, r.body, r.uid) for r in got.collect()) == [("", None, None, None, None), ("A & B", "https://x/1", "Mon", None, "https://x/1"), ("C", "https://x/2", "2024", "s", "https://x/2")]
    chain = S.run_chain(got, {"titled": F.col("title").isNotNull(), "dated": F.length("published") > 3})
    assert sorted(str(r.dropped_by) for r in chain.collect()) == ["None", "dated", "titled"]
    for name, text in (("a", '[{"id":1}]'), ("b", '{"results":[{"id":2,"x":0},{"id":3}]}'), ("c", '{"other":[]}'), ("d", "not json")):
        (tmp_path / f"{name}.json").write_text(text)
    assert sorted(r.id for r in S.json_records(spark, str(tmp_path / "*.json"), "id:long").collect()) == [1, 2, 3]
