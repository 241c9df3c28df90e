import corpus_pipeline
from brindle.llm import mixing, packing
from brindle.sources.tables import materialize, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), f"test-{name}")
        counts.append(docs.count())
        assert docs.columns == columns or name == "packing"
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2]
    assert docs.columns[:3] == [c.split()[0] for c in packing.SCHEMA.split(", ")][:3]


def test_run_matches_stages(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "again")
    keys = ["doc_id", "start", "length", "ids", "doc_tokens"]
    assert sorted(map(str, got.select(*keys).collect())) == sorted(map(str, docs.select(*keys).collect()))


def test_emptied_copies_go(spark, sf):
    """Exact copies that lines empties leave with near_dedup, and the mixing's counts hold one row of them at most."""
    copy = "\n".join(f"line {i} of the copied document with words {i * 7} and {i * 11}" for i in range(12))
    own = [" ".join(f"word{i * 100 + j}" for j in range(80)) for i in range(20)]
    rows = [(i, copy, "en", "hot", len(copy)) for i in range(100)] + [(100 + i, t, "en", "hot", len(t)) for i, t in enumerate(own)]
    lines = materialize(corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), sf), "lines")
    assert lines.where("text = ''").count() == 99
    near = materialize(corpus_pipeline.near_dedup(spark, lines, sf), "near")
    assert sorted(r.doc_id for r in near.collect()) == [0, 1, *range(100, 120)]
    sizes = mixing.rates(near, mixing.WEIGHTS, mixing.OTHER, "source", None)
    assert [r["n"] for r in sizes.collect()] == [22]
    mixed = corpus_pipeline.mix_sources(spark, near, sf).collect()
    assert {r.doc_id for r in mixed} <= {0, 1, *range(100, 120)} and sum(not r.text for r in mixed) <= 8


def test_empty(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
