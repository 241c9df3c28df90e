"""Corpus operators against brute force, exact round trips, and odd inputs."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from brindle.llm import ann, audio, chat, html_extract, mixing, packing, quality, queries, simhash, tokens, vocab, winnow
from brindle.sources.tables import materialize, table

DOC = "doc_id long, text string, source string, lang string, n_chars long, score string, n int"
ODD = [
    (1, None, "a", "en", 0, "s", 1), (2, "", None, "en", 0, "s", 1), (None, "one two three", "a", None, 13, None, 2),
    (3, "word " * 60_000, "a", "en", 1, "s", 1), (4, "same text here now", "b", "en", 1, "s", 1),
    (4, "same text here now", "b", "en", 1, "s", 1), (5, "é　字 \n \n<b>&amp;|", "b", "fr", 1, "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents").cache()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("limit", [4, 2048])
def test_simhash(docs, limit):
    text = {r.doc_id: r.text for r in docs.collect()}
    fp = {i: slow_fingerprint(t) for i, t in text.items()}
    want = roots(sorted(fp), [(a, b) for a, b in combinations(sorted(fp), 2) if (fp[a] ^ fp[b]).bit_count() <= 2])
    got = simhash.near_duplicates(docs, group_limit=limit).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_gray_index_finds_all_links():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    codes = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for _ in range(12)]))
    want = roots(range(len(codes)), [(a, b) for a, b in combinations(range(len(codes)), 2) if int(codes[a] ^ codes[b]).bit_count() <= 2])
    assert simhash.GrayIndex(codes, np.zeros(len(codes), int)).roots(2).tolist() == [want[i] for i in range(len(codes))]


def test_simhash_odd(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def similarities(texts):
    """Exact Jaccard similarities of five-word shingles of all pairs that share one; texts: id -> text."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() if (w := words(t))}
    held = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            held[x].add(i)
    near = {p for ids in held.values() for p in combinations(sorted(ids), 2)}
    return {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in near}


def hold_groups(got, texts):
    """Groups (id -> group) join nothing that pairs of 0.8 and more don't, and 0.9 and more of these pairs share one."""
    alike = similarities(texts)
    pairs = [p for p, s in alike.items() if s >= 0.8 and texts[p[0]] != texts[p[1]]]
    allowed = roots(sorted(texts), [p for p, s in alike.items() if s >= 0.8])
    first = {}
    for i, g in got.items():
        if i in allowed and words(texts[i]):
            assert allowed[first.setdefault(g, i)] == allowed[i], (i, first[g])
    assert all(got[a] == got[b] for (a, b), s in alike.items() if s == 1)
    return sum(got[a] == got[b] for a, b in pairs), len(pairs)


@pytest.mark.parametrize("after_lines", [False, True])
def test_groups_by_exact_similarity(spark, after_lines):
    """Before and after line dedup: 0.9 and more of the pairs of 0.8 and more are found, and no pair under 0.8 links."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    if after_lines:
        docs = materialize(winnow.dedup_lines(docs), "lines")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = {r.doc: r.group for r in simhash.similar_groups(docs).collect()}
    found, total = hold_groups(got, texts)
    assert found >= 0.9 * total, (found, total)


def test_edited_copies(spark):
    """Pairs at and around 0.8, made by edits: recall of 0.9, and none under 0.8."""
    rng = np.random.default_rng(12)
    texts = {}
    for i in range(300):
        w = [f"w{k}" for k in rng.integers(0, 10**9, int(rng.integers(40, 400)))]
        v = list(w)
        for k in rng.choice(len(v), max(1, round(len(v) * rng.uniform(0.005, 0.035))), replace=False):
            v[k] = f"x{i}-{k}"
        texts[2 * i], texts[2 * i + 1] = " ".join(w), " ".join(v)
    alike = similarities(texts)
    assert sum(0.8 <= s < 0.85 for s in alike.values()) > 25 and sum(0.7 <= s < 0.8 for s in alike.values()) > 25
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    found, total = hold_groups({r.doc: r.group for r in simhash.similar_groups(docs).collect()}, texts)
    assert found >= 0.95 * total, (found, total)
    # one of each group stays, the smallest id
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert {i for i in texts if i % 2 == 0} <= kept and len(kept) >= 300


@pytest.mark.parametrize("limit", [100, 8192])
def test_large_groups_lose_no_pair(spark, monkeypatch, limit):
    """Any two that share a table's key meet, in groups larger than a search and a task; brute force over the keys."""
    table_ = [0, 70, 140, 210]
    monkeypatch.setattr(simhash, "table_bits", lambda *_: [table_])
    common = [f"line{i}" for i in range(60)]
    texts = [" ".join([*common[: 60 - i % 7 * 5], *(f"w{i // 2 * 31 + j}" for j in range(40)), *([] if i % 2 else ["end"])]) for i in range(1500)]
    codes = np.array([simhash.fingerprint_words(simhash.rolled_hashes(t, 5), 16) for t in texts])
    keys = np.array([[int(x[b // 64]) >> b % 64 & 1 for b in table_] for x in codes])
    fine, loose = simhash.wide_radius(0.8, 16, 3), simhash.wide_radius(0.8, 2, 3)
    any_ = [p for p, s in similarities(dict(enumerate(texts))).items() if s >= 0.8]
    sure = []
    for i, j in any_:
        met = (keys[i] == keys[j]).all() and simhash.popcount((codes[i, :2] ^ codes[j, :2])[None])[0] <= loose
        sure += [(i, j)] if met and simhash.popcount((codes[i] ^ codes[j])[None])[0] <= fine else []
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc: r.group for r in simhash.similar_groups(docs.repartition(3), group_limit=limit).collect()}
    assert len(got) == len(texts) and len(sure) > 200 and all(got[a] == got[b] for a, b in sure)
    whole = roots(range(len(texts)), any_)
    by = defaultdict(set)
    for i, g in got.items():
        by[g].add(whole[i])
    assert all(len(s) == 1 for s in by.values()) and len(by) < len(texts)


def test_a_crowded_key_is_searched_whole():
    """20,000 rows of one key, dealt to a task in many batches: planted pairs are found wherever they stand, and nothing else."""
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 1 << 63, (20_000, 2), dtype=np.uint64)
    left, right = rng.permutation(20_000)[:400].reshape(2, 200)
    codes[right] = codes[left]
    for k in range(200):
        for bit in rng.choice(128, 25, replace=False):
            codes[right[k], bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    x = pd.DataFrame({"key": 7, "part": 0, "node": np.arange(20_000), "w0": codes[:, 0].view(np.int64), "w1": codes[:, 1].view(np.int64)})
    links = pd.concat(simhash._search_wide((x[i : i + 1000] for i in range(0, 20_000, 1000)), simhash.wide_radius(0.8, 2, 3)))
    assert {frozenset(p) for p in zip(links.a, links.b)} == {frozenset(map(int, p)) for p in zip(left, right)}


def test_bits_differ_as_the_formula_says():
    """Shares of differing bits against exact similarities of five-word shingles."""
    rng = np.random.default_rng(9)
    for changed in (4, 8, 16):
        gaps = []
        for _ in range(60):
            w = [f"w{k}" for k in rng.integers(0, 10**9, 400)]
            v = list(w)
            for i in range(changed):
                v[i * 400 // changed + 5] = f"x{i}"
            a, b = ({tuple(x[k : k + 5]) for k in range(396)} for x in (w, v))
            s = len(a & b) / len(a | b)
            x, y = (simhash.fingerprint_words(simhash.rolled_hashes(" ".join(t), 5), 16) for t in (w, v))
            gaps.append(int(simhash.popcount((x ^ y)[None])[0]) / 1024 - simhash.differing_share(s))
        assert abs(np.mean(gaps)) < 0.01


def test_keep_one_odd(odd):
    got = simhash.keep_one(odd)
    assert got.columns == odd.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "3", "4", "5", "None"]
    assert simhash.keep_one(odd.limit(0)).count() == 0


def test_quality_held_out(spark, sf, docs):
    got = quality.classify(docs).join(table(spark, sf, "labels"), "doc_id").toPandas()
    assert got.keep[got.quality == 1].mean() > 0.97
    assert got.keep[got.quality == 0].mean() < 0.1


def test_label_model_learns_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(5000) < 0.7
    right = rng.random((5000, 4)) < np.array([0.95, 0.9, 0.85, 0.6])
    vote = np.where(right == truth[:, None], quality.GOOD, quality.BAD)
    patterns, at, counts = np.unique(vote @ 3 ** np.arange(4), return_inverse=True, return_counts=True)
    posterior = quality.fit_label_model(patterns, counts.astype(float), 4)
    assert ((posterior[at] > 0.5) == truth).mean() > 0.93


def test_varied_looks_at_every_word():
    """Neither words between others nor a phrase in step with the text's length change the vote."""
    phrase = [f"w{i}" for i in range(1000)]
    assert quality._varied(quality.facts(" ".join(phrase * 20))) == quality._varied(quality.facts(" ".join(sorted(phrase * 20))))
    rare = ["the" if i % 10 == 0 else f"w{i}" for i in range(20_000)]
    assert quality._varied(quality.facts(" ".join(rare))) == quality.GOOD


def slow_quality(texts):
    """(posterior, score) of each text: expectation-maximisation document by document, features and scorer by plain loops."""
    n = len(quality.LABELLERS)
    vote = [[label(quality.facts(t or "")) for label in quality.LABELLERS] for t in texts]
    about = [[(1.0, 0.5, 0.5)] * n, [(1.0, 0.03, 0.97)] * n]
    prior, posterior = (0.3, 0.7), [0.0] * len(texts)
    for _ in range(200):
        new = []
        for v in vote:
            like = [prior[c] * float(np.prod([about[c][i][v[i]] for i in range(n)])) for c in (0, 1)]
            new.append(like[1] / (like[0] + like[1]))
        moved = max(abs(a - b) for a, b in zip(new, posterior))
        if moved < 1e-9:
            break
        posterior = new
        weight = [[1 - p for p in posterior], posterior]
        prior = tuple((sum(w) + 1) / (len(texts) + 2) for w in weight)
        for c in (0, 1):
            for i in range(n):
                bad, good = (1 + sum(w for w, v in zip(weight[c], vote) if v[i] == k) for k in (quality.BAD, quality.GOOD))
                about[c][i] = (1.0, bad / (bad + good), good / (bad + good))

    def seen(t):
        raw = (t or "").encode()
        out = np.zeros(quality.BUCKETS)
        if len(raw) < 3:
            return out
        shape = bytes(48 if 48 <= c < 58 else 65 if 65 <= c < 91 else 97 if 97 <= c < 123 or c > 127 else c for c in raw)
        for kind, salt in ((raw, 0x9E3779B1), (shape, 0x85EBCA77)):
            for a, b, c in zip(kind, kind[1:], kind[2:]):
                out[((a << 16 | b << 8 | c) * salt & 0xFFFFFFFF) >> 21] += 1
        w = (t or "").split()
        same = sum(a == b for a, b in zip(w, w[1:])) / max(1, len(w))
        out /= out.sum()
        out[xxhash.xxh32_intdigest("same") % quality.BUCKETS] += same
        out[xxhash.xxh32_intdigest("other") % quality.BUCKETS] += 1 - same
        return np.sqrt(out)

    distinct = {t: p for t, p in zip(texts, posterior)}
    x = {t: seen(t) for t in distinct}
    good, bad = sum(distinct.values()), sum(1 - p for p in distinct.values())
    each = {t: p / good + (1 - p) / bad for t, p in distinct.items()}
    whole = sum(each.values())
    w, bias, move_w, move_b = np.zeros(quality.BUCKETS), 0.0, np.zeros(quality.BUCKETS), 0.0
    for _ in range(250):
        down_w, down_b = np.zeros(quality.BUCKETS), 0.0
        for t, p in distinct.items():
            gap = (1 / (1 + np.exp(-(x[t] @ (w + 0.9 * move_w) + bias + 0.9 * move_b))) - p) * each[t] / whole
            down_w, down_b = down_w + gap * x[t], down_b + gap
        move_w, move_b = 0.9 * move_w - 4 * (down_w + 1e-4 * w), 0.9 * move_b - 4 * down_b
        w, bias = w + move_w, bias + move_b
    return [(p, 1 / (1 + np.exp(-(x[t] @ w + bias)))) for t, p in zip(texts, posterior)]


def test_quality_against_brute_force(docs):
    """All of a small table is drawn, so the plain version is fitted on the same texts."""
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in quality.classify(docs).collect()}
    for (i, _), (p, s) in zip(rows, slow_quality([t for _, t in rows])):
        assert abs(got[i].posterior - p) < 1e-6 and abs(got[i].score - s) < 0.01
        assert got[i].keep == (s >= quality.THRESHOLD) or abs(s - quality.THRESHOLD) < 0.01


def test_quality_sample_is_bounded(spark, docs, monkeypatch):
    """A text of very many copies is collected once, whatever their ids; other texts only up to the limit."""
    asked = []
    monkeypatch.setattr(quality, "fit_scorer", lambda x, y: asked.append(len(x)) or np.r_[np.zeros(quality.BUCKETS), 0.0])
    many = docs.select("doc_id", "text").unionByName(spark.range(3000).selectExpr("id as doc_id", "'One clean sentence stands here. Another follows it.' as text"))
    quality.fit(many)
    quality.fit(docs, sample=2)
    n = docs.select("text").distinct().count()
    assert asked[0] <= n + 1 and asked[1] <= 8


def test_quality_with_nothing_to_learn(spark):
    rows = spark.createDataFrame([(1, "A short and clean text."), (2, "Another one, quite like it.")], "doc_id long, text string")
    assert [r.keep for r in quality.classify(rows).collect()] == [True, True] and quality.keep_good(rows).count() == 2


def test_quality_clashes(odd):
    clash = odd.withColumnRenamed("score", "_q0_keep").withColumn("_posterior", F.lit("p")).withColumn("_KEEP", F.lit("k")).withColumn("_j0", F.lit(1))
    got = quality.keep_good(clash)
    assert got.columns == clash.columns and {r._KEEP for r in got.collect()} == {"k"} and {r._posterior for r in got.collect()} == {"p"}


def test_quality_odd(odd):
    got = quality.classify(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(odd.limit(0)).count() == 0


def test_mixing(spark, docs):
    weights = {"src0": 3.0, "src1": 1.0}
    got = mixing.mix(docs, weights, 0.0, total=4000).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert set(n) == {"src0", "src1"} and abs(n["src0"] / (n["src0"] + n["src1"]) - 0.75) < 0.05
    assert abs(sum(n.values()) - 4000) < 5 * 4000**0.5
    again = mixing.mix(docs.repartition(7), weights, 0.0, total=4000)
    once = mixing.mix(docs, weights, 0.0, total=4000)
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))


@pytest.fixture
def all_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_mixing_rows_of_one_id(spark, all_partitions):
    """A third of all rows without an id, and a third with one: they draw by themselves and go to all partitions."""
    ids = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id"))
    rows = spark.range(6000).select(ids.alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("a").alias("source"))
    got = mixing.mix(rows, {"a": 1.0}, total=20_000)
    assert abs(got.count() - 20_000) < 5 * 20_000**0.5
    for one in ("doc_id is null", "doc_id = 7"):
        sizes = [r["count"] for r in got.where(one).groupBy(F.spark_partition_id().alias("p")).count().collect()]
        parts = got.select(F.spark_partition_id().alias("p")).distinct().count()
        assert len(sizes) == parts > 1 and max(sizes) < 1.5 * sum(sizes) / parts
    copies = [r.copies for r in got.where("doc_id = 7").select("text", "copies").distinct().collect()]
    assert len(set(copies)) > 4
    twice = mixing.mix(rows.unionAll(rows), {"a": 1.0}, total=40_000).groupBy("text").agg(F.count("*").alias("n"), F.max("copies").alias("m")).collect()
    assert all(r.n == 2 * r.m for r in twice)


def test_mixing_odd(odd):
    clash = odd.withColumnRenamed("n", "copies").withColumnRenamed("score", "_m0_x")
    got = mixing.mix(clash, {"a": 1.0}, 1.0, total=40)
    assert {"copy", "copies", "doc_id", "_m0_x"} <= set(got.columns) and got.count() > 0
    assert mixing.mix(odd.limit(0), {"a": 1.0}, 1.0).count() == 0
    assert mixing.mix(odd, {"a": 0.0}, 0.0).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, {"a": -1.0})


def test_tokens(docs):
    enc = vocab.encoder()
    text = {r.doc_id: r.text for r in docs.collect()}
    got = tokens.count_tokens(docs).toPandas()
    for i, g in got.groupby("doc_id"):
        assert g.n_tokens.sum() == g.doc_tokens.iloc[0] == len(enc.bpe.encode_ordinary(text[i]))
        assert "".join(text[i][s : s + n] for s, n in zip(g.start, g.length)) == text[i]


def slow_counts(text, own):
    """(tokens, shared tokens) of each line by a loop over the tokens' offsets, as the vocabulary's own reader gives them, and all lines."""
    cuts = [0, *(i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)), len(text)]
    spans = list(zip(cuts, cuts[1:]))
    n, shared = [0] * len(spans), [0] * len(spans)
    for a, b in own.encode(text, add_special_tokens=False).offsets:
        held = [max(0, min(b, e) - max(a, s)) for s, e in spans]
        best = held.index(max(held))
        n[best] += 1
        shared[best] += sum(h > 0 for h in held) > 1
    return n, shared


def test_token_counts_against_brute_force(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    odd_texts = ["a\n\n\nb  \n  c", "é\n字字\r\n\n x", "\n", "<|endoftext|>\nx", "  \n\n  \n", "\U0001f600\n\U0001f600 don't\n", "x" * 5000 + "\n\n" + "y z" * 900]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd_texts)], "doc_id long, text string"))
    text = {r.doc_id: r.text for r in frame.collect() if len(r.text) < 20_000}
    got = tokens.count_tokens(frame).toPandas()
    crossing = 0
    for i, g in got.groupby("doc_id"):
        if i in text:
            g = g.sort_values("section")
            n, shared = slow_counts(text[i], own)
            crossing += sum(shared)
            assert (g.n_tokens.tolist(), g.shared_tokens.tolist()) == (n, shared)
    assert crossing > 2


def test_token_attribution_rule():
    spans = np.array([[0, 3], [3, 5], [4, 8]])
    assert tokens.attribute(spans, np.array([0, 4]), 8).tolist() == [0, 0, 1]
    assert tokens.attribute(np.array([[2, 6]]), np.array([0, 4]), 8).tolist() == [0]
    assert tokens.attribute(np.array([[2, 7]]), np.array([0, 4]), 8).tolist() == [1]


def test_tokens_odd(odd):
    got = tokens.count_tokens(odd).toPandas()
    assert got[got.doc_id == 1].n_tokens.tolist() == [0]
    assert tokens.count_tokens(odd.limit(0)).count() == 0


def exact(rows, queries_, k):
    ok = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    return {q: [i for _, i in sorted((-float(ok[q] @ v), i) for i, v in ok.items() if i != q)[:k]] for q in queries_ if q in ok}


def test_neighbours(spark, sf):
    vectors = table(spark, sf, "embeddings")
    got = ann.search(vectors, F.col("vec_id") % 20 == 0).toPandas()
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = exact(rows, [i for i, _ in rows if i % 20 == 0], 20)
    hits = sum(len(set(g.vec_id) & set(want[q])) for q, g in got.groupby("query_id"))
    assert hits >= 0.9 * 20 * len(want) and set(got.query_id) == set(want)
    by = {i: np.array(v, float) for i, v in rows}
    assert all(abs(r.score - by[r.query_id] @ by[r.vec_id]) < 1e-12 for r in got.itertuples())


@pytest.mark.parametrize("kind", ["clusters", "uneven norms", "no structure"])
def test_neighbours_over_many_lists(spark, monkeypatch, kind):
    """Mean and least recall over ten lists or more, against brute force."""
    monkeypatch.setattr(ann, "LIST", 300)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 24))
    if kind != "no structure":
        x = rng.normal(size=(40, 24))[rng.integers(0, 40, 6000)] * 2 + x * 0.4
    if kind == "uneven norms":
        x *= rng.lognormal(0, 0.7, 6000)[:, None]
    seen = []
    monkeypatch.setattr(ann, "fit", lambda *a, f=ann.fit, **b: seen.append(f(*a, **b)) or seen[-1])
    vectors = spark.createDataFrame(pd.DataFrame({"vec_id": range(6000), "embedding": x.tolist()}))
    got = ann.search(vectors, F.col("vec_id") % 20 == 0).toPandas()
    score = x[::20] @ x.T
    score[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    want = np.argsort(-score, 1)[:, :20]
    recall = np.array([len(set(g.sort_values("rank").vec_id) & set(want[q // 20])) for q, g in got.groupby("query_id")]) / 20
    assert len(seen[0].centroids) >= 10 and len(recall) == 300
    assert recall.mean() >= 0.95 and recall.min() >= 0.5, (recall.mean(), recall.min(), seen[0].probes)
    if kind == "clusters":
        assert seen[0].probes < len(seen[0].centroids)


@pytest.mark.parametrize("kind", ["long ones", "wide clusters", "other queries"])
def test_neighbours_of_other_rows(spark, kind):
    """Mean recall where few vectors are very long, lists are long and their rows close to each other, or queries are unlike the rest."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8000, 64))
    if kind == "long ones":
        x[rng.choice(8000, 40, replace=False)] *= 100
    else:
        x = rng.normal(size=(4, 64))[rng.integers(0, 4, 8000)] * 5 + x
    if kind == "other queries":
        x[::20] = rng.normal(size=(400, 64))
    vectors = spark.createDataFrame(pd.DataFrame({"vec_id": range(8000), "embedding": x.tolist()}))
    got = ann.search(vectors, F.col("vec_id") % 20 == 0, sample=1000).toPandas()
    score = x[::20] @ x.T
    score[np.arange(400), np.arange(0, 8000, 20)] = -np.inf
    want = np.argsort(-score, 1)[:, :20]
    recall = np.array([len(set(g.vec_id) & set(want[q // 20])) for q, g in got.groupby("query_id")]) / 20
    assert len(recall) == 400 and recall.mean() >= 0.95, recall.mean()


def test_neighbours_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, [1.0, 1.0])]
    rows += [(i, [1.0, 0.5]) for i in range(20, 60)] + [(80, [0.5, -1.0]), (None, [1.0, 2.0])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, query int")
    got = ann.search(vectors, F.col("vec_id") % 20 == 0, 5).orderBy("query_id", "rank").collect()
    want = exact([r for r in rows if r[0] is not None and r[0] != 6], [0, 20, 40, 80], 5)
    assert {q: [r.vec_id for r in got if r.query_id == q] for q in want} == want
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] * 4
    assert ann.search(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(vectors.where("vec_id in (0, 7)"), F.col("vec_id") % 20 == 0).count() == 1


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>The  title</h1></header><p>A first paragraph of the article that is long &amp; dull.</p><script>x()</script>
<p>Short.</p><aside>Advert</aside><ul><li>One<li>Two</ul></article><div id="comments"><p>First!</p></div><footer>About us</footer></body></html>"""


def test_html():
    assert html_extract.main_text(PAGE).split("\n\n") == ["The title", "A first paragraph of the article that is long & dull.", "Short.", "One", "Two"]
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>x</nav>") == ""


def test_html_forms_and_regions_outside_the_named_part():
    long = [f"Paragraph {i} of a page says at some length what it has to say, and {i} more words follow it here." for i in range(8)]
    body = "".join(f"<p>{x}</p>" for x in long)
    for tag in ("form", "fieldset", "menu"):
        assert html_extract.main_text(f"<nav>Home</nav><{tag}><div>{body}</div></{tag}><footer>About</footer>").split("\n\n") == long
        assert html_extract.main_text(f"<article>{body}</article><{tag}><label>Your name</label><p>Send us a note.</p></{tag}>").split("\n\n") == long
    split = f"<article>{''.join(f'<p>{x}</p>' for x in long[:5])}</article><div>{''.join(f'<p>{x}</p>' for x in long[5:])}</div><aside><p>{long[0]}</p></aside>"
    assert html_extract.main_text(split).split("\n\n") == long


def test_html_odd(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", "<p>a<b"), (None, None, "<div>" * 3000 + "deep text")], "page_id long, url string, html string")
    got = html_extract.extract(pages.withColumn("text", F.lit("x"))).collect()
    assert len(got) == 3 and all(len(r.text) == r.n_chars for r in got)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_lines(spark):
    passage = "\n".join(f"line {i} of a passage that several documents have in common here" for i in range(6))
    rows = [(1, f"own start\n{passage}\nown end"), (2, f"other\n{passage}\nother end"), (3, "line 0 of a passage that several documents have in common here"), (4, passage), (None, None), (5, "")]
    got = {r.doc_id: r.text for r in winnow.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "other\nother end", 3: rows[2][1], 4: "", None: None, 5: ""}


def test_lines_odd(odd):
    for name in ("_ranges0", "_ranges0_d", "_RANGES0", "_Ranges0_C"):
        got = winnow.dedup_lines(odd.withColumn(name, F.lit(1)))
        assert got.count() == len(ODD) and got.columns == [*odd.columns, name]
    assert winnow.dedup_lines(odd.limit(0)).count() == 0


def test_lines_and_mixing_against_their_sql(sf, spark, docs):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    for name in ("op3_mixing", "op7_lines"):
        got = queries.QUERIES[name](spark, sf)
        want = con.sql(queries.ORACLES[name])
        names = sorted(got.columns)
        assert names == sorted(want.columns)
        assert sorted(tuple(map(str, r)) for r in got.select(names).collect()) == sorted(tuple(map(str, r)) for r in want.select(*names).fetchall())


def test_winnowing_selects_from_every_run():
    rng = np.random.default_rng(2)
    hashes, lengths = rng.integers(0, 9, 60), rng.integers(0, 30, 60)
    picked = winnow.selected(hashes, lengths, 50)
    for i, e in enumerate(winnow.run_ends(lengths, 50)):
        assert e > 60 or any(i <= p < e for p in picked)


def digests(turns):
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(whole), len(loss), sha(loss)


def test_chat(spark, sf):
    got = queries.op8_chat(spark, sf).toPandas().set_index("conv_id")
    by = table(spark, sf, "conversations").toPandas()
    hard = "\\### Assistant: </turn> ok"
    by = pd.concat([by, pd.DataFrame({"conv_id": -7, "turn": [0, 1], "role": ["user", "assistant"], "text": hard})])
    for i, g in by.groupby("conv_id"):
        r = got.loc[i]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digests(list(g.sort_values("turn")[["role", "text"]].itertuples(index=False, name=None)))


def test_chat_tree(spark):
    rows = [(c, i, r, t) for c, ts in {1: "ab", 2: "ac", 3: "abd", 4: "x", 5: "abe"}.items() for i, (r, t) in enumerate(zip(["user", "assistant", "user"], ts))]
    rows += [(6, 0, None, None), (None, 0, "user", "a & <b>"), (6, 1, "assistant", "")]
    _, paths, nodes = chat.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = nodes.toPandas()
    assert len(got) == len(set(map(bytes, got.node))) == 9  # shared turns once
    spans = {bytes(r.node): (r.start, r.start + r.n_tokens) for r in got.itertuples()}
    by = {bytes(r.node): r for r in got.itertuples()}
    for _, g in got.groupby(got.tree.map(bytes)):
        at = g.sort_values("start")
        assert at.start.tolist() == [0, *np.cumsum(at.n_tokens)[:-1]]  # one gapless sequence
    for r in got.itertuples():
        chain, up = [], r.parent
        while up is not None:
            chain.insert(0, spans[bytes(up)])
            up = by[bytes(up)].parent
        assert r.position == sum(b - a for a, b in chain)
        assert sorted(x for a in r.attends for x in range(a["from"], a["to"])) == [x for a, b in chain for x in range(a, b)]
    assert paths.count() == 7


def test_chat_rows_without_conversation(spark):
    """Each is a conversation of its own, and none are gathered."""
    rows = [(None, i % 3, "assistant", f"text {i % 50}") for i in range(400)] + [(1, 0, "user", "a"), (1, 0, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.read_back(*chat.prefix_tree(turns)).toPandas()
    assert len(got) == 401 and sorted(got[got.conv_id.isna()].n_turns.unique()) == [1] and got[got.conv_id == 1].n_turns.tolist() == [2]
    assert sorted(got[got.conv_id.isna()].turns_sha256) == sorted(digests([r[2:]])[1] for r in rows[:400])


def test_chat_odd(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(*chat.prefix_tree(empty)).count() == 0
    for role, text in [("user", "</turn>\n<turn assistant>\n"), ("a<b", "&lt;"), ("", "")]:
        assert chat.parse("".join(chat.segment(role, text))) == [(role, text)]


def test_differencing():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 513, 400).tolist()
    parts = packing.fill(sizes, 1024)
    assert sorted(i for p in parts for i in p) == list(range(400)) and max(sum(sizes[i] for i in p) for p in parts) <= 1024
    assert sum(sizes) > 0.97 * 1024 * len(parts)


def test_packing(docs, odd):
    enc = vocab.encoder()
    for frame in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        text = {r.doc_id: r.text or "" for r in frame.collect()}
        got = packing.pack(frame).toPandas()
        for i, g in got.groupby("doc_id"):
            g = g.sort_values("start")
            assert b"".join(g.ids) == enc.ids(text[i], control=True) + b"\0\0\0\0"
            assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]]
        for _, g in got.groupby("sequence_id"):
            g = g.sort_values("offset")
            assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024
    assert packing.pack(odd.limit(0)).count() == 0


def test_ids_are_those_of_the_vocabulary():
    import public_tokenizers
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    own, enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), vocab.encoder()
    part = st.sampled_from(["a", "bc", " ", "\n", "\t", " ", "é", "1", ".", "'s", "<|endoftext|>", "字", "\x1c"])

    @settings(max_examples=300, deadline=None)
    @given(st.lists(part, max_size=12).map("".join))
    def same(text):
        assert np.frombuffer(enc.ids(text, control=True), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids
        assert len(enc.spans(text)) == len(enc.bpe.encode_ordinary(text))

    same()


def test_long_runs_of_one_character():
    """Neither runs of white space nor of anything else are too long for the pattern's matcher."""
    import public_tokenizers
    from tokenizers import Tokenizer

    own, enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), vocab.encoder()
    for text in ("x" + " " * 5000 + "y", "\n" * 3000, "a" + "\u3000" * 2000 + "\nb", "\t" * 1500 + "z" + " " * 1000 + "\n" * 1000, "a" * 5000, "é" * 3000 + "!?" * 2000):
        want = own.encode(text, add_special_tokens=False)
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == want.ids
        assert enc.spans(text).tolist() == [list(o) for o in want.offsets]
    for c in " \n\u3000aé!":
        assert enc.decode(enc.ids(c * 1_000_000)) == c * 1_000_000


@pytest.mark.parametrize("n", [0, 1, 64, 937, 938, 4000, 100_000])
def test_audio_round_trip(n):
    payload = (np.random.default_rng(n).bytes(n) + b"\xff\xfb\x90\x44" * 3)[: max(n, 1)]
    data = audio.write(payload)
    found = audio.scan(data)
    assert audio.read(data, found) == payload and not found.skipped and not found.bad_crc
    assert found.duration == sum(h.samples for h in found.headers) / 48000 or float(found.duration) > 0
    assert found.vbr["frames"] == len(found.headers)


def test_audio_damage():
    data = audio.write(bytes(range(256)) * 20)
    lost = data[:300] + b"\0" * 7 + data[300:]
    assert audio.scan(b"junk" + data).resyncs == 1
    found = audio.scan(lost)
    assert found.resyncs >= 1 or found.bad_crc
    with pytest.raises(ValueError):
        audio.read(lost, found)
    assert audio.scan(b"").duration == 0 and audio.scan(data[:-10]).cut > 0


def frame_of(version, layer, index, rate, mode=3, body=b"", protected=True):
    """A frame with its header's bits as given; the checksum is put in by the caller."""
    v, y = {1: 3, 2: 2, 25: 0}[version], {1: 3, 2: 2, 3: 1}[layer]
    head = bytes((0xFF, 0xE0 | v << 3 | y << 1 | (not protected), index << 4 | rate << 2, mode << 6))
    size = audio.read_header(head).size
    return head + ((b"\0\0" if protected else b"") + body).ljust(size - 4, b"\x55")[: size - 4]


def test_audio_false_header_while_lost():
    """Junk that looks like a header costs no frame, whatever length it claims."""
    frames = [frame_of(1, 3, 1, 1, protected=False) for _ in range(4)]
    false = bytes((0xFF, 0xFB, 14 << 4 | 1 << 2, 3 << 6)) + b"\0\0"
    for place in range(5):
        data = b"".join(frames[:place]) + false + b"".join(frames[place:])
        found = audio.scan(data)
        assert (len(found.headers), found.skipped, found.cut) == ((4, 6, 0) if place < 4 else (4, 0, 6)), place
    other = frame_of(2, 3, 8, 0, protected=False)  # of another kind, once: not the stream's
    found = audio.scan(frames[0] * 2 + other + frames[0] * 3)
    assert len(found.headers) == 5 and found.skipped == len(other)
    found = audio.scan(frames[0] * 2 + other * 3 + frames[0] * 3)  # a stream that does change
    assert len(found.headers) == 8 and found.skipped == 0


def slow_crc(bits):
    value = 0xFFFF
    for b in bits:
        value = (value << 1 ^ (0x8005 if (value >> 15 & 1) != b else 0)) & 0xFFFF
    return value


@pytest.mark.parametrize(
    ("version", "layer", "index", "rate", "mode", "covered"),
    [
        (1, 1, 8, 0, 3, 128), (1, 1, 8, 0, 0, 256), (1, 1, 8, 0, 1, 4 * (4 * 2 + 28)), (2, 1, 8, 0, 3, 128),
        # Layer II, all subbands allocated: of one channel, 27 subbands of 88 bits, or 30 of 94; of 8 and 12 of few bits
        (1, 2, 4, 1, 3, 88 + 54), (1, 2, 10, 0, 3, 94 + 60), (1, 2, 1, 0, 3, 26 + 16), (1, 2, 1, 2, 3, 38 + 24), (2, 2, 8, 0, 3, 75 + 60), (1, 2, 10, 1, 0, 2 * (88 + 54)),
        (1, 3, 9, 0, 3, 17 * 8), (2, 3, 9, 0, 0, 17 * 8),
    ],
)
def test_audio_checksums_of_all_layers(version, layer, index, rate, mode, covered):
    frame = bytearray(frame_of(version, layer, index, rate, mode, b"\xff" * 60))
    bits = [int(b) for b in "".join(f"{x:08b}" for x in frame[2:4] + frame[6:])][: 16 + covered]
    frame[4:6] = slow_crc(bits).to_bytes(2, "big")
    assert audio.scan(bytes(frame) * 3).bad_crc == 0
    inside, outside = bytearray(frame), bytearray(frame)
    inside[6 + 1] ^= 1 << 3
    outside[6 + (covered + 7) // 8] ^= 1
    assert audio.scan(bytes(frame) + bytes(inside) + bytes(frame)).bad_crc == 1
    assert audio.scan(bytes(frame) + bytes(outside) + bytes(frame)).bad_crc == 0


def test_audio_clashes_and_null_media(spark):
    rows = spark.createDataFrame([(1, "a", bytearray(b"x"), "s"), (2, None, None, "t")], "doc_id long, text string, media binary, audio string")
    heard = audio.scan_media(rows).orderBy("doc_id").collect()
    assert heard[0].audio.payload is None and not heard[0].audio.intact and heard[0].audio.frames == 0 and heard[1].audio is None
    assert [r.audio.intact for r in audio.scan_media(audio.add_media(rows)).collect()] == [True, True]


def test_audio(docs, odd):
    for frame in (docs, odd):
        rows = audio.scan_media(audio.add_media(frame)).select("text", "audio.*").collect()
        for r in rows:
            raw = (r.text or "").encode()
            assert bytes(r.payload) == raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0") and r.intact
            assert packing.crc32(bytes(r.payload)) == zlib.crc32(bytes(r.payload))
    assert audio.scan_media(audio.add_media(odd.limit(0))).count() == 0
