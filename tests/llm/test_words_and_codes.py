"""Pieces, vector codes and spelling variants against the library and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from brindle.llm import codes, pieces, queries, spelling
from brindle.sources.tables import table

ODD = [
    "", " ", "  a b", "▁x ▁", "a\0b", "\0", "\n\n\n", "<s>", "<0x41>", "</s>", "<unk>", "日本😀͸", "ﬁ①", "a　b\tc", "é é", "aaaaaaaaaaa",
    " " * 100, "x" * 3000, "日本" * 500, "abc  \n  def   ", "a" + " " * 37 + "b", "12345 6,7.8", "▁▁", "trailing ", " \n ",
]


def as_ids(rows):
    return [np.array(r, "<u4").tobytes() for r in rows]


def random_texts(n, seed=3):
    rng = random.Random(seed)
    pool = "ab cdé▁ \n\t日😀͸e t  hing²."
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_pieces_against_library():
    made = pieces.Codec(pieces.default_path(), check=False)
    texts = ODD + random_texts(2000)
    want = made.library.encode(texts, add_bos=True, add_eos=True)
    for _ in range(2):  # the second time from memory
        got = made.encode(texts)
        assert got == as_ids(want)
    assert made.decode(got) == made.library.decode(want)
    # one agenda for the whole text gives the same as segments
    assert [made.begin + made._wholly(t) + made.end for t in texts[:400]] == as_ids(want[:400])


def test_pieces_forget(monkeypatch):
    monkeypatch.setattr(pieces, "SEGMENTS", 50)
    made = pieces.Codec(pieces.default_path())
    for seed in range(5):
        texts = random_texts(60, seed)
        assert made.encode(texts) == as_ids(made.library.encode(texts, add_bos=True, add_eos=True))


def test_decode_any_ids():
    made = pieces.Codec(pieces.default_path())
    rng = random.Random(5)
    hard = [0, 1, 2, 35, 200, 198, 0xC3 + 3, 0xA9 + 3, 0xE2 + 3, 0xF0 + 3, 28705, 259]
    rows = [[rng.choice(hard) if rng.random() < 0.6 else rng.randrange(32000) for _ in range(rng.randrange(14))] for _ in range(4000)]
    rows += [[0xC3 + 3] * 500, [0x80 + 3] * 500 + [300]]
    made.decode(as_ids(rows))  # checked against the library inside
    with pytest.raises(IndexError):
        made.decode(as_ids([[1, 32000, 2]]))


def test_check_finds_a_difference():
    made = pieces.Codec(pieces.default_path())
    made.pair_cost = made.pair_cost[::-1].copy()
    with pytest.raises(RuntimeError):
        made.encode(["a text of some ordinary words that merge"])


def changed_model(tmp_path, change):
    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.default_path(), "rb") as f:
        model.ParseFromString(f.read())
    change(model)
    path = str(tmp_path / "changed.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    return path


@pytest.mark.parametrize("kind", ["given", "no bytes", "no prefix", "extra spaces"])
def test_other_models(tmp_path, kind):
    def change(model):
        if kind == "given":
            for word in ("ing", "th", "the", "<x>"):
                model.pieces.add(piece=word + "☃", score=0.0, type=4)
        elif kind == "no bytes":
            model.trainer_spec.byte_fallback = False
            for p in model.pieces:
                if p.type == 6:
                    p.type = 1
        elif kind == "no prefix":
            model.normalizer_spec.add_dummy_prefix = False
        else:
            model.normalizer_spec.remove_extra_whitespaces = True

    made = pieces.Codec(changed_model(tmp_path, change))
    texts = [*ODD[:16], "something☃ the☃ thing <x>☃ th☃", *random_texts(200)]
    got = made.encode(texts)  # checked inside as well
    assert got == as_ids(made.library.encode(texts, add_bos=True, add_eos=True))
    made.decode(got)


def test_unused_pieces_are_refused(tmp_path):
    def change(model):
        model.pieces[500].type = 5

    with pytest.raises(ValueError):
        pieces.Codec(changed_model(tmp_path, change))


def test_pieces_query(spark, sf):
    got = {r.doc_id: r for r in queries.QUERIES["op11_pieces"](spark, sf).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_bos=True, add_eos=True)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_rows(spark):
    """Nulls, repeats, clashing names and an empty table."""
    rows = [(1, None, 5), (1, "a b", 5), (1, "a b", 5), (None, "", 5), (2, "word " * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = pieces.encode(docs).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded[:3]) for r in got)[:4] == [(0, 2, ""), (1, 2, ""), (1, 4, "a b"), (1, 4, "a b")]
    assert [len(r.decoded) for r in got if r.doc_id == 2] == [1_000_000]
    assert pieces.encode(docs.limit(0)).count() == 0
    back = pieces.decode(pieces.encode(docs)).collect()
    assert Counter((r.doc_id, r.decoded) for r in back) == Counter((r.doc_id, r.decoded) for r in got)


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (vec_id, label, vector). Whole numbers and double loops."""
    from fractions import Fraction
    from math import floor

    kept = [(i, lab, [floor(Fraction(x) * scale) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ends = codes.cuts(len(kept[0][2]), parts)
    first = sorted(kept, key=lambda r: (r[0] is None, r[0]))[:entries]
    books = [[r[2][a:b] for r in first] for a, b in zip(ends, ends[1:], strict=False)]

    def assign(x):
        out = []
        for book, a, b in zip(books, ends, ends[1:], strict=False):
            d = [sum((u - w) ** 2 for u, w in zip(x[a:b], e, strict=True)) for e in book]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, _, x in kept:
            for p, (e, _) in enumerate(assign(x)):
                groups[p, e].append(x[ends[p] : ends[p + 1]])
        for (p, e), own in groups.items():
            books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, lab, assign(x)) for i, lab, x in kept]
    text = ",".join(str(v) for b in books for e in b for v in e)
    return sorted((str(i), lab, bytes(e for e, _ in a).hex(), sum(d for _, d in a)) for i, lab, a in found), text


def compressed(df, **more):
    coded, books = codes.compress(df, **more)
    return sorted((str(r.vec_id), r.label, bytes(r.code).hex(), r.error) for r in coded.collect()), codes.digest(books)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_codes_against_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 3) if i % 7 else None, (rng.normal(size=24) * (0.1 if i % 5 else 3)).astype("f4" if kind == "float" else "f8").tolist()) for i in range(160)]
    rows[20] = (20, 1, None)
    rows[21] = (21, 1, [float("nan")] + rows[21][2][1:])
    rows[22] = (22, 1, [None] + rows[22][2][1:])
    rows[23] = (23, 1, [float("-inf")] + rows[23][2][1:])
    rows[25], rows[26] = (25, 2, rows[24][2]), (26, 2, rows[24][2])  # equal vectors
    rows[3] = (3, 0, rows[2][2])  # equal entries: ties go to the lower place
    rows[30] = (30, None, [0.0] * 24)
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").repartition(5)
    assert compressed(df) == plain_codes(rows)


def test_codes_of_few_odd_and_large(spark):
    rows = [(i, None, [float(i), -float(i), 0.3, 2.0, 1e9 * i, 1.0, 2.0, 3.0, 4.0, 5.5]) for i in range(5)]  # fewer than entries, ten components, large ones
    df = spark.createDataFrame([*rows, (9, None, [1.0])], "vec_id long, label int, embedding array<double>").withColumn("code", F.lit("x"))
    got, text = compressed(df)
    assert (got, text) == plain_codes(rows)
    assert compressed(df.limit(0)) == ([], "")
    with pytest.raises(Exception, match="64 bits"):
        codes.compress(spark.createDataFrame([(i, 1, [1e30 * (i % 19)] * 8) for i in range(40)], "vec_id long, label int, embedding array<double>"), rounds=0)


def test_annulus_leaves_entries_out():
    """Nearest by the annulus is nearest of all, ties included, with fewer distances."""
    rng = np.random.default_rng(1)
    entries = (rng.normal(size=(64, 6)) * rng.uniform(10, 4000, (64, 1))).astype(np.int64)
    entries[40] = entries[7]
    x = np.concatenate([entries, (rng.normal(size=(3000, 6)) * rng.uniform(10, 4000, (3000, 1))).astype(np.int64), np.zeros((1, 6), np.int64)])
    place, best, taken = codes.Book(entries).nearest(x)
    d = ((x[:, None] - entries) ** 2).sum(2)
    assert (place == d.argmin(1)).all() and (best == d.min(1)).all()
    assert taken < 0.6 * d.size


def test_codes_query_against_sql(spark, sf):
    got = queries.QUERIES["op12_codes"](spark, sf)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    want = con.sql(queries.ORACLES["op12_codes"]).fetchall()
    names = [d[0] for d in con.sql(queries.ORACLES["op12_codes"]).description]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want)


def plain_words(docs, change=True):
    total = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if change and h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_spellings(words):
    near = defaultdict(list)
    by_mask = defaultdict(set)  # words that are one apart share a text with a letter masked or left out
    for w in words:
        for i in range(len(w)):
            by_mask[w[:i] + "\0" + w[i + 1 :]].add(w)
            by_mask[w[:i] + w[i + 1 :]].add(w)
        by_mask[w].add(w)
    seen = {(a, b) for group in by_mask.values() for a in group for b in group}
    for a, b in seen:
        if one_apart(a, b):
            near[a].append(b)
    form = {}
    for w in near:
        best = min(near[w], key=lambda x: (-words[x], x))
        if words[best] >= 2 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_spelling_query(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = plain_spellings(plain_words(docs))
    assert rows_of(queries.QUERIES["op13_spelling"](spark, sf)) == want
    assert sum(w[1] is not None for w in want) > 50 and any(w[1] != w[2] for w in want if w[1])


@pytest.mark.parametrize("most_bits", [spelling.MOST_BITS, 2**16])
def test_spelling_rows(spark, most_bits):
    """Chains, ties, doubled letters, nulls, repeats and clashing names; a bitmap that is too small changes nothing."""
    text = " ".join(["letter"] * 40 + ["leter"] * 20 + ["leterr"] * 10 + ["leteerr"] * 4 + ["letterS"] * 3 + ["letters"] * 5 + ["éclair"] * 8 + ["eclair"] * 4 + ["ÉCLAIR"] * 2
                    + ["aaaaa"] * 6 + ["aaaaaa"] * 3 + ["abcde", "abcdf"] * 9 + ["abcdg"] * 3 + ["lone1", "four", "twice", "twice"])
    rows = [(1, text, 1), (None, text, 2), (1, text, 3), (7, None, 4), (8, "", 5), (9, "x" * 5000 + " letter", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word int").repartition(3)
    got = rows_of(spelling.group_spellings(docs, most_bits=most_bits))
    assert got == plain_spellings(plain_words([r[:2] for r in rows], change=False))
    by = {r[0]: r for r in got}
    assert by["leteerr"][1:3] == ("leterr", "letter") and by["abcdg"][1] == "abcde" and by["abcde"][1] is None
    assert rows_of(spelling.group_spellings(docs.limit(0))) == []


def test_edits_are_distinct_and_whole():
    alphabet = np.array([ord(c) for c in "abcé"], np.uint32)
    for word in ("aabbc", "éaaaa", "abcab", "ccccc"):
        code = np.array([[ord(c) for c in word]], np.uint32)
        made = [t for _, t in spelling.edits(code, alphabet, lambda h: np.ones(h.shape, bool))]
        letters = "abcé"
        want = {word[:i] + word[i + 1 :] for i in range(len(word))}
        want |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
        assert len(made) == len(set(made)) and set(made) == want - {word}
        # each edit's hash is that of its text
        heard = []
        list(spelling.edits(code, alphabet, lambda h, heard=heard: heard.append(h) or np.zeros(h.shape, bool)))
        all_hashes = {int(x) for h in heard for x in h.ravel()}
        assert {int(spelling.hashes(np.array([[ord(c) for c in t]], np.uint32))[0]) for t in made} <= all_hashes
