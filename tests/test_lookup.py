"""Many searches at once against one search at a time."""

import random

from pyspark.sql import functions as F

from brindle.operators import lookup, search


def test_like_single_searches(spark):
    """Accents, nulls, repeated rows and aliases, short searches, locales with fallbacks, ties, empty tables."""
    rng = random.Random(4)
    words = ["manage", "staff", "lead", "teams", "cook", "càfé", "code", "co", "c", "gérer", "équipe", "library"]
    text = lambda: rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(1, 4)))])
    rows = [(i, text(), text() if i % 3 else None, rng.choice([None, [], [text() for _ in range(rng.randrange(1, 4))]])) for i in range(150)]
    df = spark.createDataFrame([*rows, rows[0]], "k long, fr string, en string, aliases array<string>")
    wanted = ["staff", "Stäff", "co", "c", "lead teams", "", None, "gerer equipe", "x", "libraries", "  ", "é", "staff"]
    asked = spark.createDataFrame([(w,) for w in wanted], "wish string")
    got = lookup.search_labels(df, "k", F.col("fr"), F.col("aliases"), asked, "wish", None, F.col("en")).collect()
    one = df.dropDuplicates(["k"])
    want = set()
    for w in {x for x in wanted if x and x.strip()}:
        found = search.label_search(one, "k", F.col("fr"), F.col("aliases"), w, 10_000, F.col("en")).collect()
        want |= {(w, r.k, r.matched_alias, round(r.score, 9), n + 1) for n, r in enumerate(found)}
    assert {(r.wish, r.k, r.matched_alias, round(r.score, 9), r.place) for r in got} == want and len(got) == len(want) > 100
    few = lookup.search_labels(df, "k", F.col("fr"), F.col("aliases"), asked, "wish", 2, F.col("en")).collect()
    assert {(r.wish, r.k) for r in few} == {(w, k) for w, k, _, _, n in want if n <= 2}
    assert lookup.search_labels(df.limit(0), "k", F.col("fr"), F.col("aliases"), asked, "wish").count() == 0
    assert lookup.search_labels(df, "k", F.col("fr"), F.col("aliases"), asked.limit(0), "wish").count() == 0
