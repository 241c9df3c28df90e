"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

1. A bounded sample trains coarse centroids and, on what they leave over, a codebook for each
   part of the dimensions. A query probes lists by the largest inner product that it may expect
   there, from the list's centroid, spread and size; how many is measured on the same sample,
   with a sample of the queries themselves.
2. Every distinct vector goes to its centroid's list, with a byte for each part and the length
   of what the codes lose. Vectors far from all centroids, as those much longer than the rest,
   which may be near to any query, go to a list of their own that every query probes.
3. Queries meet the lists that they probe in blocks of bounded size. A table of inner products
   for each query and part scores a block's codes; all whose lost length may lift them among the
   best of the block are scored again by their original vectors, in double precision.
4. Blocks' best are merged by query.

Equal vectors are searched once, with as many of their smallest ids as a result can hold, so
that a vector of a third of all rows is one row of the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.tables import materialize

#: Vectors that the model is fitted on, at most.
SAMPLE = 8192
#: Vectors of a list that are aimed at, and lists at most.
LIST, LISTS = 2048, 4096
#: Parts of the dimensions, and codes of each.
PARTS, CODES = 16, 256
#: Share of the sample's true neighbours that the probed lists must hold, share of its queries that must have half of theirs there, and such queries.
COVERED, HALF, ASKED = 0.98, 0.998, 512
#: Share of the sample's vectors that lie farther from their centroids than what goes to the list of far ones.
FAR = 0.01
#: Candidates and queries of a block, and the share of it from which all are scored exactly at once.
BLOCK, QUERIES, DENSE = 4096, 2048, 0.05


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k centroids, fewer if x has fewer rows. Empty ones stay where they are."""
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centroids)
        count = np.bincount(own, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The place of the nearest centroid of each row."""
    half = (centroids**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centroids.T - half, 1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


@dataclass
class Model:
    centroids: np.ndarray  # (lists, dim)
    books: list[np.ndarray]  # for each part: (codes, width)
    cuts: list[int]  # where parts begin and end
    reach: np.ndarray  # of each list: how far its largest inner product may lie over the centroid's, for a query of length one
    probes: int
    limit: float = np.inf  # vectors that lie farther from their centroids are far ones

    def order(self, queries: np.ndarray) -> np.ndarray:
        """The lists of each query, the most promising first."""
        length = np.sqrt((queries**2).sum(1))
        return np.argsort(-(queries @ self.centroids.T + length[:, None] * self.reach), 1, kind="stable")

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The list of each row (far ones: the one after all centroids), the codes of what its centroid leaves over, and the length of what they lose."""
        own = nearest(x, self.centroids)
        left = x - self.centroids[own]
        own = np.where((left**2).sum(1) > self.limit**2, len(self.centroids), own)
        codes = []
        for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False):
            codes.append(nearest(left[:, a:b], book))
            left[:, a:b] -= book[codes[-1]]
        return own, np.stack(codes, 1).astype(np.uint8), np.sqrt((left**2).sum(1))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(parts, queries, codes): inner products of queries' parts with the books."""
        out = np.zeros((len(self.books), len(queries), CODES), np.float32)
        for p, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books, strict=False)):
            out[p, :, : len(book)] = queries[:, a:b] @ book.T
        return out


def fit(sample: np.ndarray, n: int, k: int, asked: np.ndarray | None = None, seed: int = 5) -> Model:
    """Centroids, books, reaches and probes from a sample of n distinct vectors, for k neighbours of queries like those asked (the sample's own, if none)."""
    rng = np.random.default_rng(seed)
    size = np.sqrt((sample**2).sum(1))
    usual = sample[size <= np.quantile(size, 1 - FAR)]  # a few very long vectors would draw all centroids
    centroids = kmeans(usual, max(1, min(LISTS, len(usual) // 8, -(-n // LIST))), rng)
    own = nearest(sample, centroids)
    left = sample - centroids[own]
    away = np.sqrt((left**2).sum(1))
    limit = float(np.quantile(away, 1 - FAR))
    near = away <= limit
    cuts = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int).tolist()
    books = [kmeans(left[near, a:b], CODES, rng) for a, b in zip(cuts, cuts[1:], strict=False)]
    held = np.bincount(own[near], minlength=len(centroids))
    square = np.bincount(own[near], away[near] ** 2, len(centroids)) / np.maximum(held, 1) / sample.shape[1]
    # the largest of so many normal numbers of that deviation, about
    reach = np.sqrt(square * 2 * np.log(np.maximum(held * n / len(sample), 2)))
    model = Model(centroids, books, cuts, reach, 1, limit)
    queries = sample if asked is None or not len(asked) else asked
    queries = queries[rng.choice(len(queries), min(ASKED, len(queries)), replace=False)]
    score = queries @ sample.T
    score[(queries**2).sum(1)[:, None] - 2 * score + (size**2)[None] <= 1e-9 * (size**2)[None]] = -np.inf  # a query itself
    true = _best(score, min(k, len(sample) - 1)) if len(sample) > 1 else np.zeros((len(queries), 0), np.int64)
    place = np.argsort(model.order(queries), 1)
    met = np.where(near[true], np.take_along_axis(place, own[true], 1), 0)  # all probe the list of far ones
    met = np.sort(met, 1)
    if met.size:
        every = np.sort(met.ravel())
        few = np.sort(met[:, (met.shape[1] - 1) // 2])  # by when a query has half of its neighbours
        model.probes = int(max(every[min(len(every) - 1, int(COVERED * len(every)))], few[min(len(few) - 1, int(HALF * len(few)))])) + 2  # and one more
    return model


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows whose vectors can be compared, as doubles."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))


def _array(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.zeros((0, 0))


def _best(score: np.ndarray, most: int) -> np.ndarray:
    """Places of the largest scores of each row, in any order."""
    if score.shape[1] <= most:
        return np.broadcast_to(np.arange(score.shape[1]), score.shape)
    return np.argpartition(-score, most - 1, axis=1)[:, :most]


def _hopeful(model: Model, own: int, queries: np.ndarray, codes: np.ndarray, lost: np.ndarray, most: int) -> np.ndarray:
    """(queries, rows): which rows of a list may be among the best `most` of them by what their codes say and may have lost."""
    if len(codes) <= most:
        return np.ones((len(queries), len(codes)), bool)
    table = model.tables(queries)
    score = np.repeat((queries @ model.centroids[own])[:, None].astype(np.float32), len(codes), 1)
    for p in range(table.shape[0]):
        score += table[p][:, codes[:, p]]
    length = np.sqrt((queries**2).sum(1))[:, None]
    rest = (length * lost + 1e-5 * (np.abs(score) + length * np.sqrt((model.centroids[own] ** 2).sum()))).astype(np.float32)
    sure = np.partition(score - rest, len(codes) - most, axis=1)[:, len(codes) - most]
    return score + rest >= sure[:, None]


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of vectors for which is_query holds.

    Nearness is the inner product of the original vectors in double precision, ties go to the
    smaller id, and a query isn't its own neighbour. is_query is a condition on the column
    vec_id. Vectors that are null, zero or empty, or have null or non-finite components, and rows without an id take no part; nor do vectors
    whose length isn't the commonest (the smallest of equally common ones). Ids are taken as
    unique; rows that repeat an id and vector count once. Other columns aren't looked at; no
    valid rows give none. A query with fewer than k candidates in all gets them all.
    """
    spark = vectors.sparkSession
    rows = _valid(vectors, id_col, vector_col)
    width = rows.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
    out = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("v") == width["w"]).distinct()
    order = Window.partitionBy("v").orderBy("vec_id")
    least = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)  # at most k + 1 a vector and task are shuffled
    distinct = materialize(least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    n = distinct.count()
    drawn = distinct.select("v", "ids").orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(sample).select("v").toPandas()
    asking = materialize(rows.where(is_query).select("vec_id", "v"), "queries")
    some = asking.orderBy(F.xxhash64("vec_id"), "vec_id").limit(ASKED).select("v").toPandas()
    model = fit(_array(drawn["v"]), n, k, _array(some["v"]))
    far = len(model.centroids)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            own, codes, lost = model.encode(_array(x["v"]))
            yield pd.DataFrame({"list": own, "codes": [c.tobytes() for c in codes], "lost": lost, "v": x["v"], "ids": x["ids"]})

    index = distinct.mapInPandas(encode, "list int, codes binary, lost double, v array<double>, ids array<long>")
    index = materialize(index, "index")
    sizes = {r["list"]: (r["n"], r["m"]) for r in index.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("m")).collect()}
    held = np.array([sizes.get(i, (0, 0))[1] for i in range(len(model.centroids))])

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            q = _array(x["v"])
            order = model.order(q)
            enough = (np.cumsum(held[order], 1) <= k).sum(1) + 1  # lists that hold k others at least
            most = np.minimum(np.maximum(model.probes, enough), order.shape[1])
            yield pd.DataFrame({"query": x["query"], "v": x["v"], "lists": [[*o[:m], far] for o, m in zip(order, most, strict=True)]})

    asked = asking.groupBy("v").agg(F.min("vec_id").alias("query"))
    asked = asked.mapInPandas(probe, "query long, v array<double>, lists array<int>")
    asked = materialize(asked.select("query", "v", F.explode("lists").alias("list")), "probes")
    asks = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = spark.createDataFrame(
        [(i, -(-c // BLOCK), -(-asks.get(i, 0) // QUERIES)) for i, (c, _) in sizes.items()], "list int, ways int, turns int"
    )  # a row a list, LISTS at most
    wide = index.join(F.broadcast(blocks), "list").select(
        "list", F.pmod(F.xxhash64(F.col("ids")[0]), "ways").cast("int").alias("way"),
        F.explode(F.when(F.col("turns") > 0, F.sequence(F.lit(0), F.col("turns") - 1))).alias("turn"), "codes", "lost", "v", "ids",
    )
    deep = asked.join(F.broadcast(blocks), "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"), F.pmod(F.xxhash64("query"), "turns").cast("int").alias("turn"), "query", "v"
    )

    def block(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(candidates) and len(queries):
            x, q = _array(candidates["v"]), _array(queries["v"])
            codes = np.frombuffer(b"".join(candidates["codes"]), np.uint8).reshape(len(x), -1)
            ids = candidates["ids"].to_numpy()
            own = candidates["list"].iloc[0]
            lost = candidates["lost"].to_numpy() * (1 + 1e-5)
            least = np.array([i[0] for i in ids])
            names = queries["query"].to_numpy()
            telling = own != far  # whether codes rule rows out
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                may = _hopeful(model, own, part, codes, lost, k + 1) if telling else np.ones((len(part), len(x)), bool)
                exact = part @ x.T if may.mean() > DENSE else None
                telling = telling and may.mean() < 0.5
                for i, row in enumerate(may):
                    if exact is None:
                        places = np.flatnonzero(row)
                        score = x[places] @ part[i]
                    else:
                        places, score = np.arange(len(x)), exact[i]
                    if len(places) > k + 1:  # with all that may tie with the last one
                        last = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                        places = places[score >= last - 1e-12 * max(1.0, np.abs(score).max())]
                    score = (x[places] * part[i]).sum(1)  # the same in each block
                    top = np.lexsort((least[places], -score))[: k + 1]
                    hits = sorted((-float(score[t]), int(v)) for t in top for v in ids[places[t]])[: k + 1]
                    found.append((names[at + i], [-s for s, _ in hits], [v for _, v in hits]))
        return pd.DataFrame(found, columns=["query", "scores", "hits"])

    keys = ["list", "way", "turn"]
    best = wide.groupBy(*keys).cogroup(deep.groupBy(*keys)).applyInPandas(block, "query long, scores array<double>, hits array<long>")
    hit = F.zip_with("scores", "hits", lambda s, v: F.struct((-s).alias("minus"), v.alias("id")))
    merged = best.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list(hit))), 1, k + 1).alias("hits"))
    merged = materialize(merged, "merged")
    named = asked.select("query", "v").distinct().join(merged, "query").select("v", "hits")
    named = materialize(named, "named")
    result = asking.join(named, "v").select(
        F.col("vec_id").alias("query_id"),
        F.posexplode(F.slice(F.filter("hits", lambda h: h["id"] != F.col("vec_id")), 1, k)).alias("place", "hit"),
    )
    return result.select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))
