"""Places within a distance against all pairs, at the poles and around the globe; choice among places of one name."""

import math
import random

import pytest
from pyspark.sql import functions as F

from brindle.functions.numbers import EARTH
from brindle.operators import nearby


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * EARTH * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("reach", [20_000, 150_000, 1_500_000])
def test_within_against_all_pairs(spark, reach):
    rng = random.Random(6)
    spots = [(45.0, -75.0), (89.6, 10.0), (-89.9, 170.0), (0.0, 179.9), (-30.0, -180.0), (64.0, 179.5), (90.0, 0.0), (12.3, 0.0)]
    def make(n):
        out = []
        for i in range(n):
            lat, lng = rng.choice(spots) if i % 3 else (rng.uniform(-90, 90), rng.uniform(-180, 180))
            spread = reach / 111_000 * 1.5
            out.append((i, max(-90.0, min(90.0, lat + rng.uniform(-spread, spread))), (lng + rng.uniform(-spread, spread) / max(0.02, math.cos(math.radians(lat))) + 180) % 360 - 180))
        return [*out, (n, None, 5.0), (n + 1, 91.0, 5.0)]

    a, b = make(250), make(250)
    left, right = spark.createDataFrame(a, "i long, a double, b double"), spark.createDataFrame(b, "j long, c double, d double")
    got = nearby.within(left, right, reach, ("a", "b"), ("c", "d")).collect()
    want = {(i, j) for i, x, y in a[:-2] for j, u, v in b[:-2] if metres(x, y, u, v) <= reach}
    assert len(got) == len(want) > 100 and {(r.i, r.j) for r in got} == want


def test_pair_score(spark):
    cases = [
        (["remote"], "remote", False, None, None, 1.0), (["office"], "remote", True, None, 0.0, None), (["remote"], "office", True, None, 0.0, None), (["remote"], None, True, None, None, 1.0),
        (None, "hybrid", True, None, 0.0, None), (["hybrid"], "hybrid", True, "state", None, 1.0), (["office"], "office", False, "state", 10.0, None), ([], "office", False, None, None, None),
        ([], "office", False, None, 50_000.0, 1.0), ([], "office", False, "place", 150_000.0, 0.5), ([], None, False, None, 150_001.0, 0.0), (["remote", "office"], "hybrid", False, None, 1.0, 1.0),
    ]
    df = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, wants array<string>, work string, city boolean, accuracy string, metres double")
    got = {r.i: r.s for r in df.select("i", nearby.pair_score(*map(F.col, ("wants", "work", "city", "accuracy", "metres"))).alias("s")).collect()}
    assert got == {i: c[5] for i, c in enumerate(cases)}


def test_chosen_places(spark):
    places = spark.createDataFrame([("Hamilton", "ON", 43.25, -79.87), ("Hamilton", "NS", 44.6, -63.5), ("Lévis", "QC", 46.8, -71.2), ("Hamilton", "ON", 43.3, -79.9)], "city string, province string, lat double, lng double")
    mentions = spark.createDataFrame(
        [(1, "HAMILTON", "on", 43.5, -79.6, None), (2, "Hamilton", None, 44.7, -63.4, None), (3, "Hamilton", None, None, None, "ON"), (4, "levis", "ON", 46.9, -71.3, None), (5, "Nowhere", "ON", 1.0, 1.0, None), (6, "Hamilton", "ON", 44.0, -79.9, None), (7, None, None, None, None, None)],
        "k int, name string, province string, lat double, lng double, fallback string",
    )
    got = {r.k: (r.province, r.lat, r.lng, r.precise) for r in nearby.chosen_places(mentions, places, "k").collect()}
    assert got == {1: ("ON", 43.5, -79.6, True), 2: ("NS", 44.7, -63.4, True), 3: ("ON", 43.25, -79.87, False), 4: ("QC", 46.8, -71.2, False), 6: ("ON", 43.25, -79.87, False)}


def test_pairs_of_a_small_file_go_to_all_cores(spark, tmp_path):
    """One split of one file doesn't leave all pairs to one task, and pairs at the very reach stay."""
    spark.createDataFrame([(i, 45.0, -75.0) for i in range(64)], "i long, a double, b double").coalesce(1).write.parquet(f"{tmp_path}/x")
    left = spark.read.parquet(f"{tmp_path}/x")
    reach = nearby.EARTH * 0.01  # about 64 km along a meridian
    right = spark.createDataFrame([(1, 45.0 + 0.5729, -75.0), (2, 45.0 + 0.573, -75.0)], "j long, c double, d double")
    found = nearby.within(left, F.broadcast(right), reach, ("a", "b"), ("c", "d"))
    assert sorted({r.j for r in found.collect()}) == [1]
    tasks = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1 and found.count() == 64
