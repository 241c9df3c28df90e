"""Places near each other, by a join on grid cells, and the choice among places of one name."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.numbers import EARTH, distance
from brindle.functions.text import fold
from brindle.sources.tables import dealt

#: Metres of one degree of latitude, a little less than there are, so that cells are a little too large.
DEGREE = EARTH * 3.141592653589793 / 180 * 0.999


def _columns(band: Column, height: float) -> Column:
    """How many cells a band of latitude has: none is narrower than the reach, in this band or its neighbours."""
    low, high = band * height, (band + 1) * height
    far = F.least(F.greatest(F.abs(low), F.abs(high)) + height, F.lit(90.0))
    wide = F.lit(height * 1.01) / F.greatest(F.cos(F.radians(far)), F.lit(1e-9))
    return F.greatest(F.floor(F.lit(360.0) / wide), F.lit(1)).cast("long")


def _cell(band: Column, lng: Column, height: float, by: int = 0) -> Column:
    n = _columns(band, height)
    return F.struct(band.alias("band"), F.pmod(F.floor((lng + 180.0) / 360.0 * n).cast("long") + by, n).alias("column"))


def _point(name: str, lat: str, lng: str) -> dict[str, Column]:
    """A place on the globe of radius one."""
    up, round_ = F.radians(F.col(lat).cast("double")), F.radians(F.col(lng).cast("double"))
    return {f"{name}0": F.cos(up) * F.cos(round_), f"{name}1": F.cos(up) * F.sin(round_), f"{name}2": F.sin(up)}


def within(left: DataFrame, right: DataFrame, metres: float, left_place: tuple[str, str], right_place: tuple[str, str], result: str = "metres") -> DataFrame:
    """Pairs of rows of left and right that are at most `metres` apart along a great circle, with their distance.

    Each right row stands in one cell of a grid of about that size; each left row is written to
    its own and the neighbouring cells of three bands of latitude, each of as many cells as are
    wide enough there, and around the globe. Rows of a cell meet by an equi-join, whose hot
    cells Spark splits, and exact distances decide. A pair meets once. Rows without a place, or
    with one off the globe, meet none; columns of both tables must have different names.
    """
    height = metres / DEGREE
    if not 0 < height < 45:
        raise ValueError("the reach must be over nothing and under an eighth of the globe")
    (a, b), (c, d) = left_place, right_place
    on_globe = lambda lat, lng: F.col(lat).between(-90, 90) & F.col(lng).between(-180, 180)
    band = F.floor(F.col(a) / height).cast("long")
    cells = F.array_distinct(F.flatten(F.array(*[F.array(*[_cell(band + up, F.col(b), height, by) for by in (-1, 0, 1)]) for up in (-1, 0, 1)])))
    # dealt out anew: a small file is one split, whose one task would get all pairs of a join with a broadcast side,
    # and the expressions of cells and of pairs in one stage make one method too long to be compiled
    from_ = dealt(left.where(on_globe(a, b)).withColumns(_point("_a", a, b)).withColumn("_cell", F.explode(cells)))
    to = right.where(on_globe(c, d)).withColumns(_point("_b", c, d)).withColumn("_cell", _cell(F.floor(F.col(c) / height).cast("long"), F.col(d), height))
    # a product of points rules most pairs of neighbouring cells out before any distance is worked out
    cosine = sum((F.col(f"_a{i}") * F.col(f"_b{i}") for i in range(1, 3)), F.col("_a0") * F.col("_b0"))
    met = from_.join(to, "_cell").where(cosine >= math.cos(metres / EARTH) - 1e-9).drop("_cell", *[f"_{side}{i}" for side in "ab" for i in range(3)])
    return met.withColumn(result, distance(F.col(a), F.col(b), F.col(c), F.col(d))).where(F.col(result) <= metres)


def chosen_places(mentions: DataFrame, places: DataFrame, key: str, near: float = 0.5) -> DataFrame:
    """(key, city, province, lat, lng, precise) of each mention whose name a place has.

    mentions has key, name, province, lat, lng (of a geocoder) and fallback (a province), places
    has city, province, lat and lng; names are compared folded. Among places of one name the
    mention's province decides, then the fallback, then that the geocoder's coordinates are
    less than `near` degrees away, then the smallest province. The geocoder's coordinates stay
    if they are that near the place and in no other province (precise); otherwise the place's
    own are taken. A place that is listed twice counts once, with its smallest coordinates.
    """
    known = places.groupBy(fold(F.col("city")).alias("_name"), F.col("province").alias("_province")).agg(F.min(F.struct("lat", "lng", "city")).alias("_at"))
    asked = mentions.withColumn("_name", fold(F.col("name")))
    met = asked.join(known, "_name")
    close = F.coalesce((F.abs(F.col("lat") - F.col("_at.lat")) < near) & (F.abs(F.col("lng") - F.col("_at.lng")) < near), F.lit(False))
    same = lambda c: F.coalesce(F.upper(F.trim(F.col(c))) == F.upper("_province"), F.lit(False))
    order = [same("province").desc(), same("fallback").desc(), close.desc(), F.col("_province")]
    best = met.withColumn("_close", close & (F.col("province").isNull() | same("province"))).withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_place = 1")
    return best.select(
        key, F.col("_at.city").alias("city"), F.col("_province").alias("province"),
        F.when(F.col("_close"), F.col("lat")).otherwise(F.col("_at.lat")).alias("lat"), F.when(F.col("_close"), F.col("lng")).otherwise(F.col("_at.lng")).alias("lng"), F.col("_close").alias("precise"),
    )


def wishes(wants: Column) -> Column:
    """What wanted kinds of work say about places: remote work, nothing else, or any for which one goes somewhere."""
    asked = F.coalesce(wants, F.array().cast("array<string>"))
    return F.struct(
        F.array_contains(asked, "remote").alias("remote"), ((F.size(asked) > 0) & F.forall(asked, lambda w: w == "remote")).alias("only"),
        F.arrays_overlap(asked, F.array(F.lit("hybrid"), F.lit("office"))).alias("there"),
    )


def pair_score(wants: Column, work: Column, same_city: Column, accuracy: Column, metres: Column) -> Column:
    """wished_score() of wanted kinds of work."""
    return wished_score(wishes(wants), work, same_city, accuracy, metres)


def wished_score(wish: Column, work: Column, same_city: Column, accuracy: Column, metres: Column) -> Column:
    """1, 0.5, 0 or null: how near a posting is to a person, as far as its kind of work lets place count.

    Remote work counts in full for who wants it, and says nothing for others; nor does any
    other work for who wants remote alone, or hybrid work for who wants neither that nor an
    office. Then the same city of the same province counts in full, coordinates of whole
    provinces and countries or none say nothing, and 50 km count in full, 150 km half.
    """
    remote = F.coalesce(work == "remote", F.lit(False))
    wants_remote, only_remote = wish["remote"], wish["only"]
    apart = (work == "hybrid") & ~wish["there"]
    none = F.lit(None).cast("double")
    return (
        F.when(remote & wants_remote, 1.0)
        .when(remote | ((work != "remote") & only_remote) | apart, none)
        .when(same_city, 1.0)
        .when(accuracy.isin("state", "country") | metres.isNull(), none)
        .when(metres <= 50_000, 1.0)
        .when(metres <= 150_000, 0.5)
        .otherwise(0.0)
    )
