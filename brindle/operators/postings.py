"""Near-duplicate postings: one employer, the same role, close dates, and texts that don't speak against it.

Frames have the columns id, org, title, url, posted (a day as text), body, city, province,
kind and source; all but id may be null. Rows without url, org or a word in the title are
never linked. Rows of one URL count as one posting.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from brindle.functions import sequences
from brindle.functions.numbers import parse_posted
from brindle.functions.places import province_code
from brindle.functions.text import fold, jaccard, normal_url
from brindle.operators.components import connected_components
from brindle.sources.tables import materialize

# Words that don't tell titles apart, and words that may be missing from one of two like titles.
STOP = "a an and at for in of on or the to with".split()
FLUFF = "new volunteer volunteering temporary contract urgent asap ft pt fulltime parttime full part time".split()
# Boards whose national hosts are one board.
BOARDS = ["indeed.com", "linkedin.com", "glassdoor.com"]
#: Days between two postings of one opening, at most.
DAYS = 21
#: The fewest characters of a body that say anything.
THIN = 80
#: How alike bodies of a sure posting are: in the same city on another board, and elsewhere.
ACROSS, ALIKE = 0.7, 0.9
#: Texts of one role are compared by blocks of so many rows and characters; roles of up to POOL texts share blocks.
ROWS, CHARS, POOL = 512, 1_000_000, 64


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts, as difflib has it; null where either is null."""
    return pd.Series([None if x is None or y is None else 1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def ratio_from(a: pd.Series, b: pd.Series, need: pd.Series) -> pd.Series:
    """sequence_ratio, or null where it's below need."""
    return pd.Series([None if x is None or y is None else sequences.ratio(x, y, least) for x, y, least in zip(a, b, need)], dtype="float64")


def role_tokens(title: Column) -> Column:
    """Sorted distinct words of a title without stop words, plural s and a glued "new"."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^a-z0-9]+", " "), " ")
    kept = lambda w: (w != "") & ~w.isin(STOP)
    glued = F.transform(F.filter(words, kept), lambda w: F.when((F.length(w) > 5) & w.endswith("new"), F.regexp_replace(w, "new$", "")).otherwise(w))
    single = F.transform(glued, lambda w: F.when((F.length(w) > 3) & w.rlike("[^s]s$"), F.regexp_replace(w, "s$", "")).otherwise(w))
    return F.array_sort(F.array_distinct(F.filter(single, kept)))


def posted_day(x: Column) -> Column:
    """A day at the start of a text as days since 1970; other texts give null."""
    head = F.replace(F.substring(F.trim(x), 1, 10), F.lit("/"), F.lit("-"))
    return F.datediff(F.coalesce(parse_posted(head), parse_posted(F.trim(x))).cast("date"), F.lit("1970-01-01").cast("date"))


def board(url: Column) -> Column:
    """Host of a listing without www; national hosts of known boards as one."""
    host = F.regexp_replace(F.nullif(F.regexp_extract(F.lower(url), r"^[a-z]+://([^/:?#]+)", 1), F.lit("")), r"^www\.", "")
    short = F.regexp_replace(host, r"^[a-z]{2}\.(?=[^.]+\.[^.]+$)", "")
    return F.when(short.isin(BOARDS), short).when(host.isin("indeed.ca", "glassdoor.ca"), F.regexp_replace(host, "ca$", "com")).otherwise(host)


def _prepared(df: DataFrame, *more: str) -> DataFrame:
    fluff = F.array(*map(F.lit, FLUFF))
    low = F.lower(F.coalesce("body", F.lit("")))
    hours = F.regexp_extract_all(low, F.lit(r"(?<![\p{L}\d_])(\d{1,2}\s*(?:hours?|h(?:eures?)?))(?![\p{L}\d_])"), F.lit(1))
    # each long text is gone through once: later columns refer to columns, which Spark doesn't compute again
    rows = df.select(
        "id", "org", normal_url(F.col("url")).alias("url"), role_tokens(F.col("title")).alias("words"), posted_day(F.col("posted")).alias("day"),
        F.nullif(fold(F.col("city")), F.lit("")).alias("city"), province_code(F.col("province")).alias("prov"),
        F.nullif(F.trim("province"), F.lit("")).isNotNull().alias("has_prov"), F.nullif(F.lower(F.trim("kind")), F.lit("")).alias("kind"), "source",
        F.trim(F.regexp_replace(low, r"\s+", " ")).alias("_head"), F.trim(F.regexp_replace(F.regexp_replace(low, "<[^>]+>", " "), r"\s+", " ")).alias("_plain"),
        F.length(F.coalesce("body", F.lit(""))).alias("size"), hours.alias("_hours"), *more,
    )
    rows = rows.select(
        *[c for c in rows.columns if c[0] != "_"], F.when(F.length("_head") >= THIN, F.col("_head")).alias("head"), F.when(F.length("_plain") >= THIN, F.sha2("_plain", 256)).alias("clone"),
        F.array_sort(F.array_distinct(F.transform("_hours", lambda h: F.regexp_replace(h, r"\s", "")))).alias("hours"),
    )
    rows = rows.where("org is not null and url <> '' and size(words) > 0")
    # two titles without distinctive leftovers have the same words but for fluff: an equi-join finds all of them
    return rows.withColumn("core", F.array_join(F.array_except("words", fluff), " "))


def _near(a: DataFrame, b: DataFrame, key: list[Column]) -> DataFrame:
    """a and b (columns a_…, b_…) joined on key and days (from lo to hi, within one band) at most DAYS apart; a missing day is near to all.

    Days meet by bands of DAYS, so a role that is posted for years isn't compared throughout.
    """
    left = a.where("a_lo is not null").withColumn("_slot", F.explode(F.array(*[_band(F.col("a_lo")) + i for i in (-1, 0, 1)])))
    right = b.where("b_lo is not null").withColumn("_band", _band(F.col("b_lo")))
    close = (F.col("a_lo") - F.col("b_hi") <= DAYS) & (F.col("b_lo") - F.col("a_hi") <= DAYS)
    dated = left.join(right, [*key, F.col("_slot") == F.col("_band"), close]).drop("_slot", "_band")
    return dated.unionByName(a.where("a_lo is null").join(b, key)).unionByName(a.where("a_lo is not null").join(b.where("b_lo is null"), key))


def _band(day: Column) -> Column:
    return F.floor(day / DAYS)


def _role() -> list[Column]:
    """One employer and one role."""
    return [F.col("a_org") == F.col("b_org"), F.col("a_core") == F.col("b_core")]


def _sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns]) for side in "ab")


def _spread(pairs: DataFrame, *columns: str) -> DataFrame:
    """pairs over all shuffle partitions: ratios cost far more than their bytes tell, so small parts must not be merged."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*columns))


def _titled(pairs: DataFrame) -> DataFrame:
    """pairs with alike (shared part of the words) and order (ratio of the sorted words, where alike doesn't settle it)."""
    pairs = pairs.withColumn("alike", jaccard(F.col("a_words"), F.col("b_words")))
    text = lambda c: F.when(F.col("alike") < 0.7, F.array_join(c, " "))
    return pairs.withColumn("order", F.coalesce(sequence_ratio(text("a_words"), text("b_words")), F.lit(1.0)))


def clusters(df: DataFrame) -> DataFrame:
    """(id, cluster, keeper, n): rows of groups with two URLs or more; cluster is the smallest id of the group.

    Rows of one employer, title, city and day are one class; classes, not rows, are paired.
    Bodies are compared only where titles and cities leave it open, each distinct pair once,
    and not where their lengths rule it out. keeper has a full body, then values, a summary and
    any body (where df has the columns values and summary), then the longest body, was seen last
    (column scraped), and has the smallest id.
    """
    filled = {"values": F.size("values") > 0, "summary": F.coalesce(F.trim("summary"), F.lit("")) != "", "scraped": F.col("scraped")}
    extra = [F.coalesce(c, F.lit("" if n == "scraped" else False)).alias(f"k_{n}") for n, c in filled.items() if n in df.columns]
    rows = materialize(_prepared(df, *extra).withColumn("cls", F.to_json(F.struct("org", "words", "city", "day"))), "postings")
    classes = rows.groupBy("cls", "org", "core", "words", "city", "day").agg(F.min("id").alias("rep"))
    classes = materialize(classes.withColumns({"same": F.to_json(F.struct("org", "words", "city")), "lo": F.col("day"), "hi": F.col("day")}), "posting-classes")
    # classes that differ in their days alone are chained from day to day; only others are paired
    pairs = _titled(_near(*_sides(classes), [*_role(), F.col("a_same") != F.col("b_same"), F.col("a_rep") < F.col("b_rep")]))
    role = (F.col("alike") >= 0.7) | (F.col("order") >= 0.85)
    conflict = F.coalesce(F.col("a_city") != F.col("b_city"), F.lit(False))
    need = F.when(role & ~conflict, 0.0).when(role, 0.55).when(F.col("alike") >= 0.5, 0.55).when(F.col("order") >= 0.7, 0.6)
    pairs = materialize(pairs.select("a_rep", "b_rep", "a_cls", "b_cls", need.alias("need")).where("need is not null"), "posting-pairs")
    bodies = rows.where("head is not null").select("cls", "head").distinct()
    a, b = _sides(bodies)
    open_ = pairs.where("need > 0").join(a, "a_cls").join(b, "b_cls")
    shorter, both = F.least(F.length("a_head"), F.length("b_head")), F.length("a_head") + F.length("b_head")
    close = _spread(open_.where(2 * shorter / both >= F.col("need")), "a_head", "b_head").withColumn("ratio", ratio_from("a_head", "b_head", "need")).where("ratio is not null")
    edges = (
        rows.join(classes.select("cls", "rep"), "cls").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        .unionByName(_chained(classes)).unionByName(pairs.where("need = 0").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")))
        .unionByName(close.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).distinct())
    )
    found = rows.join(connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id")
    have = lambda n: [F.col(f"k_{n}")] if n in df.columns else []
    order = F.struct(F.col("head").isNotNull(), *have("values"), *have("summary"), F.col("size") > 0, "size", *have("scraped"), -F.col("id"))
    told = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max_by("id", order).alias("keeper"), F.count_distinct("url").alias("urls"))
    return found.select("id", "cluster").join(told.where("urls > 1"), "cluster").select("id", "cluster", "keeper", "n")


def _chained(classes: DataFrame) -> DataFrame:
    """(a, b): classes (rep, day) of equal `same`, linked so that those join which days of at most DAYS in between connect, and all where one has no day.

    Each stretch of days is one chain, of which every class links to the first; a window holds a role's days, one row each.
    """
    order = Window.partitionBy("same").orderBy("day")
    cut = F.coalesce((F.col("day") - F.lag("day").over(order) > DAYS).cast("int"), F.lit(0))
    dated = classes.where("day is not null").withColumn("_cut", cut).withColumn("_chain", F.sum("_cut").over(order)).select("same", "_chain", "rep")
    first = dated.groupBy("same", "_chain").agg(F.min("rep").alias("b"))
    vague = classes.where("day is null").select("same", F.col("rep").alias("a"))
    return dated.join(first, ["same", "_chain"]).select(F.col("rep").alias("a"), "b").unionByName(vague.join(first, "same").select("a", "b"))


def _two_least(df: DataFrame, *key: str) -> DataFrame:
    """(key, first, second) of rows (key, id, url): the smallest id with its URL, and the smallest with another URL."""
    first = df.groupBy(*key).agg(F.min(F.struct("id", "url")).alias("first"))
    other = df.join(first, [*key]).where(F.col("url") != F.col("first.url")).groupBy(*key).agg(F.min(F.struct("id", "url")).alias("second"))
    return first.join(other, [*key], "left")


_CONTENT = "org words city prov has_prov kind source clone hours core number host".split()


def compared(df: DataFrame) -> DataFrame:
    """What the rows of df are compared by: words, core, day, city, province, kind, head and clone of the body, hours, listing number and host."""
    number = F.nullif(F.regexp_extract("url", r"(?i)(?:/job/[^/\s]*-|jobId=)(\d{4,})", 1), F.lit(""))
    return _prepared(df, *[c for c in ("new", "known") if c in df.columns]).withColumn("number", number).withColumn("host", board(F.col("url")))


def _by_content(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Compared rows of df without their texts, with cls, the name of their content; and (row, head), the texts.

    Rows of a class differ in day, id, URL and the columns new and known of df only.
    """
    texts = materialize(compared(df).withColumn("row", F.monotonically_increasing_id()), f"{label}-compared")  # written first: the hash would have all its columns worked out again
    cls = F.sha2(F.to_json(F.struct(*_CONTENT, F.sha2("head", 256).alias("head"))), 256)
    return materialize(texts.withColumns({"cls": cls, "long": F.length("head")}).drop("head", "size"), label), texts.select("row", "head")


def _sure_pairs(rows: DataFrame, texts: DataFrame, left: Column, right: Column, whole: Column) -> DataFrame:
    """(of, cls): classes of rows that meet left, each with those that meet right and are surely the same posting, if their days are close.

    Days decide nothing else, so contents are compared once, on whatever days they are posted.
    Classes with one listing number or body meet by the stretch of days that they have in each
    band. Other bodies are compared as whole texts, by blocks of a role; of these pairs those are
    left out that can't name the smallest id: rows that don't meet whole need an id smaller than
    the other's, and a row with a partner needs none of larger ids.

    The role must be the same; then a shared listing number decides, or, with no conflict of
    city, hours and kind, equal bodies, bodies 0.9 alike, or 0.7 in the same city on another board.
    """
    key = F.explode(F.array_compact(F.array(F.concat(F.lit("n"), "number"), F.concat(F.lit("c"), "clone"))))
    spans = rows.groupBy("cls", _band(F.col("day")).alias("_b")).agg(
        F.min("day").alias("lo"), F.max("day").alias("hi"), F.max(left).alias("left"), F.max(right).alias("right"), *[F.any_value(c).alias(c) for c in _CONTENT]
    )
    spans = materialize(spans.drop("_b").withColumn("key", key), "posting-spans")
    pairs = _near(_sides(spans.where("left"))[0], _sides(spans.where("right"))[1], [*_role(), F.col("a_key") == F.col("b_key")])
    pairs = _titled(pairs).where("alike >= 0.7 or order >= 0.85")
    listed = F.coalesce(F.col("a_number") == F.col("b_number"), F.lit(False))
    vague = (F.col("a_has_prov") & F.col("a_prov").isNull()) | (F.col("b_has_prov") & F.col("b_prov").isNull())
    other_prov = F.coalesce(F.col("a_prov") != F.col("b_prov"), F.lit(False))
    cities = F.col("a_city").isNotNull() & F.col("b_city").isNotNull()
    same = cities & F.coalesce(F.col("a_city") == F.col("b_city"), F.lit(False)) & ~other_prov & ~vague
    hours = (F.size("a_hours") > 0) & (F.size("b_hours") > 0) & (F.col("a_hours") != F.col("b_hours"))
    veto = (cities & ~same) | hours | F.coalesce(F.col("a_kind") != F.col("b_kind"), F.lit(False))
    clone = F.coalesce(F.col("a_clone") == F.col("b_clone"), F.lit(False))
    sure = pairs.where(listed | (~veto & clone)).select(F.col("a_cls").alias("of"), F.col("b_cls").alias("cls")).distinct()
    return materialize(sure.unionByName(_alike_texts(rows, texts, left, right, whole)), "posting-hits")


def _alike_texts(rows: DataFrame, texts: DataFrame, left: Column, right: Column, whole: Column) -> DataFrame:
    """(of, cls): classes that neither number nor body makes sure, but the ratio of their whole texts; see _sure_pairs."""
    bodied = rows.where("long is not null")
    first = F.struct("id", "url", "day", (~whole).alias("later"))  # of one id that which meets whole
    classes = bodied.groupBy("cls").agg(
        *[F.any_value(c).alias(c) for c in [*_CONTENT, "long"]], F.min("row").alias("row"), F.min("day").alias("lo"), F.max("day").alias("hi"), F.max(F.col("day").isNull()).alias("undated"),
        F.count_if(left).alias("asks"), F.min(F.when(left, first)).alias("asking"), F.max(F.when(left, F.struct("id"))).alias("last"),
        F.min(F.when(right, first)).alias("answer"), F.max(F.when(right, whole)).alias("whole"), F.count(F.lit(1)).alias("n"),
    )
    classes = materialize(classes, "posting-classes")
    sizes = classes.groupBy("org", "core").agg(F.count(F.lit(1)).alias("_n"), F.sum("long").alias("_long"), F.max((F.col("n") > 1) & F.col("clone").isNull()).alias("_self"))
    # large roles are dealt out by the lengths of their texts, as texts of very unlike lengths aren't alike
    band = F.when((F.col("_n") > ROWS) | (F.col("_long") > CHARS), F.floor(F.log("long") / F.log(F.lit(1.25)))).otherwise(0)
    pool = F.when((F.col("_n") <= POOL) & (F.col("_long") <= CHARS // 8), F.pmod(F.xxhash64("org", "core"), F.lit(-(-2 * classes.count() // ROWS) + 1)).cast("string"))
    crowd = F.coalesce(pool, F.to_json(F.struct("org", "core")))
    classes = classes.join(sizes.where("_n > 1 or _self"), ["org", "core"]).withColumns({"band": F.when(pool.isNull(), band).otherwise(0), "crowd": crowd}).drop("_n", "_long", "_self")
    bands = classes.groupBy("crowd", "band").agg(F.greatest(F.ceil(F.sum("long") / CHARS), F.ceil(F.count(F.lit(1)) / ROWS)).alias("_parts"))
    classes = classes.join(bands, ["crowd", "band"]).withColumn("block", F.struct("band", F.when(F.col("crowd").startswith("{"), F.pmod(F.xxhash64("cls"), F.col("_parts"))).otherwise(0).alias("part"))).drop("band", "_parts")
    classes = materialize(classes, "posting-blocks")
    blocks = classes.groupBy("crowd", "block").agg(F.min("long").alias("least"), F.max("long").alias("most"), F.max(F.col("asks") > 0).alias("asks"), F.max(F.col("answer").isNotNull()).alias("answers"))
    reach = lambda x, y: F.col(f"{x}_most") * (2 - ACROSS) >= F.col(f"{y}_least") * ACROSS
    useful = (F.col("a_asks") & F.col("b_answers")) | (F.col("b_asks") & F.col("a_answers"))
    a, b = _sides(blocks)
    met = a.join(b, [F.col("a_crowd") == F.col("b_crowd"), F.col("a_block") <= F.col("b_block"), reach("a", "b"), reach("b", "a"), useful])
    ends = F.array_distinct(F.array("a_block", "b_block"))
    met = met.select(F.col("a_crowd").alias("crowd"), F.struct("a_block", "b_block").alias("pair"), F.explode(ends).alias("block"))
    dealt = classes.join(met, ["crowd", "block"]).join(texts, "row").withColumn("second", F.col("block") == F.col("pair.b_block")).withColumn("alone", F.col("pair.a_block") == F.col("pair.b_block"))
    # as many parts as named: ratios cost far more than their bytes tell, so small parts must not be merged
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    return dealt.drop("block", "row").repartition(parts, "crowd", "pair").groupBy("crowd", "pair").applyInPandas(_block_hits, "of string, cls string")


def _block_hits(rows: pd.DataFrame) -> pd.DataFrame:
    """(of, cls) of the classes of two blocks, or of one block with itself (alone), by the rules of _sure_pairs.

    A row's partners are gone through from the smallest id on, up to one that no other can go before.
    """
    alone = bool(rows["alone"].iloc[0])
    sides = [rows] if alone else [rows[~rows["second"]], rows[rows["second"]]]
    sides = [x.reset_index(drop=True) for x in sides]
    blocks = [sequences.Block(x["head"]) for x in sides]
    ways = [(0, 0)] if alone else [(0, 1), (1, 0)]
    needs = [_needs(sides[i], sides[j]) for i, j in ways]
    may = sequences.possible(blocks[0], blocks[-1], needs[0] if alone else needs, not alone)
    hits = []
    for (i, j), need, open_ in zip(ways, needs, may):
        a, b = sides[i], sides[j]
        answers = list(b["answer"])
        for n in np.flatnonzero(open_.any(1)):
            mine = a["asking"][n] if a["asks"][n] == 1 else None
            for m in sorted(np.flatnonzero(open_[n]), key=lambda m: answers[m]["id"]):
                if sequences.ratio(blocks[i].texts[n], blocks[j].texts[m], need[n, m], blocks[j].at(m)) is None:
                    continue
                hits.append((a["cls"][n], b["cls"][m]))
                if mine is not None and _settles(mine, answers[m]):
                    break
    return pd.DataFrame(hits, columns=["of", "cls"])


def _settles(asking: dict, answer: dict) -> bool:
    """Whether a row's partner counts as such by URL, day and id, so that no partner of a larger id is of use."""
    close = any(x["day"] is None for x in (asking, answer)) or abs(asking["day"] - answer["day"]) <= DAYS
    return asking["url"] != answer["url"] and close and (not answer["later"] or answer["id"] < asking["id"])


def _needs(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """How alike the texts of a and b must be, by the rules of _sure_pairs; NaN where the ratio decides nothing."""

    def both(column: str, of=lambda x: x) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the values are there on both sides and equal, there and unlike, and there at all."""
        x, y = (pd.Series([None if v is None else of(v) for v in side[column]], dtype=object) for side in (a, b))
        codes = pd.factorize(pd.concat([x, y]))[0]
        p, q = codes[: len(x), None], codes[None, len(x) :]
        there = (p >= 0) & (q >= 0)
        return there & (p == q), there & (p != q), there

    flag = lambda f, *columns: [np.array([f(*v) for v in zip(*(side[c] for c in columns))], dtype=bool) for side in (a, b)]
    numbers, clones, hours, kinds = both("number")[0], both("clone")[0], both("hours", lambda h: ",".join(h) or None)[1], both("kind")[1]
    city, _, cities = both("city")
    vague = np.logical_or.outer(*flag(lambda has, prov: has and prov is None, "has_prov", "prov"))
    same = city & ~both("prov")[1] & ~vague
    _, sources, sourced = both("source")
    hosts, boards = both("host")[1], np.logical_and.outer(*flag(lambda host: host in BOARDS, "host"))
    cross = np.where(sourced, sources | (hosts & boards), hosts)
    low = lambda side, c, none: side[c].astype("float64").fillna(none).to_numpy()
    near = (low(a, "lo", -np.inf)[:, None] - low(b, "hi", np.inf)[None] <= DAYS) & (low(b, "lo", -np.inf)[None] - low(a, "hi", np.inf)[:, None] <= DAYS)
    near |= np.logical_or.outer(*flag(bool, "undated"))
    last, first = ([None if x is None else x["id"] for x in column] for column in (a["last"], b["answer"]))
    rank = {x: n for n, x in enumerate(sorted({*last, *first} - {None}))}
    smaller = np.array([rank.get(x, -1) for x in first])[None] < np.array([rank.get(x, -1) for x in last])[:, None]
    useful = (a["asks"].to_numpy() > 0)[:, None] & np.array([x is not None for x in first])[None] & (smaller | np.array([w is True for w in b["whole"]])[None])
    open_ = both("org")[0] & both("core")[0] & useful & near & ~numbers & ~clones & ~((cities & ~same) | hours | kinds)
    open_ &= _same_titles(a["words"], b["words"], open_)
    return np.where(open_, np.where(same & cross, ACROSS, ALIKE), np.nan)


def _same_titles(a: pd.Series, b: pd.Series, open_: np.ndarray) -> np.ndarray:
    """Where two lists of words are the title of one role, of the pairs that are open; each two distinct ones are compared once."""

    def same(x: str, y: str) -> bool:
        one, other = {*x.split()}, {*y.split()}
        return len(one & other) / len(one | other) >= 0.7 or SequenceMatcher(None, x, y).ratio() >= 0.85

    (p, left), (q, right) = (pd.factorize(np.array([" ".join(w) for w in side], dtype=object)) for side in (a, b))
    table = np.zeros((len(left), len(right)), dtype=bool)
    for n in np.unique((p[:, None] * len(right) + q[None])[open_]):
        x, y = divmod(int(n), len(right))
        table[x, y] = same(left[x], right[y])
    return table[p[:, None], q[None]]


def _first_partners(rows: DataFrame, hits: DataFrame, partners: DataFrame, earlier: bool) -> DataFrame:
    """(id, duplicate_of): of each row's class's partners whose days are close the smallest id of another URL.

    Of a class and day only the smallest id and the smallest of another URL are needed, whatever their number.
    """
    none = -(2**31)  # stands for a missing day
    least = _two_least(partners.select("cls", F.coalesce("day", F.lit(none)).alias("_day"), "id", "url"), "cls", "_day")
    least = least.select("cls", F.nullif("_day", F.lit(none)).alias("lo"), F.nullif("_day", F.lit(none)).alias("hi"), "first", "second")
    asked = rows.select("id", "url", F.col("day").alias("lo"), F.col("day").alias("hi"), F.col("cls").alias("of")).join(hits, "of").drop("of")
    met = _near(_sides(asked)[0], _sides(least)[1], [F.col("a_cls") == F.col("b_cls")])
    found = F.when(F.col("b_first.url") != F.col("a_url"), F.col("b_first.id")).otherwise(F.col("b_second.id"))
    told = met.groupBy(F.col("a_id").alias("id")).agg(F.min(found).alias("duplicate_of")).where("duplicate_of is not null")
    return told.where("duplicate_of < id") if earlier else told


def _flagged(new: DataFrame, known: DataFrame) -> DataFrame:
    yes, no = F.lit(True), F.lit(False)
    if known is new:
        return new.withColumns({"new": yes, "known": yes})
    columns = [c for c in new.columns if c in known.columns]
    return new.select(*columns).withColumns({"new": yes, "known": no}).unionByName(known.select(*columns).withColumns({"new": no, "known": yes}))


def confident_duplicates(new: DataFrame, known: DataFrame, earlier: bool = False) -> DataFrame:
    """(id, duplicate_of): rows of new that are surely a known posting of another URL, and the smallest id of such.

    earlier takes only known postings of smaller ids. Rows of equal content are one class, and
    classes are paired, by the rules of _sure_pairs.
    """
    rows, texts = _by_content(_flagged(new, known), "postings")
    return _first_partners(rows.where("new"), _sure_pairs(rows, texts, F.col("new"), F.col("known"), F.lit(not earlier)), rows.where("known"), earlier)


def surely_there(new: DataFrame, stored: DataFrame) -> DataFrame:
    """(id): rows of new that are surely a stored posting, or an earlier one of new itself; contents are prepared and paired once for both."""
    rows, texts = _by_content(_flagged(new, stored), "postings")
    hits = _sure_pairs(rows, texts, F.col("new"), F.lit(True), F.col("known"))
    fresh = rows.where("new")
    return _first_partners(fresh, hits, rows.where("known"), False).unionByName(_first_partners(fresh, hits, fresh, True)).select("id").distinct()
