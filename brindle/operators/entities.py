"""Which organisations are one: identities of their URLs, clusters of their names, and scores of candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import bound, unaccent
from brindle.operators.components import connected_components
from brindle.operators.relational import word_prefix_pairs
from brindle.sources.tables import materialize

# Hosts that many organisations share, by kind.
SHARED = {
    "social_media": "facebook.com fb.com linkedin.com instagram.com twitter.com x.com youtube.com tiktok.com".split(),
    "marketplace": "panierdachat.app etsy.com shopify.com wixsite.com wix.com squarespace.com wordpress.com".split(),
    "ats_board": (
        "greenhouse.io lever.co workable.com bamboohr.com smartrecruiters.com jobvite.com icims.com myworkdayjobs.com dayforcehcm.com applytojob.com"
        " oraclecloud.com taleo.net successfactors.com successfactors.eu sapsf.com sapsf.eu myworkdaysite.com myworkday.com workforcenow.adp.com"
        " myjobs.adp.com recruiting.adp.com avature.net csod.com brassring.com paycomonline.com paylocity.com ukg.com ultipro.com recruitee.com"
        " ashbyhq.com breezy.hr jazz.co ceridian.com"
    ).split(),
    "shared_hosting": "linktr.ee bit.ly sites.google.com myshopify.com indeed.com glassdoor.com ecoworks.eco.ca eco.ca".split(),
}
# Parents under which each name is somebody else's.
PARENTS = "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz org.nz co.jp com.br co.in gc.ca".split()
#: Words that two names share at least before a place may tell them apart; letters of a name that is too short to trust.
CORE, SHORT = 2, 4
# Points of a candidate's evidence, and how many settle it.
NAME, SAME_SITE, OTHER_SITE, PROVINCE, CITY, ENOUGH = 50, 100, -100, 10, 5, 100


def spaced_key(x: Column) -> Column:
    """Folded words with a blank between them; everything but letters a-z and digits parts words. Null is empty."""
    return F.trim(F.regexp_replace(F.lower(unaccent(F.coalesce(x, F.lit("")))), "[^a-z0-9]+", " "))


def loose_spaced_key(x: Column) -> Column:
    """spaced_key without apostrophes, "and" and "et"."""
    words = F.split(spaced_key(F.regexp_replace(x, "['’‘ʼ‛]", "")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin("and", "et", "")), " ")


def normal_names(xs: Column) -> Column:
    """The distinct keys of several names in their order, blank ones left out; null gives none."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), spaced_key), lambda k: k != ""))


def alias_union(own: Column, *others: Column) -> Column:
    """Distinct names by key, in order, of own's aliases and others, without those whose key is own's. Each of others is an array."""
    all_ = F.filter(F.flatten(F.array_compact(F.array(*others))), lambda a: F.coalesce(F.trim(a), F.lit("")) != "")
    keyed = F.transform(all_, lambda a: F.struct(spaced_key(a).alias("key"), a.alias("name")))
    first = F.filter(keyed, lambda k: (k["key"] != spaced_key(own)) & (k["key"] != ""))
    return F.transform(F.filter(first, lambda k, i: F.array_position(F.transform(first, lambda x: x["key"]), k["key"]) == i + 1), lambda k: k["name"])


def host(url: Column) -> Column:
    """The host of a URL, with or without scheme, in lower case without "www." and "m."; null for what is none."""
    name = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)", 1)
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^\.+|\.+$", ""), r"^www\d?\.", ""), r"^m\.", "")
    return bound(name, lambda n: F.when(n.rlike("[a-z0-9]") & F.contains(n, F.lit(".")), n))


def _parents(name: Column) -> Column:
    """A host and all its parents, longest first."""
    return bound(F.split(name, r"\."), lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def shared_host(name: Column) -> Column:
    """The shared host that a host is or stands under, or null."""
    known = F.array(*[F.lit(h) for hosts in SHARED.values() for h in hosts])
    return F.get(F.array_intersect(_parents(name), known), F.lit(0))


def apex(name: Column) -> Column:
    """The employer's part of a host: its last two labels, three where those two are a common parent."""
    last = lambda x, n: F.substring_index(x, ".", -n)
    return bound(name, lambda x: F.when(last(x, 2).isin(PARENTS), last(x, 3)).otherwise(last(x, 2)))


def evidence(url: Column) -> Column:
    """The host of a URL, if it isn't a shared one."""
    return bound(host(url), lambda name: F.when(shared_host(name).isNull(), name))


def identity(url: Column) -> Column:
    """What in a URL is one organisation's: its apex; on shared hosts the subdomain, the path, or both; else null."""
    path = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*://)?[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", "")
    own = lambda name, shared: bound(path, lambda p: F.when(p != "", F.concat(name, F.lit("/"), p)).when(name != shared, name))
    return bound(host(url), lambda name: bound(shared_host(name), lambda shared: F.when(shared.isNull(), apex(name)).otherwise(own(name, shared))))


def platform(found: Column) -> Column:
    """The shared host of an identity; for others "unknown"."""
    return F.coalesce(shared_host(F.substring_index(found, "/", 1)), F.lit("unknown"))


def identity_kind(found: Column) -> Column:
    """employer_owned, or what its shared host is; invalid for a shared host itself, unknown for null and empty."""

    def told(own: Column, on: Column) -> Column:
        kind = F.lit("employer_owned")
        for name, hosts in SHARED.items():
            kind = F.when(on.isin(hosts), name).otherwise(kind)
        return F.when(on.isNull(), "unknown").when(own == on, "invalid").otherwise(kind)

    return bound(found, lambda own: bound(F.when(own != "", platform(own)), lambda on: told(own, on)))


def place_words(*parts: Column) -> Column:
    """Distinct words of places."""
    return F.array_distinct(F.filter(F.split(F.concat_ws(" ", *[spaced_key(p) for p in parts]), " "), lambda w: w != ""))


def places_agree(city_a: Column, city_b: Column, text_a: Column, text_b: Column) -> Column:
    """The same city, where both are known; a known city in the other's text, or no text; else a word of both texts, or no text."""
    a, b, ta, tb = (spaced_key(c) for c in (city_a, city_b, text_a, text_b))
    one = lambda city, text: (text == "") | F.contains(text, city)
    both = (ta == "") | (tb == "") | F.arrays_overlap(F.split(ta, " "), F.split(tb, " "))
    return F.when((a != "") & (b != ""), a == b).when(a != "", one(a, tb)).when(b != "", one(b, ta)).otherwise(both)


def organization_edges(orgs: DataFrame) -> DataFrame:
    """Links (a, b) between organisations (id, name, website, city, province, location) that may be one.

    Those of one key link to the smallest id. A key that is another's with place words after it
    links to that, where their smallest ids' places agree and those words are of the longer one's
    place. Keys of one loose key link where their sites' apexes don't conflict. Names without a
    word never link. All are equi-joins and aggregations. What the joins need of a row is worked
    out once and written.
    """
    rows = orgs.select(
        "id", spaced_key(F.col("name")).alias("key"), loose_spaced_key(F.col("name")).alias("loose"), apex(evidence(F.col("website"))).alias("apex"),
        F.col("city"), F.col("location"), place_words(F.col("city"), F.col("province"), F.col("location")).alias("words"),
    )
    rows = materialize(rows, "organizations").where("key <> ''")
    first = materialize(rows.groupBy("key").agg(F.min_by(F.struct("id", "city", "location", "words"), "id").alias("rep")), "keys")
    same = rows.join(first, "key").select(F.col("id").alias("a"), F.col("rep.id").alias("b"))
    side = lambda c: first.select(F.col("key").alias(c), F.col("rep").alias(f"_{c}"))
    pairs = word_prefix_pairs(first, "key", CORE).join(side("short"), "short").join(side("long"), "long")
    rest = F.filter(F.split(F.expr("substring(long, length(short) + 2)"), " "), lambda w: w != "")
    agree = places_agree(F.col("_short.city"), F.col("_long.city"), F.col("_short.location"), F.col("_long.location"))
    suffix = pairs.where(agree & (F.size(F.array_except(rest, F.col("_long.words"))) == 0)).select(F.col("_long.id").alias("a"), F.col("_short.id").alias("b"))
    told = rows.where("loose <> ''").groupBy("loose").agg(F.min("id").alias("b"), F.count_distinct("key").alias("keys"), F.count_distinct("apex").alias("apexes"))
    loose = rows.join(told.where("keys > 1 and apexes <= 1"), "loose").select(F.col("id").alias("a"), "b")
    return same.unionByName(suffix).unionByName(loose).where("a <> b").distinct()


def organization_clusters(orgs: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(cluster, label, n, survivor, bucket, why) of clusters of two organisations or more; orgs has jobs, too.

    cluster is the smallest id; label the key of the fewest words. bucket is skip where sites
    conflict, review where sites are shared ones only, keys differ, the label is short, or a site is
    missing, and else merge. The survivor has a site, then the most jobs, then the smallest id.
    """
    parts = connected_components(organization_edges(orgs) if edges is None else edges)
    key, site = spaced_key(F.col("name")), evidence(F.col("website"))
    rows = orgs.join(parts, F.col("id") == F.col("node")).withColumns({"key": key, "site": site})
    filled = F.coalesce(F.trim("website"), F.lit("")) != ""
    told = rows.groupBy(F.col("component").alias("cluster")).agg(
        F.min_by("key", F.struct(F.size(F.split("key", " ")), "key")).alias("label"), F.count(F.lit(1)).alias("n"),
        F.min_by("id", F.struct(F.col("site").isNull(), -F.col("jobs"), "id")).alias("survivor"),
        F.count_distinct(apex(F.col("site"))).alias("_apexes"), F.count_distinct("key").alias("_keys"), F.count_if(F.col("site").isNull()).alias("_missing"),
        F.max(filled).alias("_filled"),
    )
    why = (
        F.when(F.col("_apexes") > 1, "conflicting sites").when(F.col("_filled") & (F.col("_missing") == F.col("n")), "shared sites").when(F.col("_keys") > 1, "near names")
        .when(F.length(F.replace("label", F.lit(" "), F.lit(""))) <= SHORT, "short name").when(F.col("_missing") > 0, "missing sites").otherwise("same site")
    )
    told = told.withColumn("why", why)
    bucket = F.when(F.col("why") == "conflicting sites", "skip").when(F.col("why") == "same site", "merge").otherwise("review")
    return told.select("cluster", "label", "n", "survivor", bucket.alias("bucket"), "why")


def site_conflicts(orgs: DataFrame, portals: Sequence[str] = ()) -> DataFrame:
    """(site, n, first, last, cities_differ) of sites that several organisations (id, website, city) have, without portals; first and last are ids."""
    city = F.nullif(F.lower(F.trim("city")), F.lit(""))
    rows = orgs.select("id", evidence(F.col("website")).alias("site"), city.alias("city")).where(F.col("site").isNotNull() & ~F.col("site").isin(list(portals)))
    told = rows.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), (F.count_distinct("city") > 1).alias("cities_differ"))
    return told.where("n > 1")


def resolve(postings: DataFrame, orgs: DataFrame) -> DataFrame:
    """(id, org, score, decision) for each posting (id, name, website, province, city) against orgs (org, name, aliases, website, location).

    Candidates share a key of name or alias, or the identity of their site. decision is merge
    from ENOUGH points; create where no candidate has the name, or all that have it are of other
    sites; else block. org and score are the best candidate's, of the smallest id among equals;
    null without candidates.
    """
    posts = postings.select("id", spaced_key(F.col("name")).alias("key"), identity(F.col("website")).alias("site"), spaced_key(F.col("province")).alias("province"), spaced_key(F.col("city")).alias("city"))
    known = orgs.select(
        "org", normal_names(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("keys"), identity(F.col("website")).alias("own_site"),
        F.split(spaced_key(F.col("location")), " ").alias("place"),
    )
    # both are read by several joins
    posts, known = materialize(posts, "postings"), materialize(known, "candidates")
    by_name = posts.where("key <> ''").join(known.select("org", "own_site", "place", F.explode("keys").alias("key")), "key").withColumn("named", F.lit(True))
    by_site = posts.join(known.where("own_site is not null"), F.col("site") == F.col("own_site")).withColumn("named", F.lit(False))
    named, sites = F.col("named"), F.col("site").isNotNull() & F.col("own_site").isNotNull()
    other = F.coalesce(sites & (F.col("site") != F.col("own_site")), F.lit(False))
    held = lambda c, points: F.when((F.col(c) != "") & F.array_contains("place", F.col(c)), points).otherwise(0)
    score = F.when(named, NAME).otherwise(0) + F.when(named & sites, F.when(other, OTHER_SITE).otherwise(SAME_SITE)).otherwise(0) + held("province", PROVINCE) + held("city", CITY)
    # a pair that name and site both give has one site, so that its row by name scores more
    scored = [rows.select("id", "org", score.alias("score"), (named & ~other).alias("open")) for rows in (by_name, by_site)]
    best = scored[0].unionByName(scored[1]).groupBy("id").agg(F.min_by(F.struct("org", "score"), F.struct(-F.col("score"), "org")).alias("best"), F.max("open").alias("open"))
    found = posts.select("id", "key").join(best, "id", "left")
    decision = F.when(F.col("best.score") >= ENOUGH, "merge").when(F.coalesce("open", F.lit(False)), "block").otherwise("create")
    return found.select("id", F.col("best.org").alias("org"), F.col("best.score").alias("score"), decision.alias("decision"))
