"""Full-text search by an inverted index with positions: prefixes, phrases, excluded words and alternatives, for many searches at once."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from brindle.functions.stems import STOPS, stem
from brindle.sources.tables import materialize

_WORD = re.compile(r"[^\W_]+")
#: Words after which a worker hands the rows of its texts on.
FLUSH = 500_000


class Part(NamedTuple):
    """Lexemes that must stand at these distances from a start, or mustn't (minus); or one that words begin with (prefix)."""

    lexemes: tuple[tuple[int, str], ...]
    minus: bool = False
    prefix: bool = False


def parse(wanted: str, language: str) -> list[list[Part]]:
    """The alternatives of a search, each a list of parts: a word alone is a prefix, else words, "phrases", -excluded ones and or.

    What has several words, as self-help, is a phrase. Stop words only keep their distance
    in phrases; alternatives of nothing else are left out.
    """

    def lexemes(x: str) -> tuple[tuple[int, str], ...]:
        words = [(i, w) for i, w in enumerate(_WORD.findall(x.lower())) if w not in STOPS[language]]
        return tuple((i - words[0][0], stem(w, language)) for i, w in words)

    wanted = wanted.strip()
    if _WORD.fullmatch(wanted):
        found = lexemes(wanted)
        return [[Part(found, prefix=True)]] if found else []
    alternatives: list[list[Part]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', wanted):
        if word.lower() == "or" and not minus:
            alternatives.append([])
        elif found := lexemes(phrase or word):
            alternatives[-1].append(Part(found, bool(minus)))
    return [parts for parts in alternatives if parts]


def build(docs: DataFrame, key: str, text: Column, language: str) -> DataFrame:
    """(key, lexeme, positions): where in each text its lexemes stand, in order; stop words count as places and have no rows.

    The key is unique; rows of a null key, and null or wordless texts, have no rows. Words are
    runs of letters and digits in lower case. A document's rows are made where it is read:
    nothing is shuffled, and a distinct word of some texts is stemmed once for them.
    """
    stops = STOPS[language]
    out = StructType([docs.schema[key], StructField("lexeme", StringType()), StructField("positions", ArrayType(IntegerType()))])

    def made(keys: pa.Array, lengths: np.ndarray, words: list[str]) -> pa.RecordBatch:
        """The rows of some texts in order; words are those of all of them."""
        coded = pa.array(words, pa.string()).dictionary_encode()
        stems = pa.array([None if w in stops else stem(w, language) for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
        lexeme = stems.indices.fill_null(-1).to_numpy()[coded.indices.to_numpy()] if words else np.zeros(0, np.int32)
        # one number for text and lexeme; places stay in order within it
        n = max(len(stems.dictionary), 1)
        by = np.repeat(np.arange(len(lengths)), lengths) * n + lexeme
        place = (np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        by, place = by[lexeme >= 0], place[lexeme >= 0]
        order = np.argsort(by, kind="stable")
        by, place = by[order], place[order]
        starts = np.flatnonzero(np.r_[True, by[1:] != by[:-1]][: len(by)])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(by)].astype(np.int32)), pa.array(place))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(by[starts] // n)), stems.dictionary.take(pa.array(by[starts] % n)), lists], names=out.names)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, lengths, words = 0, [], []
            for i, x in enumerate(batch.column(1)):
                found = _WORD.findall(x.as_py().lower())
                lengths.append(len(found))
                words += found
                if len(words) > FLUSH or i == len(batch) - 1:
                    yield made(batch.column(0).slice(first, len(lengths)), np.array(lengths), words)
                    first, lengths, words = i + 1, [], []

    rows = docs.where(F.col(key).isNotNull()).select(key, text.alias("_text")).where(F.col("_text").isNotNull())
    return rows.mapInArrow(postings, out)


def lexicon(index: DataFrame, languages: Sequence[str]) -> DataFrame:
    """(word, and a column for each language with its lexeme, null for stop words) of an index of words as they stand.

    With it find() searches that index by stems: a distinct word is stemmed once for all
    documents, and texts are indexed once for all languages.
    """
    names = list(dict.fromkeys(languages))

    def stemmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            each = [pa.array([None if w in STOPS[n] else stem(w, n) for w in words], pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *each], names=["word", *names])

    # dealt anew, as few words in one partition would all be stemmed by one task
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, index.rdd.getNumPartitions())
    words = index.select(F.col("lexeme").alias("word")).distinct().repartition(tasks)
    return materialize(words.mapInArrow(stemmed, ", ".join(f"`{n}` string" for n in ["word", *names])), "lexicon")


def stored(index: DataFrame, key: str, ranges: bool = False) -> DataFrame:
    """The index written in order of lexeme, so that a search reads the row groups and pages of its lexemes only.

    Each partition is a segment of its own, in order by itself, and nothing is shuffled. For
    an index of many searches `ranges` puts it in order as a whole, by ranges that are cut
    within lexemes too, so that a search opens few files and a frequent lexeme is several.
    """
    return materialize((index.repartitionByRange("lexeme", key) if ranges else index).sortWithinPartitions("lexeme", key), "inverted")


def find(index: DataFrame, key: str, searches: Mapping[str, str], language: str, keys: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """(search, key): the documents that each of the named searches finds, each once.

    The scan is filtered by the searches' lexemes; a document's positions are shifted by the
    distances and intersected. An alternative that only excludes finds all other documents,
    for which keys, a frame with the key of every document, is needed. With words, a lexicon
    that has the language, the index is one of words as they stand: those of the searches'
    lexemes are looked up first, and the index is scanned for them.
    """
    terms, bare = [], []
    for name, wanted in searches.items():
        for a, parts in enumerate(parse(wanted, language)):
            needed = sum(not p.minus for p in parts)
            if not needed:
                bare.append((name, a))
            for i, p in enumerate(parts):
                terms += [(name, a, i, needed, p.minus, len(p.lexemes), at, lexeme, p.prefix) for at, lexeme in p.lexemes]
    spark = index.sparkSession
    if not terms:
        return spark.createDataFrame([], "search string").crossJoin(index.select(key).limit(0))
    if bare and keys is None:
        raise ValueError("a search that only excludes words needs the keys of all documents")

    lexeme = F.col("lexeme")
    names = ("search", "either", "part", "needed", "minus", "size", "at", "wanted", "prefix")
    lits = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, t)]) for t in terms])
    fits = F.filter(lits, lambda t: F.when(t["prefix"], F.startswith(lexeme, t["wanted"])).otherwise(t["wanted"] == lexeme))
    pushed = lexeme.isin(sorted({t[7] for t in terms if not t[8]}))
    for t in sorted({t[7] for t in terms if t[8]}):
        pushed = pushed | F.startswith(lexeme, F.lit(t))
    if words is None:
        hits = index.where(pushed).select(key, "positions", F.explode(fits).alias("_t"))
    else:
        # written, so that the join knows how few they are
        wanted = materialize(words.select(F.col("word"), F.col(language).alias("lexeme")).where(pushed), "words")
        fit = index.withColumnRenamed("lexeme", "word").join(wanted, "word").select(key, "positions", F.explode(fits).alias("_t"))
        # the words of one lexeme are one row again
        hits = fit.groupBy(key, "_t").agg(F.flatten(F.collect_list("positions")).alias("positions"))
    shifted = F.transform("positions", lambda p: p - F.col("_t.at"))
    group = [F.col(f"_t.{n}").alias(n) for n in ("search", "either", "part", "needed", "minus", "size")]
    # prefixes may have many lexemes in a document, of which one is enough; a phrase needs each of its distances
    parts = hits.groupBy(key, *group).agg(F.collect_list(shifted).alias("_starts"))
    whole = F.when(F.col("size") == 1, True).otherwise(
        (F.size("_starts") == F.col("size")) & (F.size(F.aggregate(F.slice("_starts", 2, F.greatest(F.size("_starts") - 1, F.lit(0))), F.col("_starts")[0], F.array_intersect)) > 0)
    )
    told = parts.withColumn("_there", whole).groupBy(key, "search", "either", "needed")
    told = told.agg(F.count_if(F.col("_there") & ~F.col("minus")).alias("_has"), F.count_if(F.col("_there") & F.col("minus")).alias("_bad"))
    found = told.where((F.col("needed") > 0) & (F.col("_has") == F.col("needed")) & (F.col("_bad") == 0)).select("search", key)
    if bare:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("search"), F.lit(a).alias("either")) for n, a in bare])).alias("_b")
        every = keys.where(F.col(key).isNotNull()).select(key, each).select(key, "_b.*")
        found = found.unionByName(every.join(told.where("_bad > 0").select(key, "search", "either"), [key, "search", "either"], "left_anti").select("search", key))
    return found.distinct()
