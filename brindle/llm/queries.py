"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import ann, audio, chat, codes, html_extract, mixing, packing, pieces, quality, simhash, spelling, tokens, winnow
from brindle.sources.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


@_query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of fingerprints that differ in two bits or fewer."""
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


@_query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior, score and decision of every document."""
    return quality.classify(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


@_query("op3_mixing", mixing.MIX_SQL.format(docs="documents"))
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whole, as often as its draw says, shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mixing.mix(docs, mixing.WEIGHTS, mixing.OTHER).drop("mean", "shuffle_key")


@_query("op4_tokens")
def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return tokens.count_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


@_query("op5_neighbours")
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_query("op6_html")
def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(spread(table(spark, sf_dir, "pages"))).select("page_id", "url", "text", "n_chars")


@_query("op7_lines", winnow.DEDUP_SQL.format(docs="documents"))
def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later repeated runs of lines."""
    return winnow.dedup_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


@_query("op8_chat")
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each conversation reads like, decoded from the prefix tree; with one that holds control strings."""
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(*chat.prefix_tree(turns))


@_query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece's place, and a checksum of its ids."""
    pieces = packing.pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length"
    )


@_query("op10_audio")
def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's audio stream, read back."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    heard = audio.scan_media(audio.add_media(docs))
    return heard.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.octet_length("audio.payload").cast("long").alias("payload_bytes"),
        F.sha2("audio.payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("audio.payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "audio.feature",
        "audio.frames",
        "audio.samples",
        "audio.rate",
    )


@_query("op11_pieces")
def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text's pieces and of what they read like."""
    coded = pieces.encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@_query("op12_codes", codes.CODES_SQL.format(vectors="embeddings"))
def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of each vector, its error and that of its label."""
    coded, books = codes.compress(spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")))
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return coded.join(labels, coded["label"].eqNullSafe(labels["label"]), "left").select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.sha2(F.lit(codes.digest(books)), 256).alias("codebooks_sha256")
    )


@_query("op13_spelling")
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all texts, slips planted by rule, each with its form and root."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling.group_spellings(docs, change=spelling.planted).select("word", "form", "root", "n", "n_near", "form_n")
