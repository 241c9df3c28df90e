"""Chat formatting by a prefix tree.

Conversations that share their first turns share those turns' nodes. A node is named by a
hash of all turns up to its own, so equal prefixes meet without being compared. Distinct
conversations are sorted by their nodes, which is depth-first order; each one then adds just
the nodes that the one before it doesn't have. The sorted rows are cut into slices, so that a
first turn of a third of all conversations is spread over tasks; what a slice takes over from
those before it (a path of nodes and a place) is worked out from the first and last row of
each slice.

A tree's tokens stand in one sequence, each turn's once. A node's tokens see the tokens of its
ancestors, given as intervals of that sequence, and their own up to themselves; their
positions count on from the ancestors' tokens, not from what stands before them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from brindle.llm.vocab import encoder
from brindle.sources.tables import materialize

ASSISTANT = "assistant"


def escape(text: str) -> str:
    """text without the characters that the template's marks are made of."""
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def unescape(text: str) -> str:
    return text.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")


def segment(role: str, text: str) -> tuple[str, str, str]:
    """A turn's mark, its escaped text, and its closing mark."""
    return f"<turn {escape(role)}>\n", escape(text), "</turn>\n"


_TURN = re.compile(r"<turn ([^<>]*)>\n([^<>]*)</turn>\n")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; ValueError if formatted isn't what segment() writes."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def node_names(turns: list[tuple[str, str]]) -> list[bytes]:
    """A 128-bit name for each turn and all before it."""
    names, name = [], b""
    for role, text in turns:
        r = role.encode("utf-8", "replace")
        name = xxhash.xxh128_digest(name + len(r).to_bytes(4, "big") + r + text.encode("utf-8", "replace"))
        names.append(name)
    return names


def gather(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turns): each conversation's roles and texts by turn; ties by role, then text. A row without conv_id stands alone."""
    one = F.struct(
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), one.alias("one"))
    whole = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return whole.unionByName(rows.where("conv_id is null").select("conv_id", F.array("one").alias("turns")))


def _named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        yield pd.DataFrame(
            {"conv_id": x["conv_id"].astype("Int64"), "path": [node_names([(t["role"], t["text"]) for t in ts]) for ts in x["turns"]], "turns": x["turns"]}
        )


def _common(a: list, b: list) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


_TREE = (
    "slice long, seq long, last boolean, path array<binary>, lens array<long>, starts array<long>, positions array<long>,"
    " lcp int, lcp_first int, first_root boolean, after long, roles array<string>, ids array<binary>, heads array<long>, bodies array<long>"
)


def _grow(batches: Iterator[pd.DataFrame], path: str | None) -> Iterator[pd.DataFrame]:
    """Depth-first growth over a slice's sorted conversations: new nodes, and places as if the slice were alone."""
    enc, context = encoder(path), TaskContext.get()
    slice_, seq, cursor = (context.partitionId() if context else 0), 0, 0
    first: list[bytes] = []
    before: dict = {}
    names = [c.split()[0] for c in _TREE.split(", ")]

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names)

    for x in batches:
        out = []
        for nodes, turns in zip(x["path"], x["turns"], strict=True):
            nodes = [bytes(n) for n in nodes]
            lcp = _common(before["path"], nodes) if before else 0
            if not lcp:
                cursor = 0
            first = first or nodes
            lens, starts = (before["lens"][:lcp], before["starts"][:lcp]) if before else ([], [])
            ids, heads, bodies = [], [], []
            for turn in list(turns)[lcp:]:
                pieces = [enc.ids(p) for p in segment(turn["role"], turn["text"])]
                ids.append(b"".join(pieces))
                heads.append(len(pieces[0]) // 4)
                bodies.append(len(pieces[1]) // 4)
                starts = [*starts, cursor]
                lens = [*lens, len(ids[-1]) // 4]
                cursor += lens[-1]
            row = dict(
                slice=slice_, seq=seq, last=False, path=nodes, lens=lens, starts=starts,
                positions=(np.cumsum(lens) - lens).tolist(), lcp=lcp, lcp_first=_common(first, nodes),
                first_root=nodes[0] == first[0], after=cursor, roles=[t["role"] for t in turns][lcp:],
                ids=ids, heads=heads, bodies=bodies,
            )
            if before:
                out.append(before)
            before = row
            seq += 1
        yield frame(out)
    if before:
        yield frame([before | {"last": True}])


def _takeovers(ends: list[Row]) -> list[tuple[int, int, list[int], int]]:
    """(slice, shared, their starts, shift) from each slice's first and last row: two rows a task, not more."""
    by: dict[int, dict[str, Row]] = {}
    for r in ends:
        by.setdefault(r.slice, {})
        if r.seq == 0:
            by[r.slice]["first"] = r
        if r.last:
            by[r.slice]["last"] = r
    path: list[bytes] = []
    starts: list[int] = []
    cursor, out = 0, []
    for slice_ in sorted(by):
        first, last = by[slice_]["first"], by[slice_]["last"]
        shared = _common(path, list(first.path))
        shift = cursor - sum(first.lens[:shared]) if shared else 0
        kept = starts[:shared]
        out.append((slice_, shared, kept, shift))
        if last.first_root:
            same = min(last.lcp_first, shared)
            starts, cursor = kept[:same] + [s + shift for s in last.starts[same:]], last.after + shift
        else:
            starts, cursor = list(last.starts), last.after
        path = list(last.path)
    return out


def prefix_tree(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    tokenizer_path: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations, paths, nodes) of the prefix trees of all conversations.

    conversations: conv_id and leaf, its last node. paths: leaf and path, its nodes in order,
    once for each distinct conversation. nodes: tree (its first turn's node), node, parent, depth,
    role, start (place in the tree's sequence), n_tokens, position (of its first token), ids
    (little-endian unsigned 32-bit), loss_from and loss_to (its own tokens that count for the
    loss: an assistant's text), attends (ancestors' intervals of the sequence, those that touch
    merged).

    Turns go by number; equal numbers by role and text, so repeated rows are turns of their own.
    Null roles and texts are empty, null turns come first, and each row with a null conv_id is a
    conversation of its own. Other columns aren't looked at; an empty table gives empty results.
    """
    named = gather(turns, conv_col, turn_col, role_col, text_col).mapInPandas(
        _named, "conv_id long, path array<binary>, turns array<struct<turn:long,role:string,text:string>>"
    )
    named = materialize(named, "conversations")
    conversations = named.select("conv_id", F.element_at("path", -1).alias("leaf"), F.size("path").alias("n_turns"))
    distinct = named.groupBy("path").agg(F.first("turns").alias("turns"))
    grown = distinct.repartitionByRange("path").sortWithinPartitions("path").mapInPandas(lambda it: _grow(it, tokenizer_path), _TREE)
    grown = materialize(grown, "grown")

    ends = grown.where((F.col("seq") == 0) | F.col("last")).select(
        "slice", "seq", "last", "path", "lens", "starts", "lcp_first", "first_root", "after"
    )
    taken = turns.sparkSession.createDataFrame(
        _takeovers(ends.collect()), "slice long, shared int, kept array<long>, shift long"
    )
    rows = grown.join(F.broadcast(taken), "slice")
    own = F.when(F.col("seq") == 0, F.col("shared")).otherwise(F.col("lcp"))
    fixed = F.transform(
        "starts",
        lambda s, i: F.when(~F.col("first_root"), s)
        .when(i < F.least("lcp_first", "shared"), F.get("kept", i))
        .otherwise(s + F.col("shift")),
    )
    rows = rows.withColumns({"own": own, "starts": fixed})
    interval = lambda a, b: F.struct(a.alias("from"), b.alias("to"))

    def merged(acc, x):
        touch = (F.size(acc) > 0) & (F.element_at(acc, -1)["to"] == x["from"])
        grown_last = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(interval(F.element_at(acc, -1)["from"], x["to"])))
        return F.when(touch, grown_last).otherwise(F.concat(acc, F.array(x)))

    spans = F.zip_with("starts", "lens", lambda s, n: interval(s, s + n))
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    rows = rows.withColumn("before", F.aggregate(F.slice(spans, F.lit(1), F.col("own")), none, merged))

    def node(i):
        j = i - F.col("lcp")
        head, body = F.get("heads", j), F.get("bodies", j)
        talks = F.get("roles", j) == ASSISTANT
        start, own_start = F.get("starts", i), F.get("starts", F.col("own"))
        touch = (F.size("before") > 0) & (F.element_at("before", -1)["to"] == own_start) & (i > F.col("own"))
        with_last = F.concat(
            F.slice("before", F.lit(1), F.greatest(F.size("before") - 1, F.lit(0))),
            F.array(interval(F.element_at("before", -1)["from"], start)),
        )
        attends = F.when(i == F.col("own"), F.col("before")).when(touch, with_last).otherwise(
            F.concat("before", F.array(interval(own_start, start)))
        )
        return F.struct(
            F.get("path", F.lit(0)).alias("tree"),
            F.get("path", i).alias("node"),
            F.when(i > 0, F.get("path", i - 1)).alias("parent"),
            i.alias("depth"),
            F.get("roles", j).alias("role"),
            start.alias("start"),
            F.get("lens", i).alias("n_tokens"),
            F.get("positions", i).alias("position"),
            F.get("ids", j).alias("ids"),
            F.when(talks, head).otherwise(F.lit(0)).alias("loss_from"),
            F.when(talks, head + body).otherwise(F.lit(0)).alias("loss_to"),
            attends.alias("attends"),
        )

    size = F.size("path")
    fresh = F.when(F.col("own") < size, F.transform(F.sequence(F.col("own"), size - 1), node))
    nodes = rows.select(F.inline(fresh))
    paths = grown.select(F.element_at("path", -1).alias("leaf"), "path")
    return conversations, paths, nodes


def _digests(batches: Iterator[pd.DataFrame], path: str | None) -> Iterator[pd.DataFrame]:
    enc = encoder(path)
    for x in batches:
        rows = []
        for leaf, nodes in zip(x["leaf"], x["nodes"], strict=True):
            formatted = enc.decode(b"".join(n["ids"] for n in nodes))
            loss = "".join(unescape(enc.decode(n["ids"][4 * n["loss_from"] : 4 * n["loss_to"]])) for n in nodes)
            turns = parse(formatted)
            whole = "".join(f"{role}\n{text}\n" for role, text in turns)
            sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
            rows.append((leaf, len(turns), sha(whole), len(loss), sha(loss), len(formatted)))
        yield pd.DataFrame(rows, columns=["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(conversations: DataFrame, paths: DataFrame, nodes: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """For each conversation, what its path through the tree says: turns, loss text and formatted length.

    Tokens are decoded, then parsed; each distinct conversation is read once.
    """
    steps = paths.select("leaf", F.posexplode("path").alias("i", "node"))
    told = steps.join(nodes.select("node", "ids", "loss_from", "loss_to"), "node")
    told = told.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("i", "ids", "loss_from", "loss_to"))).alias("nodes"))
    digests = told.mapInPandas(
        lambda it: _digests(it, tokenizer_path),
        "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
    return conversations.select("conv_id", "leaf").join(digests, "leaf").drop("leaf")
