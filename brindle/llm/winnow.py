"""Line dedup by winnowing over line hashes.

A line goes if it lies in a run of whole lines, of min_words words or more together, of which
an equal run stands earlier (by document id, then place). Lines are compared by their words.

1. Each document becomes a skeleton: the hash and the number of words of each line.
2. Winnowing: every shortest run of min_words words has its smallest line hash selected. Equal
   runs select equal lines, so that a repeated run of that length always holds a selected line
   that occurs at least twice.
3. The selected lines' positions are joined with the hashes that occur twice. Around each such
   position the match is extended both ways: all shortest runs over it, those that begin at
   each line and those that end at each line, whose union is any longer run.
4. Runs are grouped by content; all but the first lose their lines.

Groups are only ever counted or reduced to their first position, so a line or passage of a
third of all documents is summed up before any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.tables import materialize

MIN_WORDS = 50


def skeleton(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash and the number of words of each line; line ends are \\n."""
    words = [line.split() for line in (text or "").split("\n")]
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(w)) for w in words], np.uint64).view(np.int64)
    return hashes, np.array([len(w) for w in words], np.int64)


def run_ends(words: np.ndarray, min_words: int) -> np.ndarray:
    """For each line, the line after the shortest run from it of min_words words; its length plus one where there is none."""
    total = np.r_[0, np.cumsum(words)]
    return np.searchsorted(total, total[:-1] + min_words)


def run_starts(words: np.ndarray, min_words: int) -> np.ndarray:
    """For each line, the first line of the shortest run up to and with it; -1 where there is none."""
    total = np.r_[0, np.cumsum(words)]
    return np.searchsorted(total, total[1:] - min_words, side="right") - 1


def selected(hashes: np.ndarray, words: np.ndarray, min_words: int) -> np.ndarray:
    """The lines with the smallest hash (the last of equal ones) of any shortest run."""
    n, ends = len(hashes), run_ends(words, min_words)
    picked: set[int] = set()
    queue: list[int] = []  # lines with rising hashes, as in any sliding minimum
    head = upto = 0
    for start in range(n):
        if ends[start] > n:
            break
        while upto < ends[start]:
            while len(queue) > head and hashes[queue[-1]] >= hashes[upto]:
                queue.pop()
            queue.append(upto)
            upto += 1
        while queue[head] < start:
            head += 1
        picked.add(queue[head])
    return np.array(sorted(picked), np.int64)


def runs_over(hashes: np.ndarray, words: np.ndarray, marked: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Shortest runs (first line, line after) that hold a marked line: from each line, and up to each line."""
    n = len(hashes)
    before = np.zeros(n + 1, np.int64)
    before[1:] = np.cumsum(np.isin(np.arange(n), marked))
    ends, starts = run_ends(words, min_words), run_starts(words, min_words)
    found = {(i, int(e)) for i, e in enumerate(ends) if e <= n and before[e] > before[i]}
    found |= {(int(s), j + 1) for j, s in enumerate(starts) if s >= 0 and before[j + 1] > before[s]}
    return sorted(found)


def _skeletons(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [skeleton(t) for t in batch.column(2).to_pylist()]
        picks = [selected(h, w, min_words) for h, w in made]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([h for h, _ in made], pa.list_(pa.int64())),
                pa.array([w for _, w in made], pa.list_(pa.int64())),
                pa.array(picks, pa.list_(pa.int64())),
                pa.array([h[p] for (h, _), p in zip(made, picks, strict=True)], pa.list_(pa.int64())),
            ],
            ["doc", "copy", "hashes", "words", "picks", "pick_hashes"],
        )


def _runs(batches: Iterator[pd.DataFrame], min_words: int) -> Iterator[pd.DataFrame]:
    for x in batches:
        rows = []
        for doc, copy, hashes, words, marked in x[["doc", "copy", "hashes", "words", "marked"]].itertuples(index=False):
            raw = np.asarray(hashes, "<i8")
            for a, b in runs_over(raw, np.asarray(words), np.asarray(marked), min_words):
                d = xxhash.xxh128_digest(raw[a:b].tobytes())
                rows.append((doc, copy, a, b, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
        out = pd.DataFrame(rows, columns=["doc", "copy", "first", "after", "c1", "c2"])
        yield out.astype({"doc": "Int64", "copy": "int64", "first": "int64", "after": "int64", "c1": "int64", "c2": "int64"})


def repeated_ranges(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, copy, ranges): for each text the line ranges [first, after) to delete; copy is the text's hash."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc"),
        F.xxhash64(F.col(text_col).cast("string")).alias("copy"),
        F.col(text_col).cast("string").alias("body"),
    )
    made = rows.mapInArrow(
        lambda it: _skeletons(it, min_words),
        "doc long, copy long, hashes array<long>, words array<long>, picks array<long>, pick_hashes array<long>",
    )
    made = materialize(made, "skeletons")

    places = made.select("doc", "copy", F.inline(F.arrays_zip("picks", "pick_hashes")).alias("place", "hash"))
    twice = places.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    twice = materialize(twice, "twice")  # so that nothing but exchanges feed the join, and AQE can split a common line
    marked = places.join(twice, "hash").groupBy("doc", "copy").agg(F.collect_set("place").alias("marked"))
    runs = (
        made.select(F.col("doc").alias("d"), F.col("copy").alias("c"), "hashes", "words")
        .join(marked, F.col("d").eqNullSafe(F.col("doc")) & (F.col("c") == F.col("copy")))
        .select("doc", "copy", "hashes", "words", "marked")
        .mapInPandas(lambda it: _runs(it, min_words), "doc long, copy long, first long, after long, c1 long, c2 long")
    )
    runs = materialize(runs, "runs")

    # a null id comes first, so that its rows too have a place in the order
    origin = (
        runs.groupBy("c1", "c2")
        .agg(F.min(F.struct("doc", "copy", "first", "after")).alias("origin"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    origin = materialize(origin, "origins")  # as above, for a common passage
    same = F.col("doc").eqNullSafe(F.col("origin.doc")) & (F.col("copy") == F.col("origin.copy"))
    later = (
        runs.join(origin, ["c1", "c2"])
        .withColumn("first", F.when(same, F.greatest("first", "origin.after")).otherwise(F.col("first")))
        .where(~(same & (F.col("first") >= F.col("after"))))
    )
    return later.groupBy("doc", "copy").agg(F.collect_set(F.struct("first", "after")).alias("ranges"))


def _without(text: str, ranges: list[dict]) -> str:
    lines = text.split("\n")
    keep = np.ones(len(lines), bool)
    for r in ranges:
        keep[r["first"] : r["after"]] = False
    return "\n".join(line for line, k in zip(lines, keep, strict=True) if k)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """docs with later repeated runs of lines deleted from the text; all rows and columns stay.

    Texts are otherwise unchanged to the character. A text all of whose lines repeat becomes
    empty; null stays null. Rows of one id and one text are one document and end up alike;
    rows of one id with other texts are ordered by the text's hash. Null ids come first. In a
    text that repeats itself in overlapping runs, the first run stays whole. An empty table
    gives none. Helper columns have names that docs doesn't use.
    """
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in (f"_ranges{i}" for i in range(len(taken) + 1)) if not any(c.startswith(n) for c in taken))
    ranges = repeated_ranges(docs, id_col, text_col, min_words).select(
        F.col("doc").alias(f"{name}_d"), F.col("copy").alias(f"{name}_c"), F.col("ranges").alias(name)
    )
    joined = docs.join(
        ranges.hint("shuffle_hash"),
        F.col(id_col).cast("long").eqNullSafe(F.col(f"{name}_d"))
        & (F.xxhash64(F.col(text_col).cast("string")) == F.col(f"{name}_c")),
        "left",
    ).drop(f"{name}_d", f"{name}_c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, where = batch.schema.get_field_index(text_col), batch.schema.get_field_index(name)
            found = batch.column(where).to_pylist()
            texts = batch.column(at)
            if any(found):
                texts = pa.array(
                    [_without(t, r) if r and t is not None else t for t, r in zip(texts.to_pylist(), found, strict=True)],
                    texts.type,
                )
            yield pa.RecordBatch.from_arrays(
                [texts if i == at else batch.column(i) for i in range(batch.num_columns) if i != where],
                [n for n in batch.schema.names if n != name],
            )

    return joined.mapInArrow(run, docs.schema)


#: DuckDB SQL for dedup_lines over a table with one row per doc_id: all shortest runs, without winnowing.
DEDUP_SQL = f"""
with raw as (
  select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as i from {{docs}}
), lines as (
  select doc_id, raw, i, regexp_replace(trim(raw, ' ' || chr(9) || chr(13)), '\\s+', ' ', 'g') as line from raw
), counted as (
  select *, case when line = '' then 0 else len(string_split(line, ' ')) end as words from lines
), summed as (
  select *, sum(words) over (partition by doc_id order by i) as total from counted
), runs as (
  select a.doc_id, a.i as s, min(b.i) as e from summed a join summed b
    on a.doc_id = b.doc_id and b.i >= a.i and b.total - a.total + a.words >= {MIN_WORDS} group by a.doc_id, a.i
  union
  select b.doc_id, max(a.i) as s, b.i as e from summed a join summed b
    on a.doc_id = b.doc_id and b.i >= a.i and b.total - a.total + a.words >= {MIN_WORDS} group by b.doc_id, b.i
), bodies as (
  select r.doc_id, r.s, r.e, string_agg(l.line, chr(10) order by l.i) as body
  from runs r join lines l on l.doc_id = r.doc_id and l.i between r.s and r.e group by r.doc_id, r.s, r.e
), placed as (
  select *, first_value(doc_id) over w as d0, first_value(s) over w as s0, first_value(e) over w as e0
  from bodies window w as (partition by body order by doc_id, s, e)
), gone as (
  select distinct p.doc_id, l.i from placed p join lines l on l.doc_id = p.doc_id
    and l.i between case when p.doc_id = d0 then greatest(s, e0 + 1) else s end and p.e
  where not (p.doc_id = d0 and p.s = s0)
), kept as (
  select l.doc_id, coalesce(string_agg(l.raw, chr(10) order by l.i) filter (where g.i is null), '') as text
  from lines l left join gone g on g.doc_id = l.doc_id and g.i = l.i group by l.doc_id
)
select d.doc_id, k.text from {{docs}} d left join kept k on k.doc_id = d.doc_id
"""
