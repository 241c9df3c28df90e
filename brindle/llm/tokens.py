"""Token counts of a document's sections by offset-mapped attribution.

A document is encoded once, as a whole, so that counts are those of the text that a model
reads. Each token has a span of characters, from the lengths of the tokens before it; each
section too. The spans are joined as intervals, and a token that several sections overlap goes
to the one that holds most of its characters, the first of equal ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.vocab import encoder

Sections = Callable[[str], tuple[list[str], list[int]]]


def lines(text: str) -> tuple[list[str], list[int]]:
    """Names and starts of a text's lines; a line ends after its \\n, and an empty text has one."""
    starts, at = [0], text.find("\n") + 1
    while 0 < at < len(text):
        starts.append(at)
        at = text.find("\n", at) + 1
    return ["line"] * len(starts), starts


def attribute(spans: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The section of each token. Sections begin at starts, the first at 0, and cover the text."""
    if not len(spans):
        return np.zeros(0, np.int64)
    first = np.searchsorted(starts, spans[:, 0], side="right") - 1
    last = np.searchsorted(starts, np.maximum(spans[:, 1] - 1, spans[:, 0]), side="right") - 1
    out = first.copy()
    ends = np.r_[starts[1:], length]
    for k in np.flatnonzero(first != last):  # few: tokens over a boundary
        part = np.arange(first[k], last[k] + 1)
        held = np.minimum(ends[part], spans[k, 1]) - np.maximum(starts[part], spans[k, 0])
        out[k] = part[np.argmax(held)]
    return out


SCHEMA = "doc_id long, section long, kind string, start long, length long, n_tokens long, shared_tokens long, doc_tokens long"


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sections: Sections = lines,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """One row per section: its place, kind, span in characters, tokens, and the document's tokens.

    n_tokens adds up to doc_tokens over a document; shared_tokens are those of n_tokens that
    another section overlaps as well. Null and empty texts have one empty section with no
    tokens. A token of part of a character counts as that character. Repeated rows and
    repeated or null ids are documents of their own; other columns are not looked at; an empty
    table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for x in batches:
            cols: list[list] = [[] for _ in names]
            for doc, text in zip(x["doc_id"], x["text"], strict=True):
                text = text or ""
                kinds, starts = sections(text)
                at, spans, n = np.array(starts, np.int64), enc.spans(text), len(starts)
                mine = attribute(spans, at, len(text))
                over = np.searchsorted(at, spans[:, 0], side="right") != np.searchsorted(at, np.maximum(spans[:, 1], spans[:, 0] + 1), side="left")
                for col, values in zip(
                    cols,
                    (
                        [doc] * n, range(n), kinds, starts, np.diff(np.r_[at, len(text)]).tolist(),
                        np.bincount(mine, minlength=n).tolist(), np.bincount(mine[over], minlength=n).tolist(), [len(spans)] * n,
                    ),
                    strict=True,
                ):
                    col.extend(values)
            out = pd.DataFrame(dict(zip(names, cols, strict=True)))
            yield out.astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, SCHEMA)
