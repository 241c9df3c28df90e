"""Byte-level BPE by a public vocabulary, with a memory of words.

BPE never merges across the pieces that its pattern cuts, and that pattern always cuts before
a space that doesn't stand between other white space. Where only ids are asked for, a text
without such spaces is thus encoded word by word, and each word (with the space before it) is
looked up before it is encoded. Texts with runs of spaces are encoded whole, and so is any text
whose tokens' places are asked for.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: Words remembered by a worker, and the longest word that is remembered, in characters.
WORDS, LONGEST = 200_000, 64


#: The vocabulary's control string and its id.
CONTROL, CONTROL_ID = "<|endoftext|>", 50256

_AMONG_SPACE = re.compile(r"\s (?:\s|\Z)")
#: White space as the pattern has it, in runs that its matcher can't go back over.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def by_words(text: str) -> bool:
    """Whether the pattern cuts before every space of a text."""
    if "  " in text:
        return False
    if text.isascii() and not any(c + " " in text for c in "\t\n\v\f\r\x1c\x1d\x1e\x1f"):
        return True
    return _AMONG_SPACE.search(text) is None


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class _Words(dict):
    """word -> what make gives for " word"; forgets all when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        value = self.make(" " + word)
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.clear()
            self[word] = value
        return value


class Encoder:
    """ids and character spans of texts; control strings of the vocabulary are ordinary text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._ids = _Words(self._encode)
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes of each token
        self.lengths[list(ranks.values())] = [len(token) for token in ranks]

    def _tokens(self, text: str) -> list[int]:
        """The ids of a whole text.

        The pattern takes a run of white space before a word as a piece without its last
        character; long runs are cut there beforehand.
        """
        run = _LONG_SPACE.search(text)
        if run is None:
            return self.bpe.encode_ordinary(text)
        out, at = [], 0
        while run is not None:
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += self.bpe.encode_ordinary(text[at : run.start()])
            out += self.bpe._core_bpe.encode_single_piece(text[run.start() : end].encode())
            at, run = end, _LONG_SPACE.search(text, run.end())
        return out + self.bpe.encode_ordinary(text[at:])

    def _encode(self, text: str) -> bytes:
        return np.array(self._tokens(text), "<u4").tobytes()

    def ids(self, text: str, control: bool = False) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers; CONTROL is one id if control, ordinary text if not."""
        if control and CONTROL in text:
            return np.array(CONTROL_ID, "<u4").tobytes().join(map(self.ids, text.split(CONTROL)))
        if not by_words(text):
            return self._encode(text)
        first, *rest = text.split(" ")
        return self._encode(first) + b"".join(map(self._ids.__getitem__, rest))

    def decode(self, ids: bytes) -> str:
        return self.bpe.decode(np.frombuffer(ids, "<u4").tolist())

    def spans(self, text: str) -> np.ndarray:
        """(tokens, 2): first character of each token of the whole text, and the one after its last.

        A token of part of a character spans that whole character.
        """
        ids = np.array(self._tokens(text), np.int64)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        if not text.isascii():
            lead = (np.frombuffer(text.encode("utf-8", "replace"), np.uint8) & 0xC0) != 0x80
            char = np.cumsum(lead) - 1  # of each byte
            starts, ends = char[starts], char[ends - 1] + 1
        return np.stack([starts, ends], 1)


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder; its memory of words lasts from task to task."""
    return Encoder(path or default_path())
