"""Byte-level BPE encoding and decoding as a tree reduction.

A text is halved, once at least where it has two characters, until a part is at most
LEAF characters; leaves are encoded on their own, and neighbours are joined by
encoding a window about their border anew. The window grows on either side until its
end is the end of the part or a certified cut, which proves that the tokens outside
hold: a place with white space after it and none before it. No match
of the split pattern runs over such a place (white space stands only first in a
match that holds anything else, and a run of nothing but white space doesn't hold
the character before), and what is matched on either side doesn't depend on the
other: the pattern's only look-ahead concerns white space, which can't end the
left side. So tokens beyond the window are those of the whole text. Where there
is no such place, the window becomes the whole of both parts, which is right too.

The join is associative and the empty sequence is its unit, so that any tree over
the same text gives the same ids. Decoding concatenates up the tree.

Defined results: null and empty texts give no ids and decode to no bytes; ids
that are not in the vocabulary raise KeyError when decoded; repeated rows are
encoded one by one; columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAF = 128
_codecs: dict[tuple, Codec] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    def __init__(self, ranks_path: str, pattern: str, leaf: int = LEAF):
        import tiktoken

        self.ranks, self.leaf = read_ranks(ranks_path), max(1, leaf)
        self._leaf = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_ordinary
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.joins = self.window_chars = 0

    @staticmethod
    def of(ranks_path: str, pattern: str, leaf: int = LEAF) -> Codec:
        """The worker's own copy, built once."""
        key = (ranks_path, pattern, leaf)
        if key not in _codecs:
            _codecs[key] = Codec(*key)
        return _codecs[key]

    def encode(self, text: str | None) -> list[int]:
        return self._encode(text, 0, len(text), min(self.leaf, (len(text) + 1) // 2)) if text else []

    def _encode(self, text: str, a: int, b: int, leaf: int) -> list[int]:
        if b - a <= leaf:
            return self._leaf(text[a:b])
        m = (a + b) // 2
        return self.join(text, a, m, b, self._encode(text, a, m, leaf), self._encode(text, m, b, leaf))

    def join(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of text[a:b] from those of text[a:m] and text[m:b]."""
        if not left or not right:
            return left or right
        self.joins += 1
        lo, hi = self._cut_left(text, a, m), self._cut_right(text, m, b)
        self.window_chars += hi - lo
        i = self._tokens_from(left, len(text[lo:m].encode()))
        j = self._tokens_to(right, len(text[m:hi].encode()))
        return left[:i] + self._leaf(text[lo:hi]) + right[j:]

    @staticmethod
    def _certified(text: str, p: int) -> bool:
        return text[p] in " \n\t\r" and text[p - 1] not in _SPACES

    def _cut_left(self, text: str, a: int, m: int) -> int:
        """The window's start: grows to the left from m until a certified cut."""
        for p in range(m - 1, a, -1):
            if self._certified(text, p):
                return p
        return a

    def _cut_right(self, text: str, m: int, b: int) -> int:
        for p in range(m + 1, b):
            if self._certified(text, p):
                return p
        return b

    def _tokens_from(self, ids: list[int], n: int) -> int:
        """The index from which ids hold the last n bytes; a cut always lies between two tokens."""
        i = len(ids)
        while n > 0:
            i -= 1
            n -= len(self.bytes_of[ids[i]])
        if n:
            raise AssertionError("a certified cut lies within a token")
        return i

    def _tokens_to(self, ids: list[int], n: int) -> int:
        j = 0
        while n > 0:
            n -= len(self.bytes_of[ids[j]])
            j += 1
        if n:
            raise AssertionError("a certified cut lies within a token")
        return j

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, concatenated up the same kind of tree."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        m = len(ids) // 2
        return self.decode(ids[:m]) + self.decode(ids[m:])


#: All that \s matches, so that "none before" errs on the safe side.
_SPACES = frozenset(c for c in map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """doc_id, ids array<int>: one row for each row of docs."""

    def make():
        codec = Codec.of(ranks_path, pattern, leaf)
        return lambda i, t: (i, codec.encode(t))

    kind = docs.schema[id_col].dataType.simpleString()
    return common.map_rows(common.texts(docs, id_col, text_col), make, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids", leaf: int = LEAF) -> DataFrame:
    """doc_id, bytes binary. Null ids give no bytes."""

    def make():
        codec = Codec.of(ranks_path, pattern, leaf)
        return lambda i, x: (i, codec.decode(x or []))

    kind = encoded.schema[id_col].dataType.simpleString()
    return common.map_rows(encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids")), make, f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """Encode, decode the ids, and return digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256. Ids never leave the worker."""

    def make():
        codec = Codec.of(ranks_path, pattern, leaf)

        def one(i, t):
            ids = codec.encode(t)
            packed = np.array(ids, dtype="<u4").tobytes()
            return i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    return common.map_rows(common.texts(docs, id_col, text_col), make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
