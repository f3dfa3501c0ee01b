"""Problem 8: the whole corpus encoded with a public byte-level BPE tokenizer.

Method: monoid tree reduction.  A node is the token sequence of a stretch of text
encoded alone.  A text is halved until its parts are leaves; neighbours are
joined up the tree: a window around the seam is encoded again and grows until
the tokens outside provably stay.  Two proofs are used.  A boundary between
characters of different classes (but blank before non-blank, and apostrophe
before letter) parts pre-tokens whatever stands around, and merges never cross
pre-tokens.  Within a pre-token longer than a window, a token sequence is the
encoding of its bytes if each two neighbours are the encoding of theirs, so a
window of tokens grows until both its ends agree with the tokens beside them.
Decoding concatenates up the tree.

Pre-tokens of up to 64 characters are encoded once per worker and remembered
within a bound; leaves and joins are concatenations of bytes.

Defined results: null and empty texts give an empty list; strings of special
tokens in a text are ordinary text; repeated rows give repeated rows; very long
texts take the tree; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; another place is a parameter of every operator.
VOCABULARIES = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")
LEAF = 256  # characters; every longer text takes the tree
_BLANK = "\t-\r \x85\xa0  -     　"


@lru_cache(1)
def _sets() -> tuple[str, str, str]:
    """Patterns of one letter, one number, one other sign, by category."""
    runs: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)) in ("Nl", "No"):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    more = "".join(f"{chr(a)}-{chr(b)}" for a, b in runs)
    return rf"[^\W\d_{more}]", rf"[\d{more}]", rf"[^{_BLANK}\w]|_"


@lru_cache(1)
def pre_token() -> re.Pattern:
    """The byte-level pattern: contractions, words, numbers, other signs, blanks."""
    letter, number, other = _sets()
    return re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?{letter}+| ?{number}+| ?(?:{other})+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


def _classes() -> list[tuple[str, re.Pattern]]:
    """The classes of characters that a pre-token is a run of: blanks, letters, numbers, other signs."""
    letter, number, other = _sets()
    return [("S", re.compile(rf"[{_BLANK}]+")), ("L", re.compile(f"{letter}+")), ("N", re.compile(f"{number}+")), ("O", re.compile(f"(?:{other})+"))]


class Encoder(dict):
    """Pre-token to its identifiers as bytes; a text's node of the tree is the bytes of its identifiers."""

    def __init__(self, path: str, most: int = 400_000, leaf: int = LEAF, near: int = 128) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._raw = {i: t for t, i in ranks.items()}
        self._bpe = tiktoken.Encoding(os.path.basename(path), pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self._most, self._leaf, self._near = most, leaf, near
        self._scan = pre_token().findall
        self._runs = _classes()
        self._class = lru_cache(1 << 16)(lambda ch: next(k for k, r in self._runs if r.match(ch)))

    def __missing__(self, piece: str) -> bytes:
        out = np.array(self._bpe(piece), np.int32).tobytes()
        if len(piece) <= 64:
            if len(self) >= self._most:
                self.clear()
            self[piece] = out
        return out

    def _whole(self, text: str, a: int, b: int) -> bytes:
        """The identifiers of ``text[a:b]`` by itself, without the tree."""
        return b"".join(map(self.__getitem__, self._scan(text, a, b)))

    def node(self, text: str, a: int, b: int) -> bytes:
        """The identifiers of ``text[a:b]`` by itself: both halves, joined."""
        if b - a <= self._leaf:
            return self._whole(text, a, b)
        mid = (a + b) // 2
        return self._join(text, a, mid, b, self.node(text, a, mid), self.node(text, mid, b))

    def _sure(self, x: str, y: str) -> bool:
        """Whether pre-tokens part between two characters whatever stands around, and neither side's depend on the other."""
        cx, cy = self._class(x), self._class(y)
        return cx != "S" and cx != cy and not (x == "'" and cy == "L")

    def _join(self, text: str, a: int, mid: int, b: int, left: bytes, right: bytes) -> bytes:
        """Re-encodes a window around the seam that grows until both its ends are sure boundaries.

        Where none is near, the seam lies within one long pre-token: then the
        window is one of tokens and grows until those outside provably stay.
        """
        i = j = mid
        while i > a and not self._sure(text[i - 1], text[i]):
            i -= 1
            if mid - i > self._near:
                break
        else:
            if i == mid:
                return left + right
        while j < b and (j == mid or not self._sure(text[j - 1], text[j])):
            j += 1
            if j - mid > self._near:
                break
        if mid - i > self._near or j - mid > self._near:
            return self._long(text, a, mid, b, left, right)
        return left[: len(left) - len(self._whole(text, i, mid))] + self._whole(text, i, j) + right[len(self._whole(text, mid, j)) :]

    def _long(self, text: str, a: int, mid: int, b: int, left: bytes, right: bytes) -> bytes:
        kind = self._class(text[mid])
        run = dict(self._runs)[kind]
        if self._class(text[mid - 1]) == kind:
            before = run.match(text[a:mid][::-1]).end()
            s, e = mid - before, run.match(text, mid, b).end()
            apostrophe = text[mid] == "'" or kind == "L" and s > a and text[s - 1] == "'"
            if kind == "S":
                e -= e < b  # the last blank goes with what follows
            elif s > a and text[s - 1] == " ":
                s -= 1
            if e == mid:
                return left + right
            if not apostrophe:
                return self._splice(left, right, len(text[s:mid].encode()), len(text[mid:e].encode()))
        i, j = mid, mid + 1
        while i > a and not self._sure(text[i - 1], text[i]):
            i -= 1
        while j < b and not self._sure(text[j - 1], text[j]):
            j += 1
        return left[: len(left) - len(self._whole(text, i, mid))] + self._whole(text, i, j) + right[len(self._whole(text, mid, j)) :]

    def _splice(self, left: bytes, right: bytes, before: int, after: int) -> bytes:
        """Joins the tokens of one pre-token's two parts of ``before`` and ``after`` bytes.

        Tokens are the encoding of their bytes if each two neighbours are the
        encoding of theirs, so the rest stays once the window's ends agree with
        the tokens beside them.
        """
        x, y = memoryview(left).cast("i"), memoryview(right).cast("i")
        raw, k = self._raw, 2
        while True:
            p, n = len(x), 0
            while n < before and len(x) - p < k:
                p -= 1
                n += len(raw[x[p]])
            q, m = 0, 0
            while m < after and q < k:
                m += len(raw[y[q]])
                q += 1
            new = self._bpe(b"".join(raw[t] for t in x[p:]) + b"".join(raw[t] for t in y[:q]))
            if (n >= before or self._stays(x[p - 1], new[0])) and (m >= after or self._stays(new[-1], y[q])):
                return left[: 4 * p] + np.array(new, np.int32).tobytes() + right[4 * q :]
            k *= 2

    def _stays(self, x: int, y: int) -> bool:
        return self._bpe(self._raw[x] + self._raw[y]) == [x, y]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(identifiers of all texts one after another, where each text begins and the last ends)."""
        nodes = [self.node(t, 0, len(t)) if t else b"" for t in texts]
        ends = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) // 4 for x in nodes], out=ends[1:])
        return np.frombuffer(b"".join(nodes), np.int32), ends

    def sizes(self, texts: list[str | None]) -> np.ndarray:
        """Number of identifiers of each text."""
        return np.array([len(self.node(t, 0, len(t))) // 4 if t else 0 for t in texts], np.int64)

    def decode(self, ids: list[int]) -> str:
        """The text of identifiers, concatenated up the tree."""
        parts = [b"".join(map(self._raw.__getitem__, ids[a : a + self._leaf])) for a in range(0, len(ids), self._leaf)]
        while len(parts) > 1:
            parts = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
        return parts[0].decode() if parts else ""


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return f"{folder or VOCABULARIES}/{name}.tiktoken"


def encode_texts(df: DataFrame, key: str, text: str, path: str | None = None, batch: int = 1000) -> DataFrame:
    """(key, ids): the identifiers of every row's text, without special tokens; null and empty texts give []."""
    path = path or vocabulary()
    kind = dict(df.select(F.col(key).alias("k")).dtypes)["k"]

    def run(batches):
        enc = encoder(path)
        for whole in batches:
            for a in range(0, whole.num_rows, batch):
                b = whole.slice(a, batch)
                ids, ends = enc.encode(b.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, "ids"])

    return df.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, path: str | None = None, batch: int = 1000) -> DataFrame:
    """(key, n_tokens) of every row; null and empty texts have 0."""
    path = path or vocabulary()
    kind = dict(df.select(F.col(key).alias("k")).dtypes)["k"]

    def run(batches):
        enc = encoder(path)
        for whole in batches:
            for a in range(0, whole.num_rows, batch):
                b = whole.slice(a, batch)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(enc.sizes(b.column(1).to_pylist()))], names=[key, "n_tokens"])

    return df.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")


def decode_ids(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """(key, text) of every row's identifiers; null gives null, an empty list an empty text."""
    path = path or vocabulary()
    kind = dict(df.select(F.col(key).alias("k")).dtypes)["k"]

    def run(batches):
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else enc.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return df.select(F.col(key), F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {kind}, text string")
