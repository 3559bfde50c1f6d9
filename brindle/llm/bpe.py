"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8).

Each text is cut into pieces by the vocabulary's pattern; each distinct piece is encoded once per worker by a
backtracking encoder: an Aho-Corasick automaton gives the longest token at a position, a memoised
pair-compatibility table tells whether two neighbouring tokens can stand side by side in the merged form, and
when they cannot, the next shorter prefix token is tried, going back one token where none is left. Every
position is given up at most once, so the time is linear in the piece. Decoding cuts token bytes out of one
byte string by an offset table.

Cases: a null or an empty text gives an empty list; the strings of special tokens are ordinary text; lone
surrogates cannot occur in Spark strings. The ids are those of the vocabulary file.
"""

from __future__ import annotations

import base64
import importlib.util
import json
import os
from array import array
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from brindle.llm.arrow import map_batches, named

DEFAULT_VOCABULARY = "byte_bpe_50k"

# Fixed value: the published pattern of the byte-level vocabularies, the same as public_tokenizers.PATTERN.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_dir() -> str:
    """Folder of the vocabulary files: BRINDLE_TOKENIZERS, else the installed package, else /opt/tokenizers."""
    if given := os.environ.get("BRINDLE_TOKENIZERS"):
        return given
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes: themselves, else 256 and upward in order."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in kept)
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


class BpeEncoder:
    """Encoder and decoder for one vocabulary file (.json of the tokenizers library or .tiktoken ranks)."""

    CACHE = 1 << 19  # remembered pieces; beyond it the memory starts anew, results stay the same

    def __init__(self, path: str) -> None:
        token_of = self._from_json(path) if path.endswith(".json") else self._from_ranks(path)
        self.size = max(token_of.values()) + 1
        self.bytes_of = [b""] * self.size
        for b, i in token_of.items():
            self.bytes_of[i] = b
        self._token_of = token_of
        self._automaton = ahocorasick.Automaton()
        for b, i in token_of.items():
            self._automaton.add_word(b.decode("latin-1"), i)
        self._automaton.make_automaton()
        self._shorter = self._next_prefixes()
        self._parts = self._split_parts()
        self._joined = {lr: i for i, lr in enumerate(self._parts) if lr is not None}
        self._fits: dict[int, bool] = {}
        self._memo: dict[str, array] = {}
        self._cut = regex.compile(PIECES).findall
        self.offsets = np.array([0, *accumulate(map(len, self.bytes_of))], dtype=np.int64)
        self.blob = b"".join(self.bytes_of)

    def _from_json(self, path: str) -> dict[bytes, int]:
        model = json.load(open(path, encoding="utf-8"))
        special = {t["content"] for t in model.get("added_tokens", ()) if t.get("special")}
        stand_in = _byte_of_char()
        return {bytes(stand_in[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}

    def _from_ranks(self, path: str) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}

    def _next_prefixes(self) -> list[int]:
        """For each token the longest token that is a proper prefix of it, or -1."""
        out = [-1] * self.size
        for b, i in self._token_of.items():
            for end in range(len(b) - 1, 0, -1):
                if (p := self._token_of.get(b[:end])) is not None:
                    out[i] = p
                    break
        return out

    def _split_parts(self) -> list[tuple[int, int] | None]:
        """For each token the two tokens whose merge makes it: what merging its bytes gives with earlier merges only."""
        out: list[tuple[int, int] | None] = [None] * self.size
        rank = self._token_of
        for b, i in rank.items():
            if len(b) == 1:
                continue
            parts = [b[k : k + 1] for k in range(len(b))]
            while len(parts) > 2:
                best, at = i, -1
                for k in range(len(parts) - 1):
                    r = rank.get(parts[k] + parts[k + 1], i)
                    if r < best:
                        best, at = r, k
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                out[i] = (rank[parts[0]], rank[parts[1]])
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens leaves them as two tokens, kept in the pair table.

        The merges are undone from the latest to the earliest along the seam; the pair fails as soon as the two
        tokens that face each other there had been merged before one of them came to be.
        """
        key = left * self.size + right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > self.CACHE * 4:
                self._fits.clear()
            known = self._fits[key] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        # `before`: only merges that happened before this rank can have joined the two facing tokens
        before = self.size
        while True:
            joined = self._joined.get((left, right))
            if joined is not None and joined < before:
                return False
            a, b = self._parts[left], self._parts[right]
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                before, left = left, a[1]
            else:
                # equal ranks on both sides merge from the left, so the seam may still be joined at this very rank
                before, right = right + 1, b[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        whole = self._token_of.get(piece)
        if whole is not None:
            return [whole]
        text, n = piece.decode("latin-1"), len(piece)
        longest, shorter, bytes_of, fits = self._automaton.iter_long, self._shorter, self.bytes_of, self.compatible
        dead = bytearray(n + 1)
        out: list[int] = []
        at = 0
        token = next(longest(text))[1]
        while True:
            # the longest candidate that ends at a live position and suits its left neighbour
            while token >= 0:
                end = at + len(bytes_of[token])
                if not dead[end] and (not out or fits(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = next(longest(text, at))[1]
            else:
                dead[at] = 1
                last = out.pop()
                at -= len(bytes_of[last])
                token = shorter[last]

    def pieces(self, text: str) -> list[str]:
        return self._cut(text)

    def encoded_piece(self, piece: str) -> array:
        ids = self._memo.get(piece)
        if ids is None:
            if len(self._memo) > self.CACHE:
                self._memo.clear()
            ids = array("i", self.encode_piece(piece.encode("utf-8")))
            if len(piece) <= 64:
                self._memo[piece] = ids
        return ids

    def encode_into(self, text: str | None, out: array) -> int:
        """Append the ids of ``text`` to ``out``; returns how many."""
        if not text:
            return 0
        before, memo, extend = len(out), self._memo, out.extend
        for p in self._cut(text):
            ids = memo.get(p)
            extend(self.encoded_piece(p) if ids is None else ids)
        return len(out) - before

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        self.encode_into(text, out)
        return out.tolist()

    def decode(self, ids) -> str:
        """Text of ``ids``: each token's bytes lie in one byte string between two entries of the offset table."""
        blob, at = self.blob, self.offsets
        return b"".join(blob[at[i] : at[i + 1]] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(vocabulary: str = DEFAULT_VOCABULARY, directory: str | None = None) -> BpeEncoder:
    """The encoder of a vocabulary, built once per process."""
    path = os.path.join(directory or tokenizer_dir(), vocabulary)
    for ending in ("", ".json", ".tiktoken"):
        if os.path.isfile(path + ending):
            return BpeEncoder(path + ending)
    raise FileNotFoundError(path)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, directory: str | None = None) -> DataFrame:
    """(id_col, ids ARRAY<INT>) of every row; narrow, no shuffle."""

    def run(batches):
        enc = encoder(vocabulary, directory)
        for batch in batches:
            ids, ends = array("i"), [0]
            for text in batch.column(1).to_pylist():
                enc.encode_into(text, ids)
                ends.append(len(ids))
            values = pa.array(np.frombuffer(ids, dtype=np.int32) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["id", "ids"])

    return map_batches(named(df, id_col, text_col), run, "id bigint, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, directory: str | None = None) -> DataFrame:
    """(id_col, n_tokens BIGINT) of every row; a null or empty text has 0 tokens."""

    def run(batches):
        enc = encoder(vocabulary, directory)
        for batch in batches:
            counts = []
            for text in batch.column(1).to_pylist():
                memo, n = enc._memo, 0
                for p in enc.pieces(text) if text else ():
                    ids = memo.get(p)
                    n += len(enc.encoded_piece(p) if ids is None else ids)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["id", "n_tokens"])

    return map_batches(named(df, id_col, text_col), run, "id bigint, n_tokens bigint").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = DEFAULT_VOCABULARY, directory: str | None = None) -> DataFrame:
    """(id_col, text STRING) of every row; null ids give a null text, an empty list an empty text."""

    def run(batches):
        enc = encoder(vocabulary, directory)
        for batch in batches:
            texts = [None if x is None else enc.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return map_batches(named(df, id_col, ids_col), run, "id bigint, text string").withColumnRenamed("id", id_col)
