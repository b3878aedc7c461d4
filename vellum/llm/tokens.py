"""Encoding a corpus with a public byte-level BPE tokenizer.

Each pre-token is encoded by dynamic programming over its prefixes. An Aho-Corasick automaton lists, for
every position, the vocabulary entries that end there. For each prefix exactly one of them can be the last
token of the prefix's encoding: the one whose pair with the last token of the shorter prefix is itself a
stable encoding. The last token of every prefix is stored and the ids are read off by following the
lengths back from the end. No merge loop runs over the pre-token.

Defined results: null and empty texts give an empty list. Special tokens are never produced; their
strings are encoded as ordinary text.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie unless the caller names another folder.
TOKENIZER_DIR = os.environ.get("VELLUM_TOKENIZERS", "/opt/tokenizers")

#: Pre-token pattern of the tokenizer family (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct pre-tokens remembered by one Python worker; older ones are encoded again when they return.
MEMO_LIMIT = 400_000


class PrefixEncoder:
    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.split = regex.compile(PATTERN).findall
        self.memo: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for b, i in ranks.items():
            # an entry that its own bytes don't encode to can never be a last token
            if len(b) == 1 or self._merged(b) == (i,):
                self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()

    def _merged(self, b: bytes) -> tuple[int, ...]:
        """Encoding by its definition: join the pair of lowest rank until none is left. Only for short strings."""
        parts = [b[i : i + 1] for i in range(len(b))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            pair, out, i = (parts[at], parts[at + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return tuple(ranks[p] for p in parts)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are the encoding of their joint bytes."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            known = self._merged(self.bytes_of[left] + self.bytes_of[right]) == (left, right)
            self.pairs[key] = known
        return known

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        if whole is not None and self._whole(raw, whole):
            return [whole]
        n = len(raw)
        last, length = [0] * (n + 1), [0] * (n + 1)
        compatible, found = self.compatible, -1
        for end, (token, size) in self.automaton.iter(raw.decode("latin-1")):
            if end == found:
                continue
            start = end + 1 - size
            if start == 0 or (length[start] and compatible(last[start], token)):
                last[end + 1], length[end + 1], found = token, size, end
        out, at = [], n
        while at:
            out.append(last[at])
            at -= length[at]
        out.reverse()
        return out

    def _whole(self, raw: bytes, token: int) -> bool:
        return len(raw) == 1 or self.automaton.exists(raw.decode("latin-1"))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, out = self.memo, []
        for word in self.split(text):
            ids = memo.get(word)
            if ids is None:
                ids = self.encode_word(word)
                if len(memo) >= MEMO_LIMIT:
                    memo.clear()
                memo[word] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(folder: str, name: str) -> PrefixEncoder:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return PrefixEncoder(ranks)


def token_ids(text: Column, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """Ids of each text as array<int>."""
    folder = folder or TOKENIZER_DIR

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        import numpy as np

        enc = encoder(folder, tokenizer)
        flat, ends = [], [0]
        for t in texts.to_pylist():
            flat += enc.encode(t)
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(np.asarray(ends, dtype="int32")), pa.array(np.asarray(flat, dtype="int32")))

    return ids(text)


def token_count(text: Column, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """Number of ids of each text; 0 for null and empty."""
    folder = folder or TOKENIZER_DIR

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        enc = encoder(folder, tokenizer)
        return pa.array([len(enc.encode(t)) for t in texts.to_pylist()], pa.int32())

    return count(text)


def encode_corpus(df: DataFrame, text: str = "text", out: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """`df` with `out`, the ids of `text`; one row in, one row out, no shuffle."""
    return df.withColumn(out, token_ids(F.col(text), tokenizer, folder))
