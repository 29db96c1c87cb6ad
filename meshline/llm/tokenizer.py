"""Encoding of a corpus with a public byte-level BPE vocabulary, by backtracking over longest matches."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's pre-tokenisation pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEEP_PIECES = 200_000
KEEP_PAIRS = 2_000_000


class Encoder:
    """Exact BPE in linear time.

    Text is cut by the pattern; a piece's UTF-8 bytes are read as Latin-1, so
    that the trie of tokens works on strings. From each position the longest
    token is tried first, then its longest proper prefixes. A token may follow
    another only if the two are compatible, that is, if merging by rank would
    leave their border standing; positions that proved dead are marked. The
    only sequence of pairwise compatible tokens is the merges' own result.
    Compatibility of a pair and the ids of a piece are memoised.
    """

    def __init__(self, path: str = VOCABULARY):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, f)}
        self.cut = regex.compile(PATTERN).findall
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in ranks.items():
            self.trie.add_word(t, i)
        self.memo: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for i in sorted(self.token):
            self.split[i] = (i, i)
            t = self.token[i]
            for k in range(1, len(t)):
                left, right = ranks.get(t[:k]), ranks.get(t[k:])
                if left is not None and right is not None and left < i and right < i and self._compatible(left, right):
                    self.split[i] = (left, right)
                    self.merged[left, right] = i
                    break
        self.memo.clear()
        self.shorter = {i: self._longest(t, 0, len(t) - 1) for i, t in self.token.items()}

    def _longest(self, s: str, at: int, most: int | None = None) -> int | None:
        """The longest token that starts at ``at``, of ``most`` characters at most."""
        n = min(len(s) - at, self.longest) if most is None else most
        n = min(n, self.trie.longest_prefix(s[at : at + n])) if n > 0 else 0
        while n > 0:
            got = self.ranks.get(s[at : at + n])
            if got is not None:
                return got
            n -= 1
        return None

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the border between two tokens survives: no merge across it comes before those inside."""
        key, bound = (left, right), 1 << 60
        known = self.memo.get(key)
        if known is not None:
            return known
        ok = True
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                ok = False
                break
            if left > right:
                bound, inner = left, self.split[left][1]
                if inner != left:
                    left = inner
                    continue
                bound, inner = right + 1, self.split[right][0]
                if inner == right:
                    break
                right = inner
            else:
                bound, inner = right + 1, self.split[right][0]
                if inner != right:
                    right = inner
                    continue
                bound, inner = left, self.split[left][1]
                if inner == left:
                    break
                left = inner
        if len(self.memo) >= KEEP_PAIRS:
            self.memo.clear()
        self.memo[key] = ok
        return ok

    def piece(self, s: str) -> list[int]:
        """Ids of one piece given as Latin-1."""
        whole = self.ranks.get(s)
        if whole is not None:
            return [whole]
        out: list[int] = []
        alive = bytearray(b"\x01") * (len(s) + 1)
        at, token = 0, self._longest(s, 0)
        while token is not None:
            end = at + len(self.token[token])
            if alive[end] and (not out or self._compatible(out[-1], token)):
                out.append(token)
                at, token = end, self._longest(s, end)
                continue
            token = self.shorter[token]
            if token is None and out:
                alive[at] = 0
                token = out.pop()
                at -= len(self.token[token])
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        pieces = self.pieces
        for p in self.cut(text):
            ids = pieces.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8", "replace").decode("latin-1"))
                if len(p) <= 64:
                    if len(pieces) >= KEEP_PIECES:
                        pieces.clear()
                    pieces[p] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker, which Spark keeps for later tasks."""
    return Encoder(path)


def encode_table(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids array<int>): one row per row of ``docs``, without a shuffle.

    Null and empty texts give the empty list; blank texts have ids of their
    white space. Spellings of special tokens are ordinary text. Other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            flat: list[int] = []
            offsets = [0]
            for t in b.column(1).to_pylist():
                flat += enc.encode(t)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(lang, n_docs, n_tokens, n_chars) per language as stored."""
    from pyspark.sql import functions as F

    sized = encode_table(docs, path).select("doc_id", F.size("ids").alias("n"))
    return docs.select("doc_id", "lang", F.length("text").alias("c")).join(sized, "doc_id").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.sum("c").alias("n_chars"))
