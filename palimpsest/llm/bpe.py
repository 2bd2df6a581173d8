"""Byte-level BPE by backtracking from longest matches, with an Aho-Corasick automaton.

Bytes become Latin-1 characters, so that pyahocorasick can find vocabulary entries in them. One
pass over a piece gives the longest entry that starts at each of its bytes. The encoder takes
longest entries from left to right; two neighbours stand only if merging by ranks would never join
bytes across their border, which unmerging both tells and a memo keeps. Where no entry fits, it
takes a shorter prefix, and where none is left, it steps back over the last one; a position that
was left in this way is not entered again, so the work is linear in the piece. The
result is the sequence that merging by ranks gives.

Defined results: null and empty texts have no ids; repeated rows, and rows that share an id or have
none, are encoded each; an empty table gives no rows. Very long texts and pieces are encoded whole,
and pieces beyond a bound of length are not kept. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .chunks import ChunkCache, Kept
from .common import kept_by_worker, map_arrow

_MOST_PAIRS = 1_000_000


class Backtracking:
    """The encoder for one rank file: entries in base64 and their ranks, a line each."""

    def __init__(self, path: str, pattern: str):
        self.pattern = regex.compile(pattern)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for entry, rank in ranks.items():
            self.bytes[rank] = entry
        self.size = [len(x) for x in self.bytes]
        self.automaton = ahocorasick.Automaton()
        for entry, rank in ranks.items():
            self.automaton.add_word(entry.decode("latin-1"), rank)
        self.automaton.make_automaton()
        n = len(self.bytes)
        self.left, self.right, self.joined, self.shorter = list(range(n)), list(range(n)), {}, [-1] * n
        self.pairs: dict[int, bool] = {}
        for rank, entry in enumerate(self.bytes):
            cut = next((x for x in range(len(entry) - 1, 0, -1) if entry[:x] in ranks), 0)
            self.shorter[rank] = ranks[entry[:cut]] if cut else -1
            for x in range(len(entry) - 1, 0, -1):  # the last merge that made the entry
                a, b = ranks.get(entry[:x], n), ranks.get(entry[x:], n)
                if a < rank and b < rank and self._stand(a, b):
                    self.left[rank], self.right[rank] = a, b
                    self.joined[a, b] = rank
                    break
        self.kept = Kept(lambda x: array("I", self.piece(x.encode())).tobytes(), 600_000)

    def _stand(self, a: int, b: int) -> bool:
        """Whether a and b stay neighbours: undo the later merge again and again; no pair across may join before."""
        bound, left, right, joined = len(self.bytes), self.left, self.right, self.joined
        while True:
            made = joined.get((a, b))
            if made is not None and made < bound:
                return False
            if a > b:
                bound, a = a, right[a]
                if a == bound:
                    bound, b = b + 1, left[b]
                    if b + 1 == bound:
                        return True
            else:
                bound, b = b + 1, left[b]
                if b + 1 == bound:
                    bound, a = a, right[a]
                    if a == bound:
                        return True

    def stand(self, a: int, b: int) -> bool:
        key = a << 20 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > _MOST_PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self._stand(a, b)
        return got

    def piece(self, data: bytes) -> list[int]:
        if not data:
            return []
        text, n = data.decode("latin-1"), len(data)
        longest, size = [-1] * n, self.size
        for end, rank in self.automaton.iter(text):
            longest[end + 1 - size[rank]] = rank  # ends ascend: the longest comes last
        out: list[int] = []
        open_at, at, token = bytearray(b"\x01") * (n + 1), 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0 and not (open_at[at + size[token]] and (last < 0 or self.stand(last, token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            elif last < 0:
                raise ValueError("a byte is not in the vocabulary")
            else:
                open_at[at] = 0
                token = out.pop()
                at -= size[token]
        return out

    def encode(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        self.kept.trim()
        return b"".join(map(self.kept.young.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@kept_by_worker
def encoder(path: str, pattern: str) -> tuple[Backtracking, ChunkCache]:
    """One for each process."""
    own = Backtracking(path, pattern)
    return own, ChunkCache(own.encode)


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if with_ids, ids and decoded (binary)."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = cache.encode([x or "" for x in part.column(1).to_pylist()])
                back = [own.decode(x) for x in ids]
                sha = lambda all_: pa.array([hashlib.sha256(x).hexdigest() for x in all_], pa.string())
                cols = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha(back)]
                if with_ids:
                    cols += [pa.array(ids, pa.binary()), pa.array(back, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * with_ids)
