"""Whole texts as sequences of chunks that byte-level BPE encodes independently, with caches.

The split pattern of these vocabularies never lets a piece run on into a space that stands alone
between two characters that aren't white space, so texts can be cut in front of each such space.
Most chunks recur: their ids are kept as little-endian bytes, in a cache that is bounded by its
number of chunks and by their length; longer chunks are encoded each time.
"""

from __future__ import annotations

from collections.abc import Callable

#: Characters of the longest chunk or piece that is kept.
LONGEST = 48


class _NotAlone(Exception):
    """A space beside other white space: only the split pattern itself can cut the text."""


class _Young(dict):
    __slots__ = ("missed",)

    def __missing__(self, key: str) -> bytes:
        return self.missed(key)


class Kept:
    """Values by key in two generations: when the young one is full, it becomes the old one, and only what is asked for again moves on."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most, self.old = make, most // 2, {}
        self.young = self._fresh()

    def _fresh(self) -> _Young:
        out = _Young()
        out.missed = self._missed
        return out

    def _missed(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= LONGEST:
            self.young[key] = got
        return got

    def trim(self) -> None:
        if len(self.young) > self.most:
            self.old, self.young = self.young, self._fresh()


class ChunkCache:
    """ids of texts, as bytes, through encode(text) -> ids; most: chunks kept at a time."""

    def __init__(self, encode: Callable[[str], bytes], most: int = 600_000):
        self.encode_whole = encode
        self.kept = Kept(self._chunk, most)

    def _chunk(self, chunk: str) -> bytes:
        """Of a chunk with the space in front of it."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _NotAlone
        return self.encode_whole(" " + chunk)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            first, *rest = text.split(" ")
            self.kept.trim()
            if first and rest and first[-1].isspace():
                out.append(self.encode_whole(text))
                continue
            try:
                ids = b"".join(map(self.kept.young.__getitem__, rest))
            except _NotAlone:
                out.append(self.encode_whole(text))
                continue
            out.append((self.encode_whole(first) if first else b"") + ids)
        return out
