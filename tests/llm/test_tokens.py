"""Chunk caches against the libraries, on random texts of odd characters."""

import base64
import random

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from palimpsest.llm import bpe, chunks, token_files

PARTS = [*"ab \n\t's日é²½½１_.,!?-\"()  \xa0́\x1c\x85😀ßİ", "the", "Word", "<|endoftext|>", "don't", " I'll", "\r\n", "  ", "\n\n", "ﬁ", "ʰ"]


def _texts(n):
    r = random.Random(5)
    return ["", " ", "a" * 5000, "日" * 3000, *("".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n))]


def test_token_ids_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, cache = Tokenizer.from_file(path), token_files.tokenizer(path)
    own.encode_special_tokens = True
    for x in _texts(8000):
        assert cache.encode([x])[0] == np.array(own.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x


def test_byte_bpe_ids_equal_the_library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, cache = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for x in _texts(8000):
        ids = cache.encode([x])[0]
        assert ids == np.array(other.encode_ordinary(x), "<u4").tobytes(), x
        assert own.decode(ids) == x.encode()


def test_kept_is_bounded():
    kept = chunks.Kept(lambda x: x.encode(), 10)
    for i in range(100):
        kept.trim()
        assert kept.young[f"k{i}"] == b"k%d" % i and len(kept.young) <= 6 and len(kept.old) <= 6
    long = "x" * (chunks.LONGEST + 1)
    assert kept.young[long] == long.encode() and long not in kept.young


def test_segments_carry_counts_and_short_ids(spark, monkeypatch):
    """Shards of several segments, ids in two bytes, counts with each shard's last segment, order by text behind long beginnings."""
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 400)
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    rows = [(i // 40 if i % 7 else None, "the same beginning " * (20 * (i % 3)) + f"text {i * 7919 % 300} of é") for i in range(300)] + [(5, None), (5, "")]
    want = [[*own.encode(t or "", add_special_tokens=False).ids, 2] for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))]
    got = token_files.token_segments(spark.createDataFrame(rows, "doc_id long, text string"), path).orderBy("shard", "segment").collect()
    assert max(r["segment"] for r in got) > 1
    sizes = [n for r in got for n in r["sizes"]]
    ids = np.concatenate([token_files.ids_of(r["ids"], sum(r["sizes"])) for r in got])
    assert sizes == list(map(len, want)) and ids.tolist() == [x for y in want for x in y]
    assert all(len(r["ids"]) == 2 * sum(r["sizes"]) for r in got)
    assert [r["counts"] is not None for r in got] == [i + 1 == len(got) or got[i + 1]["shard"] != r["shard"] for i, r in enumerate(got)]
    counts = {r["id"]: r["n"] for r in token_files.id_counts(spark.createDataFrame(got, token_files.token_segments(spark.createDataFrame(rows[:1], "doc_id long, text string"), path).schema)).collect()}
    values, n = np.unique(ids, return_counts=True)
    assert counts == dict(zip(values.tolist(), n.tolist(), strict=True))


def test_large_ids_take_four_bytes():
    for ids in ([], [1, 65535], [1, 65536], [70000]):
        x = np.array(ids, "<u4")
        assert token_files.ids_of(token_files.short(x), len(ids)).tolist() == ids
