"""Operators against brute force, round trips and held-out labels, on small tables with odd rows."""

import base64
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from palimpsest.llm import bpe, neardup, ngram_lm, quality, source_mix, token_files, topk, url_reputation, webp
from palimpsest.llm.common import discard, materialize

def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7?q", "http://example.com/en/8", "https://x.net/de/1#f", "http://www.example.net/de/8/9", "ftp://b.org/es/://z", "http://notcom/en/", "http://com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_reputation.judge_urls(pages, labels).collect()}
    assert [got[i]["rule"] for i in range(10)] == [None, None, None, "example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "org/es/", None, "com/en/"]
    assert [got[i]["verdict"] for i in range(3, 8)] == ["allow", "block", "allow", "block", "block"]
    assert (got[3]["host"], got[3]["path"]) == ("a.example.com", "/en/7") and (got[0]["host"], got[0]["path"]) == ("", "")
    assert url_reputation.judge_urls(pages.limit(0), labels).count() == 0
    assert {r["verdict"] for r in url_reputation.judge_urls(pages.filter("page_id < 3"), labels.limit(0)).collect()} == {"allow"}


def test_quality(spark, docs, none):
    good, bad = ("the quick fox runs over the hill and sleeps well. " * 3).encode(), ("BUY!! NOW!! CHEAP!! " * 9).encode()
    m = quality.fit_texts([good, bad] * 30, [1, 0] * 30)
    a, b, _ = m.scores([good, bad, b""], quality.Shapes())
    assert a > 0.7 and b < 0.3
    labels = spark.createDataFrame([(3, 1), (4, None), (77, 0)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert quality.keep_good(none, quality.fit(none, labels)).count() == 0


def test_quality_is_fitted_in_a_task(spark, monkeypatch):
    """The driver gets the model alone, and it is what plain code makes of the same texts."""
    texts = {i: " ".join(f"{'good' if i % 2 else 'bad'}{(i * j) % 7}" for j in range(30)) for i in range(60)} | {3: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    learnt = [i for i in texts if zlib.crc32(str(i).encode()) % quality.FOLDS]
    learnt.sort(key=lambda i: zlib.crc32(str(i).encode()))
    plain = quality.fit_texts([(texts[i] or "").encode() for i in learnt], [i % 2 for i in learnt])
    model = quality.fit(docs, labels)
    some = [(t or "").encode() for t in texts.values()]
    assert model.layers is not None and np.array_equal(model.scores(some, quality.Shapes()), plain.scores(some, quality.Shapes()))
    monkeypatch.setattr(quality, "fit_texts", lambda *a: os.getpid())
    assert quality.fit(docs, labels) != os.getpid()


def test_mix(spark, docs, none):
    got = source_mix.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(source_mix.oracle()).fetchall()
    key = lambda rows: sorted(map(repr, rows))
    assert key([tuple(r[c] for c in ("doc_id", "source", "size", "source_size", "target", "taken")) for r in got]) == key(want)
    assert source_mix.mix(none).count() == 0
    big = spark.createDataFrame([(i, "w " * (50 + i % 7), f"s{i % 4}") for i in range(4000)], "doc_id long, text string, source string")
    rows = source_mix.mix(big).groupBy("source", "target").sum("taken").collect()
    assert all(abs(r[2] - r["target"]) <= 64 for r in rows)


def test_language_model(docs, none):
    got = [r for r in ngram_lm.score(docs).collect()]
    words = lambda t: (t or "").encode().lower().split() + [0]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == Counter((d, held(d), len(words(t)), sum(w in c for w in words(t)), n, round(base(t), 5)) for d, t in rows)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert ngram_lm.score(none).count() == 0


@pytest.mark.parametrize("dtype", ["<u2", "<u4", "<u8", "<i8"])
@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_packed_numbers_come_back(dtype, n):
    x = np.random.default_rng(n).integers(0, np.iinfo(dtype).max, n, dtype=dtype, endpoint=True)
    assert ngram_lm.unpacked(ngram_lm.packed(x), dtype).tolist() == x.tolist()
    assert ngram_lm.unpacked(ngram_lm.packed(np.sort(x), True), dtype, True).tolist() == sorted(x.tolist())


def test_discard_deletes_written_tables_only(spark, tmp_path):
    path = str(tmp_path / "kept.parquet")
    spark.range(3).write.parquet(path)
    kept, written = spark.read.parquet(path), materialize(spark.range(5), "written")
    files = [f.removeprefix("file://") for f in written.inputFiles()]
    assert files and all(map(os.path.exists, files))
    for df in (kept, written):
        discard(df)
    assert kept.count() == 3 and not any(map(os.path.exists, files))


def test_language_model_counts_pairs_of_all_words(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "DENSE", 3)
    monkeypatch.setattr(ngram_lm, "FREQUENT", 15)
    monkeypatch.setattr(ngram_lm, "BUCKET_TOKENS", 500)
    r, rows = random.Random(5), []
    for i in range(400):
        listed = []
        for _ in range(r.randint(0, 25)):
            w = int(60 ** r.random())
            listed += [f"w{w}", f"x{w}"] if r.random() < 0.6 else [f"u{r.randrange(400)}"]
        rows.append((i if i % 50 else None, " ".join(listed)))
    got = ngram_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = lambda t: list(zip([0, *t.split()], [*t.split(), 0], strict=True))
    fold = lambda d: 0 if d is None else zlib.crc32(str(d).encode()) % 10

    def estimates(rows):
        hw = Counter(p for _, t in rows for p in pairs(t))
        h, w, n = Counter(), Counter(), sum(hw.values())
        for (a, b), k in hw.items():
            h[a] += k
            w[b] += k
        return lambda a, b: (int(math.log2(h[a] + 1)), hw[a, b] / max(h[a], 1), w[b] / n), len(w)

    train = [x for x in rows if fold(x[0])]
    part, _ = estimates([x for x in train if fold(x[0]) != 1])
    whole, distinct = estimates(train)
    uniform, weights = 1 / (distinct + 1), {b: [1 / 3] * 3 for b in range(40)}
    tune = [part(*p) for d, t in train if fold(d) == 1 for p in pairs(t)]
    for _ in range(30):
        mass = {b: [1e-3] * 3 for b in range(40)}
        for b, p2, p1 in tune:
            x = [k * p for k, p in zip(weights[b], (p2, p1, uniform), strict=True)]
            mass[b] = [m + v / sum(x) for m, v in zip(mass[b], x, strict=True)]
        weights = {b: [v / sum(x) for v in x] for b, x in mass.items()}

    def want(t):
        return sum(math.log10(sum(k * p for k, p in zip(weights[e[0]], (*e[1:], uniform), strict=True))) for e in (whole(*p) for p in pairs(t)))

    assert len(got) == len(rows)
    key = lambda d, n, s: (d is None, d or 0, n, s)
    for a, b in zip(sorted(key(x["doc_id"], x["n_tokens"], x["score"]) for x in got), sorted(key(d, len(pairs(t)), want(t)) for d, t in rows), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 0.01 * a[2]


def test_huffman():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 255, 256, 257, 5000):
        ids = (r.zipf(1.3, n) % 3000).astype(np.uint32)
        code = token_files.Code(token_files.code_lengths(np.bincount(ids) if n else np.zeros(1, np.int64)))
        assert (token_files.segment_ids(code, token_files.segment_bytes(code, ids)) == ids).all()
    skewed = token_files.code_lengths(np.array([2**i for i in range(30)]))
    assert skewed.max() <= 16 and sum(2.0 ** -skewed.astype(float)) == 1.0


def test_token_files(docs, none):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = [], 0
    for d, t in rows:
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in token_files.write_and_read(docs, with_ids=False).collect()), key=lambda r: r[1]) == want
    assert token_files.write_and_read(none).count() == 0


def _reference_bpe():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, none):
    other, r = _reference_bpe(), random.Random(1)
    own = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)[1]
    for x in ["a" * 3000, " " * 3000, "\n" * 99, *("".join(r.choice("ab \n\t'sé日1 2.!?  the theing　\xa0 😀") for _ in range(r.randint(0, 60))) for _ in range(500))]:
        assert own.encode([x])[0] == np.array(other.encode_ordinary(x), "<u4").tobytes()
    for row, text in zip(bpe.encode(docs).collect(), [r["text"] for r in docs.collect()], strict=True):
        assert row["decoded"].decode() == (text or "") and row["n_tokens"] == len(other.encode_ordinary(text or ""))
    assert bpe.encode(none).count() == 0


def test_topk(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(300, 6))
    v[50:90] = v[50]
    rows = [(i, [float(x) for x in v[i] * (1 + i % 5)]) for i in range(300)] + [(400, None), (420, [1.0, None]), (440, [float("nan")]), (460, [0.0]), (None, [1.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    ok = {i: np.array([math.floor(64 * y) for y in x] + [0] * (6 - len(x))) for i, x in rows if i is not None and x and all(y is not None and math.isfinite(y) for y in x)}
    want = set()
    for q in (i for i in ok if i % 20 == 0):
        best = sorted((-int(ok[q] @ ok[c]), c) for c in ok if c != q)[:20]
        want |= {(q, k, c, -s) for k, (s, c) in enumerate(best, 1)}
    assert {tuple(x) for x in got} == want
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("times", [1, 1 << 17, 1 << 22])
def test_topk_stores_no_pairs_of_blocks(spark, monkeypatch, times):
    """Many blocks and buckets, lengths, close vectors and ties, against brute force; blocks are sent to no one once for each bucket."""
    for name, x in {"BUCKET": 16, "BLOCK": 8, "HEAD": 30, "WAITING": 50, "PART_BYTES": 4000}.items():
        monkeypatch.setattr(topk, name, x)
    r = np.random.default_rng(3)
    v = r.normal(size=(700, 5)) * times
    v[100:300] = v[100] * (1 + np.arange(200)[:, None] % 3) + r.normal(size=(200, 5)) * times * (np.arange(200)[:, None] % 2) / 50
    df = topk.search(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), query_every=10)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "explode" not in plan and plan.count("BroadcastExchange") == 1  # the levels' sizes
    m = np.floor(64 * v).astype(np.int64)
    want = {(q, k, c, int(m[q] @ m[c])) for q in range(0, 700, 10) for k, c in enumerate(sorted((c for c in range(700) if c != q), key=lambda c: (-int(m[q] @ m[c]), c))[:20], 1)}
    assert {tuple(x) for x in df.collect()} == want


def test_media(docs, none):
    for row, t in zip(webp.store(docs).collect(), [r["text"] for r in docs.collect()], strict=True):
        raw = webp.padded((t or "").encode())
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (len((t or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert row["media_sha256"] == hashlib.sha256(row["media"]).hexdigest() and webp.decode_payloads([row["media"]]) == [raw]
    assert webp.store(none).count() == 0


def _literals(w, pixels, cache=0):
    """Codes and literals of an image, every channel with a full code of its own."""
    w.put(1 if cache else 0, 1)
    if cache:
        w.put(cache, 4)
    seen, symbols = [0] * (1 << cache if cache else 0), []
    for p in pixels.tolist():
        slot = (webp.CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache) if cache else 0
        symbols.append([280 + slot] if cache and seen[slot] == p else [p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24])
        if cache:
            seen[slot] = p
    return symbols


def _emit(w, symbols, cache=0, top=False):
    if top:
        w.put(0, 1)
    sizes = (280 + ((1 << cache) if cache else 0), 256, 256, 256)
    lengths = [webp.prefix_lengths(np.bincount([s[k] for s in symbols if len(s) > k], minlength=n), 12) for k, n in enumerate(sizes)]
    for x in lengths:
        webp.write_code(w, x)
    webp._constant(w, 0)
    codes = [webp.codes_of(x) for x in lengths]
    for s in symbols:
        for k, x in enumerate(s):
            if np.count_nonzero(lengths[k]) > 1:
                w.put(int(codes[k][x]), int(lengths[k][x]))


def _file(width, height, put):
    import struct

    w = webp.Writer()
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    put(w)
    body = b"\x2f" + w.value.to_bytes(w.n // 8 + 1, "little")
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


def test_decoder_inverts_transforms_and_cache():
    r = np.random.default_rng(4)
    rest = r.integers(0, 1 << 32, 48, np.uint64).astype(np.uint32).repeat(2)[:72]
    modes = np.array([11 << 8, 12 << 8, 13 << 8, 5 << 8, 1 << 8, 10 << 8], np.uint32)

    def put(w):
        for kind in (webp.SUBTRACT_GREEN, webp.PREDICTOR, webp.CROSS_COLOUR):
            w.put(1, 1)
            w.put(kind, 2)
            if kind != webp.SUBTRACT_GREEN:
                w.put(0, 3)
                _emit(w, _literals(w, modes if kind == webp.PREDICTOR else modes * np.uint32(77)))
        w.put(0, 1)
        _emit(w, _literals(w, rest, 3), 3, True)

    (got,) = webp.decode_many([_file(9, 8, put)])
    x = webp._uncross(rest, 8, 9, 2, modes * np.uint32(77))
    x = webp._add_green(webp._unpredict(x, 8, 9, 2, modes), 8, 9)
    assert (got.ravel() == x).all()


def test_inverse_transforms_by_hand():
    assert webp._add_green(np.array([0xFF010203], np.uint32), 1, 1)[0] == 0xFF030205
    left = webp._unpredict(np.array([0x01010101, 0x01010101], np.uint32), 1, 2, 2, np.array([0], np.uint32))
    assert left.tolist() == [0x00010101, 0x01020202]
    cross = webp._uncross(np.array([0xFF001000], np.uint32), 1, 1, 2, np.array([0x00000020], np.uint32))
    assert cross[0] == 0xFF101000
