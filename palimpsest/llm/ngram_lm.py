"""Language-model scores by deleted interpolation of word bigrams.

Counts of all words and of all word pairs come from every training document. The probability of a
token mixes maximum-likelihood estimates of the word after the word before it (the start of a
document stands for the word before its first token), of the word by itself and a uniform one,
with weights by the bucket of the context's frequency (powers of two). The weights are learned by
expectation-maximisation on a held-out part of the training documents, with estimates from the
other part; the scores then use the estimates from both. For learning, tokens whose estimates are
within an eighth of a power of two of each other are put together, with their means.

Only the most frequent words, FREQUENT at most, are sent to all tasks, as numbers. Pairs of the DENSE
most frequent ones are counted in a table of that size; any other pair has less than 1 / DENSE of all
tokens. All other pairs go, with the documents they come from, as packed arrays to the bucket of
their number, of their rarer word's hash, or, if both words are rarer, of the first one's and then
the second one's hash. A bucket has all occurrences of its pairs and rarer words, so it counts them
by itself. What comes back is summed by document. Hashes have 64 bits; among a billion
rarer words, two share one with a probability of 3 %.

Defined results: null and empty texts: only the end token is scored. Documents without an id count as
held out. Without training documents, and so in an empty table, all counts are 0. Repeated rows count
and are scored each. Words of any length count by all of their bytes (beyond 64 by a digest of them),
texts are read whole. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, ship

FOLDS, TUNING_FOLD, ADD = 10, 1, 0.1
DENSE, FREQUENT, BUCKETS, ROUNDS = 1024, 65_535, 40, 30
#: Tokens of the training documents for each bucket of pairs, and tokens and documents that a task holds before it passes them on.
BUCKET_TOKENS, HELD_TOKENS, HELD_DOCS = 1_000_000, 500_000, 16_000
HELD_OUT, FIT, TUNE = 0, 1, 2
#: Distinct words that a task counts before it passes them on.
MOST_KEPT = 300_000
#: The end token; words are never empty.
END = b""
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: object) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS if doc_id is not None else 0


def part(doc_id: object) -> int:
    f = fold(doc_id)
    return HELD_OUT if not f else TUNE if f == TUNING_FOLD else FIT


def words_of(text: bytes | None) -> list[bytes]:
    return [w if len(w) <= 64 else b"\0" + hashlib.sha256(w).digest() for w in (text or b"").translate(_LOWER).split()]


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (word, n, tune) of the training documents, the end token included; tune is the tuning part's share of n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tune = Counter(), Counter()

        def flush():
            counts = [pa.array(list(total.values()), pa.int64()), pa.array([tune[w] for w in total], pa.int64())]
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), *counts], ["word", "n", "tune"])
            total.clear()
            tune.clear()
            return out

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if p := part(d):
                    listed = [*words_of(text.as_py()), END]
                    total.update(listed)
                    if p == TUNE:
                        tune.update(listed)
                    if len(total) > MOST_KEPT:
                        yield flush()
        if total:
            yield flush()

    counted = map_arrow(docs.select("doc_id", "text"), run, "word binary, n long, tune long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("tune").alias("tune"))


def most_frequent(counts: DataFrame) -> list[tuple[bytes, int, int]]:
    """Words (with n and tune) from the least count on that at most FREQUENT words reach."""
    some = F.floor(F.log2("n") * 16).cast("int")
    steps = sorted(((r[0], r[1]) for r in counts.groupBy(some).agg(F.count(F.lit(1))).collect()), reverse=True)
    least, total = None, 0
    for step, n in steps:
        total += n
        if total > FREQUENT:
            break
        least = step
    rows = counts.filter((some >= least if least is not None else F.lit(False)) | (F.col("word") == F.lit(END))).collect()
    return sorted(((bytes(r["word"]), int(r["n"]), int(r["tune"])) for r in rows), key=lambda r: (-r[1], r[0]))


class Words:
    """The frequent words' places in the order of their counts; the end token is the first, and as a context the start."""

    def __init__(self, rows: list[tuple[bytes, int, int]], tokens: int, tune_tokens: int, distinct: int, dense: int):
        self.tokens, self.fit_tokens, self.distinct = tokens, tokens - tune_tokens, distinct
        end = next((r for r in rows if r[0] == END), (END, 0, 0))
        rows = [end, *(r for r in rows if r[0] != END)][:65_536]  # places have 16 bits
        self.place = {w: i for i, (w, _, _) in enumerate(rows)}
        self.count, self.tune = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
        self.dense = min(dense, len(rows))
        self.buckets = 1 + tokens // BUCKET_TOKENS
        self.log_base = float(np.log10(tokens + ADD * (distinct + 1)))

    def places(self, words: list[bytes]) -> np.ndarray:
        """Of the words and the end token; -1 for rarer words."""
        return np.append(np.fromiter((self.place.get(w, -1) for w in words), np.int64, len(words)), 0)


#: Pairs of frequent words, with a rarer first or second word, of two rarer words.
FREQUENT_PAIR, RARE_FIRST, RARE_SECOND, RARE_BOTH = 0, 1, 2, 3
#: A row is a document, or pairs of a kind and bucket: their numbers or hashes, the other words, and whose each one is, counted from ``row``.
_COLUMNS = (("row", pa.int64()), ("doc_id", None), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("dense", pa.binary()), ("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("others", pa.binary()), ("rows", pa.binary()))
_KEYS = ("<u4", "<u8", "<u8", "<u8")
_OTHERS = (None, "<u2", "<u2", "<u8")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def packed(x: np.ndarray, ascending: bool = False) -> bytes:
    """The numbers' first bytes, then their second ones, and so on, which compress far better; of ascending numbers, their steps."""
    x = np.diff(x, prepend=x.dtype.type(0)) if ascending else np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unpacked(data: bytes, dtype: str, ascending: bool = False) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()
    return np.cumsum(x, dtype=dtype) if ascending else x


def _code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair."""
    return _mixed(_mixed(a.astype(np.uint64)) + b.astype(np.uint64))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(keys.astype(np.uint64)) >> np.uint64(33)) % np.uint64(buckets)


def tokens(docs: DataFrame, sent) -> DataFrame:
    """All tokens of all documents after their contexts. The last two bits of a row's number are the document's part."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words: Words = sent.value
        log_count, at = np.log10(words.count + ADD), TaskContext.get().partitionId() << 36
        held: list[list[tuple]] = [[], [], [], []]
        first, n_held = at, 0

        def rows(id_type, **columns):
            n = len(columns["row"])
            return pa.RecordBatch.from_arrays([pa.array(columns[k], t or id_type) if k in columns else pa.nulls(n, t or id_type) for k, t in _COLUMNS], [k for k, _ in _COLUMNS])

        def flush(id_type):
            out = []
            for k, parts in enumerate(held):
                if not parts:
                    continue
                keys, others = (np.concatenate([p[i] for p in parts]) if parts[0][i] is not None else None for i in (0, 1))
                owner = np.repeat(np.array([p[2] - (first << 2) for p in parts], "<u2"), [len(p[0]) for p in parts])
                bucket = _bucket(keys, words.buckets)
                order = np.lexsort((keys, bucket))
                which, start = np.unique(bucket[order], return_index=True)
                for b, part in zip(which.tolist(), np.split(order, start[1:]), strict=True):
                    out.append((first << 2, k, b, packed(keys[part], True), packed(others[part]) if others is not None else None, packed(owner[part])))
                parts.clear()
            return rows(id_type, **dict(zip(("row", "kind", "bucket", "keys", "others", "rows"), zip(*out, strict=True), strict=True)))

        for batch in batches:
            ids, out = batch.column(0), []
            for d, text in zip(ids.to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                listed, row = words_of(text.as_py()), at << 2 | part(d)
                own = words.places(listed)
                before = np.append(0, own[:-1])
                known = own[own >= 0]
                dense = (own >= 0) & (own < words.dense) & (before >= 0) & (before < words.dense)
                frequent = (own >= 0) & (before >= 0) & ~dense
                out.append((row, len(own), int((words.count[known] > 0).sum()), float(log_count[known].sum()) - len(own) * words.log_base, packed((before[dense] * words.dense + own[dense]).astype("<u4"))))
                if frequent.any():
                    held[FREQUENT_PAIR].append(((before[frequent] << 16 | own[frequent]).astype("<u4"), None, row))
                rare = np.flatnonzero(own < 0)
                if len(rare):
                    code = np.zeros(len(own) + 1, "<u8")
                    code[rare + 1] = np.fromiter((xxhash.xxh3_64_intdigest(listed[i]) for i in rare.tolist()), np.uint64, len(rare))
                    one, two = own < 0, before < 0
                    for k, which, key, other in ((RARE_FIRST, two & ~one, code[:-1], own), (RARE_SECOND, one & ~two, code[1:], before), (RARE_BOTH, one & two, code[:-1], code[1:])):
                        if which.any():
                            held[k].append((key[which], other[which].astype(_OTHERS[k]), row))
                n_held += len(own)
                at += 1
                if n_held > HELD_TOKENS or at - first >= HELD_DOCS:
                    if any(held):
                        yield flush(ids.type)
                    first, n_held = at, 0
            if out:
                yield rows(ids.type, doc_id=ids, **dict(zip(("row", "n_tokens", "n_known", "base", "dense"), zip(*out, strict=True), strict=True)))
        if any(held):
            yield flush(ids.type)

    schema = f"row long, doc_id {kind}, n_tokens long, n_known long, base double, dense binary, kind int, bucket int, keys binary, others binary, rows binary"
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def _joined(column, dtype: str, ascending: bool = False) -> np.ndarray:
    return np.concatenate([unpacked(x.as_py(), dtype, ascending) for x in column] or [np.zeros(0, dtype)])


def _owners(group: pa.Table) -> np.ndarray:
    return np.concatenate([unpacked(x.as_py(), "<u2").astype(np.int64) + r for x, r in zip(group["rows"], group["row"].to_pylist(), strict=True)] or [np.zeros(0, np.int64)])


def _tally(at: np.ndarray, n: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of the training documents and of the tuning part have each number below n."""
    return tuple(np.bincount(at[x], minlength=n).astype("<i8") for x in (rows & 3 > 0, rows & 3 == TUNE))


#: Counts of distinct pairs: of the context, the word and the pair, in all training documents and in the tuning part; how many tokens each has, and whose those are. known: base scores have the word already.
_NUMBERS = ("h", "h_tune", "w", "w_tune", "hw", "hw_tune", "times", "rows")
_COUNTED = ", ".join(f"{c} binary" for c in _NUMBERS) + ", known boolean"
#: Pairs of two rarer words on their way to the second one's bucket.
_PASSED = "bucket int, keys binary, h binary, h_tune binary, hw binary, hw_tune binary, times binary, rows binary"


def rare_firsts(both: DataFrame, sent) -> DataFrame:
    """Pairs whose first word is rarer, counted in that word's bucket: whole if the second one is frequent, else to be passed on."""

    def run(group: pa.Table) -> pa.Table:
        words: Words = sent.value
        kinds = np.array(group["kind"])
        parts = [group.filter(pa.array(kinds == k)) for k in (RARE_FIRST, RARE_BOTH)]
        key, row = [_joined(p["keys"], "<u8", True) for p in parts], [_owners(p) for p in parts]
        distinct, at = np.unique(np.concatenate(key), return_inverse=True)
        h, h_tune = _tally(at, len(distinct), np.concatenate(row))
        out = {c: [] for c in ("bucket", "keys", *_NUMBERS, "known")}
        for k, part, keys, rows, at_h in zip((RARE_FIRST, RARE_BOTH), parts, key, row, np.split(at, [len(key[0])]), strict=True):
            others = _joined(part["others"], _OTHERS[k])
            if not len(keys):
                continue
            target = _bucket(others, words.buckets).astype(np.int64) if k == RARE_BOTH else np.zeros(len(keys), np.int64)
            order = np.lexsort((_code(keys, others), target))
            code, rows, target, others, at_h = _code(keys, others)[order], rows[order], target[order], others[order], at_h[order]
            start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            pair = np.cumsum(np.concatenate([[0], code[1:] != code[:-1]]))
            hw, hw_tune = _tally(pair, len(start), rows)
            numbers = {"h": h[at_h[start]], "h_tune": h_tune[at_h[start]], "hw": hw, "hw_tune": hw_tune, "times": np.diff(np.append(start, len(rows)))}
            which, cut = np.unique(target[start], return_index=True)
            for b, i, j in zip(which.tolist(), cut.tolist(), [*cut[1:].tolist(), len(start)], strict=True):
                some, own = slice(i, j), others[start[i:j]]
                end = int(start[j]) if j < len(start) else len(rows)
                got = {c: x[some] for c, x in numbers.items()} | {"rows": rows[start[i] : end]}
                got |= {"w": words.count[own], "w_tune": words.tune[own]} if k == RARE_FIRST else {"keys": own}
                for c in ("keys", *_NUMBERS):
                    out[c].append(packed(got[c].astype("<u8" if c == "keys" else "<i8")) if c in got else None)
                out["bucket"].append(b if k == RARE_BOTH else None)
                out["known"].append(True)
        return pa.table({c: pa.array(x, pa.int32() if c == "bucket" else pa.bool_() if c == "known" else pa.binary()) for c, x in out.items()})

    ship(both.sparkSession)
    got = both.filter(F.col("kind").isin(RARE_FIRST, RARE_BOTH)).select("kind", "bucket", "row", "keys", "others", "rows")
    return materialize(got.groupBy("bucket").applyInArrow(run, f"bucket int, keys binary, {_COUNTED}"), "firsts")


def rare_seconds(both: DataFrame, firsts: DataFrame, sent) -> DataFrame:
    """Pairs whose second word is rarer, counted in that word's bucket."""

    def run(group: pa.Table) -> pa.Table:
        words: Words = sent.value
        kinds = np.array(group["kind"])
        some, passed = (group.filter(pa.array(kinds == k)) for k in (RARE_SECOND, RARE_BOTH))
        key, place, row = _joined(some["keys"], "<u8", True), _joined(some["others"], "<u2"), _owners(some)
        number = {c: _joined(passed[c], "<i8") for c in ("h", "h_tune", "hw", "hw_tune", "times")}
        passed_key, passed_row = _joined(passed["keys"], "<u8"), _joined(passed["rows"], "<i8")
        distinct, at = np.unique(np.concatenate([key, passed_key]), return_inverse=True)
        own, of_passed = at[: len(key)], at[len(key) :]
        w, w_tune = _tally(np.concatenate([own, np.repeat(of_passed, number["times"])]), len(distinct), np.concatenate([row, passed_row]))
        code = _code(key, place)
        order = np.argsort(code, kind="stable")
        code, row, place, own = code[order], row[order], place[order], own[order]
        new = np.concatenate([np.ones(min(1, len(code)), bool), code[1:] != code[:-1]])
        start = np.flatnonzero(new)
        hw, hw_tune = _tally(np.cumsum(new) - 1, len(start), row)
        first = {"h": words.count[place[start]], "h_tune": words.tune[place[start]], "w": w[own[start]], "w_tune": w_tune[own[start]], "hw": hw, "hw_tune": hw_tune, "times": np.diff(np.append(start, len(row))), "rows": row}
        number |= {"w": w[of_passed], "w_tune": w_tune[of_passed], "rows": passed_row}
        return pa.table({c: pa.array([packed(np.concatenate([first[c], number[c]]).astype("<i8"))], pa.binary()) for c in _NUMBERS} | {"known": pa.array([False])})

    own = both.filter(F.col("kind") == RARE_SECOND).select("kind", "bucket", "row", "keys", "others", "rows")
    more = firsts.filter("bucket IS NOT NULL").select(F.lit(RARE_BOTH).alias("kind"), "bucket", "keys", "rows", "h", "h_tune", "hw", "hw_tune", "times")
    return materialize(own.unionByName(more, allowMissingColumns=True).groupBy("bucket").applyInArrow(run, _COUNTED), "seconds")


def rare_pairs(both: DataFrame, sent) -> DataFrame:
    """Rows of counts of all pairs with a rarer word."""
    firsts = rare_firsts(both, sent)
    names = [*_NUMBERS, "known"]
    return firsts.filter("bucket IS NULL").select(*names).unionByName(rare_seconds(both, firsts, sent).select(*names))


def frequent_pairs(both: DataFrame) -> DataFrame:
    """A row for each bucket: its pairs, how often each comes in training documents, in the tuning part and in all, and whose each one is."""

    def run(group: pa.Table) -> pa.Table:
        key, row = _joined(group["keys"], "<u4", True), _owners(group)
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        own, start, times = np.unique(key, return_index=True, return_counts=True)
        hw, tune = (np.add.reduceat(x.astype(np.int64), start) for x in (row & 3 > 0, row & 3 == TUNE))
        numbers = {"hw": hw, "hw_tune": tune, "times": times, "rows": row}
        return pa.table({"pairs": [packed(own, True)]} | {c: [packed(x.astype("<i8"))] for c, x in numbers.items()}, pa.schema([(c, pa.binary()) for c in ("pairs", *numbers)]))

    got = both.filter(F.col("kind") == FREQUENT_PAIR).select("bucket", "row", "keys", "rows")
    return materialize(got.groupBy("bucket").applyInArrow(run, "pairs binary, hw binary, hw_tune binary, times binary, rows binary"), "pairs")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    for r in range(batch.num_rows):
        pairs = unpacked(batch.column(0)[r].as_py(), "<u4", True).astype(np.int64)
        yield (pairs >> 16, pairs & 0xFFFF, *(unpacked(c[r].as_py(), "<i8") for c in batch.columns[1:]))


def dense_counts(both: DataFrame, size: int) -> np.ndarray:
    """How often each pair of the most frequent words comes in all training documents and in the tuning part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            for row, codes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if row & 3:
                    got = unpacked(codes.as_py(), "<u4")
                    np.add.at(total[0], got, 1)
                    if row & 3 == TUNE:
                        np.add.at(total[1], got, 1)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], ["pair", "hw", "hw_tune"])

    counted = map_arrow(both.filter("n_tokens IS NOT NULL").select("row", "dense"), run, "pair long, hw long, hw_tune long")
    got = counted.groupBy("pair").agg(F.sum("hw").alias("hw"), F.sum("hw_tune").alias("hw_tune")).toPandas()
    out = np.zeros((2, size), np.int64)
    out[:, got["pair"].to_numpy(np.int64)] = got[["hw", "hw_tune"]].to_numpy(np.int64).T
    return out


def _estimates(h: np.ndarray, w: np.ndarray, hw: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the context, P(word | context) and P(word)."""
    return np.minimum(np.log2(h + 1).astype(int), BUCKETS - 1), hw / np.maximum(h, 1), w / max(tokens, 1)


_CELL = "bucket int, q2 int, q1 int, n double, p2 double, p1 double"


def cells(n: np.ndarray, h: np.ndarray, w: np.ndarray, hw: np.ndarray, tokens: int) -> pa.RecordBatch:
    """Tokens of the tuning part put together by context bucket and estimates: how many, and sums of the estimates."""
    bucket, p2, p1 = _estimates(h, w, hw, tokens)
    q2, q1 = (np.where(p > 0, np.floor(8 * np.log2(np.maximum(p, 1e-30))), 1).astype(np.int64) for p in (p2, p1))
    code, at = np.unique((bucket * 1024 + q2 + 900) * 1024 + q1 + 900, return_inverse=True)
    sums = [pa.array(np.bincount(at, x, len(code)), pa.float64()) for x in (n, n * p2, n * p1)]
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in (code >> 20, (code >> 10 & 1023) - 900, (code & 1023) - 900)), *sums], [x.split()[0] for x in _CELL.split(", ")])


def mixture(got: np.ndarray, uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of pair, word and uniform estimates for each bucket of contexts, from rows (bucket, n, p2, p1) of cells."""
    b, n, weights = got[:, 0].astype(int), got[:, 1], np.full((BUCKETS, 3), 1 / 3)
    parts = np.stack([got[:, 2] / n, got[:, 3] / n, np.full(len(n), uniform)], 1)
    for _ in range(rounds):
        share = weights[b] * parts
        share *= (n / share.sum(1))[:, None]
        mass = np.stack([np.bincount(b, share[:, k], BUCKETS) for k in range(3)], 1) + 1e-3
        weights = mass / mass.sum(1, keepdims=True)
    return weights


class Model:
    """Weights, and log10 of probabilities from counts."""

    def __init__(self, words: Words, weights: np.ndarray):
        self.weights, self.tokens, self.uniform = weights, words.tokens, 1 / (words.distinct + 1)

    def log(self, h: np.ndarray, w: np.ndarray, hw: np.ndarray) -> np.ndarray:
        bucket, p2, p1 = _estimates(h, w, hw, self.tokens)
        x = self.weights[bucket]
        return np.log10(x[:, 0] * p2 + x[:, 1] * p1 + x[:, 2] * self.uniform)


def learn(words: Words, sent, dense: np.ndarray, rare: DataFrame, frequent: DataFrame) -> Model:
    fit_tokens = words.fit_tokens

    def of_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = sent.value.count - sent.value.tune
        for batch in batches:
            for h, w, hw, tune in _unpacked(batch):
                k = tune > 0
                yield cells(tune[k], fit[h[k]], fit[w[k]], (hw - tune)[k], fit_tokens)

    def of_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                h, h_tune, w, w_tune, hw, n = (unpacked(c[r].as_py(), "<i8") for c in batch.columns)
                k = n > 0
                yield cells(n[k], (h - h_tune)[k], (w - w_tune)[k], (hw - n)[k], fit_tokens)

    rows = map_arrow(frequent.select("pairs", "hw", "hw_tune"), of_frequent, _CELL).unionByName(map_arrow(rare.select(*_NUMBERS[:6]), of_rare, _CELL)).groupBy("bucket", "q2", "q1").agg(F.sum("n"), F.sum("p2"), F.sum("p1"))
    fit, used = words.count - words.tune, np.flatnonzero(dense[1])
    own = cells(dense[1][used], fit[used // words.dense], fit[used % words.dense], (dense[0] - dense[1])[used], fit_tokens)
    both = [np.array([tuple(r) for r in rows.collect()], float).reshape(-1, 6), np.array([c.to_numpy() for c in own.columns], float).T]
    return Model(words, mixture(np.concatenate(both)[:, [0, 3, 4, 5]], 1 / (words.distinct + 1)))


#: Documents whose sums go back together, by a power of two of their rows' numbers.
BLOCK = 14
_SUMS = "block long, rows binary, score binary, base binary, known binary"


def packed_sums(which: np.ndarray, *sums: np.ndarray) -> pa.RecordBatch:
    """A row for each block of documents: which of them, and their sums. Without sums of base scores those are 0."""
    block, cut = np.unique(which >> BLOCK, return_index=True)
    parts = [[x.tobytes() for x in np.split(y, cut[1:])] for y in ((which & (1 << BLOCK) - 1).astype("<u2"), *(np.asarray(x, "<f8") for x in sums))]
    parts += [[None] * len(block)] * (4 - len(parts))
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *(pa.array(x, pa.binary()) for x in parts)], [x.split()[0] for x in _SUMS.split(", ")])


def added_sums(group: pa.Table) -> pa.Table:
    total, seen = np.zeros((3, 1 << BLOCK)), np.zeros(1 << BLOCK, bool)
    for i in range(group.num_rows):
        rows = np.frombuffer(group["rows"][i].as_py(), "<u2")
        seen[rows] = True
        for k, c in enumerate(("score", "base", "known")):
            x = group[c][i].as_py()
            if x is not None:
                total[k, rows] += np.frombuffer(x, "<f8")
    at = np.flatnonzero(seen)
    return pa.table({"row": pa.array((group["block"][0].as_py() << BLOCK) + at), "more": total[0, at], "more_base": total[1, at], "more_known": pa.array(total[2, at].round().astype(np.int64))})


def score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    counts = materialize(word_counts(docs), "words")
    n_tokens, n_tune, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tune"), F.lit(0)), F.count(F.lit(1))).first()
    words, context = Words(most_frequent(counts), int(n_tokens), int(n_tune), int(distinct), DENSE), docs.sparkSession.sparkContext
    sent = context.broadcast(words)
    discard(counts)
    both = materialize(tokens(docs, sent), "tokens")
    rare, frequent, dense = rare_pairs(both, sent), frequent_pairs(both), dense_counts(both, words.dense**2)
    texts = materialize(both.filter("n_tokens IS NOT NULL").select("row", "doc_id", "n_tokens", "n_known", "base", "dense"), "texts")
    discard(both)  # by far the largest table; all its pairs are counted
    own = learn(words, sent, dense, rare, frequent)
    every = np.arange(words.dense**2)
    logs = context.broadcast(own.log(words.count[every // words.dense], words.count[every % words.dense], dense[0]))

    def of_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = sent.value.count
        for batch in batches:
            for h, w, hw, times, rows in _unpacked(batch):
                which, at = np.unique(rows, return_inverse=True)
                yield packed_sums(which, np.bincount(at, np.repeat(own.log(count[h], count[w], hw), times), len(which)))

    def of_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                h, w, hw, times, rows = (unpacked(batch.column(c)[r].as_py(), "<i8") for c in range(5))
                which, at = np.unique(rows, return_inverse=True)
                new = not batch.column(5)[r].as_py()
                yield packed_sums(which, *(np.bincount(at, np.repeat(x, times), len(which)) for x in (own.log(h, w, hw), *((np.log10(w + ADD), w > 0) if new else ()))))

    def of_dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [float(logs.value[unpacked(x.as_py(), "<u4")].sum()) for x in batch.column(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sums, pa.float64())], ["row", "doc_id", "n_tokens", "n_known", "base", "score"])

    frequent_sums = map_arrow(frequent.select("pairs", "hw", "times", "rows"), of_frequent, _SUMS)
    sums = frequent_sums.unionByName(map_arrow(rare.select("h", "w", "hw", "times", "rows", "known"), of_rare, _SUMS)).groupBy("block").applyInArrow(added_sums, "row long, more double, more_base double, more_known long")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_arrow(texts, of_dense, f"row long, doc_id {kind}, n_tokens long, n_known long, base double, score double")
    held = (F.col("row").bitwiseAND(3) == HELD_OUT).alias("held_out")
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.join(sums, "row", "left").select("doc_id", held, "n_tokens", (F.col("n_known") + more("more_known")).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"), (F.col("base") + more("more_base")).alias("base_score"), (F.col("score") + more("more")).alias("score"))
