"""Document quality by random-indexing word vectors and a small neural network.

Every feature word has a sparse random index vector, which its name fixes. A word's vector is the
sum of the index vectors of the words that stand next to it in the fitting sample, scaled down by
how common they are. A document is pooled as the mean of its words' vectors, over the words
themselves, over their shapes (case, last characters that aren't letters, length) and over a few
words that tell how repetitive it is. A network of two layers in numpy turns the pooled vector into
a score; a temperature, fitted on a part of the sample that the network hasn't seen, calibrates it.

The network and the word vectors are fitted on at most SAMPLE_DOCS labelled documents: of those
that are used for learning, the ones whose ids' hashes come first. Scores depend on the text alone.

Defined results: null and empty texts are scored as documents without words. Labels that are null
are not used; of repeated labels of a document the highest counts. Without labels of both kinds the
score is the share of label 1, or 0.5 without labels. Documents without an id count as held out.
"""

from __future__ import annotations

import operator
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

SAMPLE_DOCS, FOLDS, THRESHOLD = 2000, 5, 0.3
WIDTH, NONZERO, HIDDEN, MOST_WORDS = 96, 6, 32, 20_000

_ORD_A, _ORD_Z, _ORD_a, _ORD_z = 65, 90, 97, 122


def shape(word: bytes) -> bytes:
    """Upper-case, capitalised or other, what follows the last letter, and a class of length."""
    core = word.rstrip(b".,;:!?%$&*#|/\\-_=+~^\"'()[]{}<>0123456789")
    tail = word[len(core) :][-3:]
    if not core:
        kind = b"-"
    elif _ORD_A <= core[0] <= _ORD_Z:
        kind = b"A" if len(core) > 1 and _ORD_A <= core[-1] <= _ORD_Z else b"Aa"
    else:
        kind = b"a"
    return b"\0" + kind + b"%d" % min(len(word) // 4, 6) + tail


def _bucket(x: float, name: bytes) -> bytes:
    return b"\1" + name + b"%d" % int(x * 10)


class Shapes(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 300_000:
            self.clear()
        got = self[word] = shape(word)
        return got


def features(text: bytes, shapes: Shapes) -> tuple[Counter, Counter, list[bytes]]:
    """Counts of words, counts of shapes, and the words that tell of repetition."""
    words = text.split()
    counts = Counter(words)
    shaped: Counter = Counter()
    for w, n in counts.items():
        shaped[shapes[w]] += n
    n = max(len(words), 1)
    again = [sum(map(operator.eq, words, islice(words, k, None))) / n for k in (1, 2, 3)]
    lines = text.split(b"\n")
    rest = [_bucket(len(counts) / n, b"distinct"), _bucket(max(again), b"again"), _bucket(len(set(lines)) / len(lines), b"lines"), b"\1size%d" % len(words).bit_length(), _bucket(counts.most_common(1)[0][1] / n if words else 0, b"top")]
    return counts, shaped, rest


def index_vector(word: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs, fixed by the word."""
    r = np.random.default_rng(zlib.crc32(word))
    return r.choice(WIDTH, NONZERO, replace=False), r.choice((-1.0, 1.0), NONZERO)


class Model:
    def __init__(self, places: dict[bytes, int], vectors: np.ndarray, layers: tuple | None, temperature: float, prior: float):
        self.places, self.vectors, self.layers, self.temperature, self.prior = places, vectors, layers, temperature, prior

    def pooled(self, text: bytes, shapes: Shapes) -> np.ndarray:
        out = np.zeros(3 * WIDTH, np.float32)
        for i, group in enumerate(features(text, shapes)):
            if isinstance(group, list):
                group = dict.fromkeys(group, 1)
            known = [(k, n) for w, n in group.items() if (k := self.places.get(w)) is not None]
            if known:
                at, n = np.array(known).T
                out[i * WIDTH : (i + 1) * WIDTH] = n.astype(np.float32) @ self.vectors[at] / n.sum()
        return out

    def scores(self, texts: list[bytes], shapes: Shapes) -> np.ndarray:
        if self.layers is None or not texts:
            return np.full(len(texts), self.prior)
        x = np.stack([self.pooled(t, shapes) for t in texts])
        return 1 / (1 + np.exp(-np.clip(_forward(self.layers, x)[1] / self.temperature, -50, 50)))


def _forward(layers: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, scale, a, b, c, d = layers
    hidden = np.tanh((x - mean) / scale @ a + b)
    return hidden, hidden @ c + d


def _network(x: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple:
    """Two layers by Adam on the cross-entropy, the rarer label weighted up by half."""
    r = np.random.default_rng(5)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) ** 0.5
    weight /= weight.sum()
    p = [r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for t in range(1, steps + 1):
        hidden = np.tanh(z @ p[0] + p[1])
        g = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -50, 50))) - y) * weight
        back = np.outer(g, p[2]) * (1 - hidden**2)
        grads = [z.T @ back + 2e-3 * p[0], back.sum(0), hidden.T @ g + 2e-3 * p[2], g.sum()]
        for i, q in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * q, 0.999 * v[i] + 0.001 * q * q
            p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return mean, scale, *p


def _word_vectors(docs: list[tuple[Counter, Counter, list[bytes]]], texts: list[bytes], shapes: Shapes) -> tuple[dict[bytes, int], np.ndarray]:
    total: Counter = Counter()
    for counts, shaped, rest in docs:
        total.update(counts)
        total.update(shaped)
        total.update(rest)
    words = [w for w, n in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:MOST_WORDS] if n >= 3]
    places = {w: i for i, w in enumerate(words)}
    index, vectors = np.zeros((len(words), WIDTH), np.float32), np.zeros((len(words), WIDTH), np.float32)
    for i, w in enumerate(words):
        at, sign = index_vector(w)
        index[i, at] = sign
    scaled = index / np.sqrt(np.array([max(total[w], 1) for w in words], np.float32))[:, None]
    n = len(words)

    def neighbours(text: bytes, rest: list[bytes]) -> Iterator[np.ndarray]:
        own = text.split()
        for stream in ([places.get(w, -1) for w in own], [places.get(shapes[w], -1) for w in own]):
            ids = np.array(stream, np.int64)
            for k in (1, 2):
                both = (ids[k:] >= 0) & (ids[:-k] >= 0)
                yield ids[k:][both] * n + ids[:-k][both]
                yield ids[:-k][both] * n + ids[k:][both]
        ids = np.array([places[w] for w in rest if w in places], np.int64)
        yield (ids[:, None] * n + ids).ravel()

    for i in range(0, len(texts), 50):  # few documents at a time: the driver's memory stays small
        near = [x for text, (_, _, rest) in zip(texts[i : i + 50], docs[i : i + 50], strict=True) for x in neighbours(text, rest)]
        pairs, met = np.unique(np.concatenate(near), return_counts=True)
        for at in range(0, len(pairs), 20_000):
            a, b = pairs[at : at + 20_000] // n, pairs[at : at + 20_000] % n
            first = np.flatnonzero(np.diff(a, prepend=-1))
            vectors[a[first]] += np.add.reduceat(scaled[b] * met[at : at + 20_000, None].astype(np.float32), first) if len(a) else 0
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return places, vectors / np.maximum(norm, 1e-6) + 0.5 * index


def fit_texts(texts: list[bytes], labels: list[int]) -> Model:
    y, shapes = np.array(labels, float), Shapes()
    prior = float(y.mean()) if len(y) else 0.5
    if len(set(labels)) < 2:
        return Model({}, np.zeros((0, WIDTH), np.float32), None, 1.0, prior)
    places, vectors = _word_vectors([features(t, shapes) for t in texts], texts, shapes)
    model = Model(places, vectors, None, 1.0, prior)
    x = np.stack([model.pooled(t, shapes) for t in texts])
    rest = np.arange(len(y)) % 5 == 4  # for the temperature
    if len(set(y[~rest])) < 2:
        rest[:] = False
    model.layers = _network(x[~rest], y[~rest])
    if rest.any():
        z = _forward(model.layers, x[rest])[1]
        heats = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, -np.where(y[rest] == 1, z, -z) / t)) for t in heats]
        model.temperature = float(heats[int(np.argmin(loss))])
    return model


def held_out(folds: int = FOLDS):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, folds: int = FOLDS) -> Model:
    """From at most sample_docs labelled documents outside the held-out fold."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(folds)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = {r[0]: int(r[1]) for r in known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()}
    if not some:
        return fit_texts([], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In one task, so that neither the texts nor the fitting take the driver's memory."""
        rows = sorted({(d, (t or "").encode()) for b in batches for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}, key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
        model = fit_texts([t for _, t in rows], [some[d] for d, _ in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    rows = docs.filter(F.col("doc_id").isin(list(some))).select("doc_id", "text").repartition(1)
    return pickle.loads(map_arrow(rows, run, "model binary").collect()[0][0])


def _free(docs: DataFrame) -> str:
    """A name that no column of docs has."""
    name = "__score"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a last column: the score."""
    name = _free(docs)
    at, sent = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, own = Shapes(), sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                got = own.scores([x or b"" for x in part.column(at).cast(pa.binary()).to_pylist()], shapes)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got.astype(float), pa.float64())], [*part.schema.names, name])

    from pyspark.sql.types import DoubleType, StructType

    return map_arrow(docs, run, StructType([*docs.schema.fields]).add(name, DoubleType()))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, folds: int = FOLDS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = _scored(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(folds).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with their columns as they are."""
    name = _free(docs)
    return _scored(docs, model).filter(F.col(name) >= threshold).drop(name)
