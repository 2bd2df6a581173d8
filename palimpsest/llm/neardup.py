"""Near-duplicate documents by MinHash bands, odd sketches and exact verification.

A document is the set of its distinct shingles of ``width`` words. Documents with the same set are
one node from the start. MinHash samples of a node make BANDS band keys, under which similar nodes
meet, and an odd sketch: a bitmap in which every sample flips one bit. The bits in which two
sketches differ estimate the similarity of their nodes, precisely where it is high; pairs that are
clearly too different go no further, and all others are verified on their full sets. Pairs of exactly
the wanted similarity miss all bands, or have sketches beyond the margin, with a probability of about
3e-6.

Under keys of few nodes all pairs are candidates. Under the others nodes meet a few hubs of their key
first, and round by round those outside the key's largest component meet a few more members of it,
which joins most of a large group. Nodes that are still outside are few; they meet all nodes of the
keys around the same largest component in blocks of bounded size, each of which a task compares by
sketches and sets and which gives only links, one for each pair of components that it joins. No key is
left out or cut short. Components are found by passing on the smallest label, with doubling, on links
between components only.

Hashes of sets have 64 bits: among a billion different sets, two share one with a probability of 3 %.

Defined results: documents without words or text have no shingles, are linked with nothing and are
their own component. Repeated rows are linked like other copies. Documents without an id are linked
like all others, and take the smallest known id of their component, null if there is none. Very long
texts are read whole; tasks are bounded by shingles, not by documents, and by the longest single pair.
An empty table gives no rows. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, ship, small

SAMPLES, BANDS, SKETCH_BITS = 256, 32, 1024
#: Samples in a band's key; the bands take the first BANDS * ROWS samples.
ROWS = 4
#: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Estimated similarities down to this much below the wanted one are verified: beyond it 3 of 1,000,000 simulated pairs fall.
MARGIN = 0.13
#: Nodes and shingles on one side of a block, about; shingles of a block that are compared at a time.
BLOCK_NODES, BLOCK_SHINGLES, COLUMNS = 512, 1 << 18, 4096
#: Keys with up to FEW nodes have all their pairs verified; hubs for the others, by round.
FEW, HUBS, HUB_ROUNDS = 12, 2, 6
#: Up to so many keys of documents go to the texts; with more, the texts go to the keys in a shuffle.
KEYS = 1_000_000

_A = np.random.default_rng(11).integers(0, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(12).integers(0, 1 << 63, SAMPLES, np.uint64)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of the whole sequence if it is shorter than one."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    x = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        x = _mixed(x * _C1 + h[i : len(h) - width + 1 + i])
    return np.unique(x)


def node_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, and the odd sketch as signed 64-bit integers."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, (s[i : i + 4096, None] * _A + _B).min(0))
    rows = ROWS
    key = np.arange(BANDS, dtype=np.uint64) * _C1
    for i in range(rows):
        key = _mixed(key ^ low[i : rows * BANDS : rows])
    bits = _mixed(low + np.arange(SAMPLES, dtype=np.uint64) * _C3) % np.uint64(SKETCH_BITS)
    odd = (np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return key.view(np.int64), np.packbits(odd).view(np.int64)


def most_different(percent: int = PERCENT, margin: float = MARGIN) -> int:
    """Differing sketch bits that are expected at the least similarity which is verified."""
    return int(np.ceil(SKETCH_BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - percent / 100 + margin) / SKETCH_BITS))))


def digest(docs: DataFrame):
    """Tells documents apart that share an id or have none."""
    return F.xxhash64(docs["text"]).alias("digest")


def features(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, digest, n, node, bands, sketch); nulls after n = 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, node, bands, sketch = [], [], [], []
                for text in part.column(2).cast(pa.binary()):
                    s = shingles(text.as_py(), width)
                    n.append(len(s))
                    key, odd = signature(s) if len(s) else (None, None)
                    node.append(node_of(s) if len(s) else None)
                    bands.append(key)
                    sketch.append(odd)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "digest", "n", "node", "bands", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", digest(docs), "text"), run, f"doc_id {kind}, digest long, n long, node long, bands array<long>, sketch array<long>")


def packed_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (node, packed): compressed texts of the nodes, from the documents that stand for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [zlib.compress(x.as_py(), 1) for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["node", "packed"])

    stand = nodes.select("node", F.col("stands.doc_id").alias("__id"), F.col("stands.digest").alias("__digest"))
    some = docs.select("doc_id", "text", digest(docs)).join(small(stand, KEYS), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")))
    # repeated rows, and copies without an id, stand for a node together
    return map_arrow(some.select("node", "text"), run, "node long, packed binary").groupBy("node").agg(F.first("packed").alias("packed"))


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for i in range(batch.num_rows):
                if last[0] != b[i]:
                    last = b[i], shingles(zlib.decompress(batch.column(3)[i].as_py()), width)
                x, y = shingles(zlib.decompress(batch.column(2)[i].as_py()), width), last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], ["a", "b"])

    x, y = texts.select(F.col("node").alias("a"), F.col("packed").alias("pa")), texts.select(F.col("node").alias("b"), F.col("packed").alias("pb"))
    return map_arrow(pairs.join(x, "a").join(y, "b").select("a", "b", "pa", "pb"), run, "a long, b long")


def common_sizes(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of x with each one of y."""
    out = np.zeros((len(x), len(y)), np.int64)
    a, b = (np.unique(np.concatenate(side), return_inverse=True) for side in (x, y))
    both, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    places = []
    for (values, inverse), at, side in ((a, at_a, x), (b, at_b, y)):
        column = np.full(len(values), -1, np.int64)
        column[at] = np.arange(len(both))
        column, row = column[inverse], np.repeat(np.arange(len(side)), [len(s) for s in side])
        order = np.argsort(column, kind="stable")
        places.append((row[order], column[order]))
    for first in range(0, len(both), COLUMNS):
        part = []
        for (row, column), n in zip(places, (len(x), len(y)), strict=True):
            i, j = np.searchsorted(column, (first, first + COLUMNS))
            m = np.zeros((n, COLUMNS), np.float32)
            m[row[i:j], column[i:j] - first] = 1
            part.append(m)
        out += (part[0] @ part[1].T).astype(np.int64)
    return out


def block_links(group: pa.Table, width: int, percent: int) -> list[tuple[int, int]]:
    """Links of a block's outside nodes (side 0) with its other side's ones, one for each pair of components that they join."""
    rows = group.select(["node", "comp", "n", "side"]).to_pydict()
    sketch = np.array(group["sketch"].to_pylist(), np.int64).reshape(-1, SKETCH_BITS // 64).view(np.uint64)
    side, n, comp = np.array(rows["side"]), np.array(rows["n"], np.int64), np.array(rows["comp"], np.int64)
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alike = (100 * np.minimum.outer(n[x], n[y]) >= percent * np.maximum.outer(n[x], n[y])) & (comp[x][:, None] != comp[y])
    for i in range(0, len(x), 64):
        differ = np.bitwise_count(sketch[x[i : i + 64], None] ^ sketch[y]).sum(2)
        alike[i : i + 64] &= differ <= most_different(percent)
    x, y = x[alike.any(1)], y[alike.any(0)]
    alike = alike[alike.any(1)][:, alike.any(0)]
    if not alike.size:
        return []
    sets = {i: shingles(zlib.decompress(group["packed"][i].as_py()), width) for i in {*x.tolist(), *y.tolist()}}
    both = common_sizes([sets[i] for i in x.tolist()], [sets[i] for i in y.tolist()])
    a, b = np.nonzero(alike & (100 * both >= percent * (n[x][:, None] + n[y] - both)))
    up: dict[int, int] = {}

    def top(c: int) -> int:
        while up.get(c, c) != c:
            c = up[c]
        return c

    out = []
    for i, j in zip(x[a].tolist(), y[b].tolist(), strict=True):
        p, q = top(int(comp[i])), top(int(comp[j]))
        if p != q:
            up[p] = q
            out.append((rows["node"][i], rows["node"][j]))
    return out


def outside_links(rest: DataFrame, ends: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that nodes outside the largest component of one of their keys have with other components' nodes around it.

    rest has rows (node, comp, top), top being the largest component of a key that has the node.
    """
    around = materialize(rest.select("node", "comp", "top").distinct().join(ends.select("node", "n", "sketch"), "node"), "around")
    is_out = F.col("comp") != F.col("top")
    parts = lambda cond: F.ceil(F.greatest(F.sum(F.when(cond, 1).otherwise(0)) / BLOCK_NODES, F.sum(F.when(cond, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    sizes = around.groupBy("top").agg(parts(is_out).alias("xs"), parts(F.lit(True)).alias("ys"))
    place = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = around.join(small(sizes), "top")
    keep = ["top", "node", "comp", "n", "sketch"]
    x = own.filter(is_out).select(*keep, place(1, "xs").alias("bx"), every("ys").alias("by"), F.lit(0).alias("side"))
    y = own.select(*keep, every("xs").alias("bx"), place(2, "ys").alias("by"), F.lit(1).alias("side"))

    def run(group: pa.Table) -> pa.Table:
        links = block_links(group, width, percent)
        return pa.table({"a": pa.array([p for p, _ in links], pa.int64()), "b": pa.array([q for _, q in links], pa.int64())})

    ship(rest.sparkSession)
    return x.unionByName(y).join(texts, "node").groupBy("top", "bx", "by").applyInArrow(run, "a long, b long")


def smallest_labels(links: DataFrame) -> DataFrame:
    """Rows (old, new) for the ends of links (a, b): the smallest end that each is connected with."""
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = edges.select(F.col("a").alias("old")).distinct().withColumn("new", F.col("old"))
    while True:
        near = edges.join(labels.select(F.col("old").alias("b"), F.col("new").alias("seen")), "b").groupBy("a").agg(F.min("seen").alias("seen"))
        step = labels.join(near, labels["old"] == near["a"]).select("old", F.col("new").alias("was"), F.least("new", "seen").alias("new"))
        on = step.select(F.col("old").alias("to"), F.col("new").alias("far"))  # doubling: the label's own label
        step = materialize(step.join(on, F.col("new") == F.col("to"), "left").select("old", "was", F.least("new", "far").alias("new")), "labels")
        labels = step.select("old", "new")
        if step.filter("new <> was").isEmpty():
            return labels


def _alike(a: str, b: str, percent: int):
    """Sizes that allow the similarity, and sketches that don't speak against it."""
    differ = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return (F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent) & (differ <= most_different(percent))


def joined(docs: DataFrame, width: int = 2, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest, n, node) of all documents, and (node, component_id, stands): the least id of a node's component and the document that stands for it."""
    found = materialize(features(docs, width), "features")
    stands = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("stands")
    nodes = materialize(found.filter("n > 0").groupBy("node").agg(stands, F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    keys = nodes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    met = materialize(nodes.select("node", F.explode("bands").alias("key")).join(keys, "key"), "met")  # key, node, m
    ends = materialize(nodes.select("node", "stands", "n", "sketch").join(met.select("node").distinct(), "node", "left_semi"), "ends")
    texts = materialize(packed_texts(docs, ends), "texts", "none")
    labels = ends.select("node", F.col("node").alias("comp"))

    def join_by(links: DataFrame) -> None:
        """Joins the components of the ends of links."""
        nonlocal labels
        links = materialize(links, "links")
        by = links.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        by = materialize(by, "joined")
        if by.isEmpty():
            return
        moved = smallest_labels(by)
        labels = materialize(labels.join(moved, labels["comp"] == moved["old"], "left").select("node", F.coalesce("new", "comp").alias("comp")), "components")

    def linked(pairs: DataFrame) -> None:
        """Verifies candidate pairs and joins components by them."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
        pairs = pairs.join(ends.alias("x"), F.col("a") == F.col("x.node")).join(ends.alias("y"), F.col("b") == F.col("y.node")).filter(_alike("x", "y", percent)).select("a", "b")
        join_by(verified(pairs, texts, width, percent))

    few = met.filter(f"m <= {FEW}").select("key", "node")
    pairs = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").filter("a < b").select("a", "b")
    many = met.filter(f"m > {FEW}").select("key", "node")
    seeded = lambda turn: [F.min(F.struct(F.xxhash64("node", F.lit(turn * HUBS + i)), F.col("node"))).alias(f"h{i}") for i in range(HUBS)]
    hubs = many.groupBy("key").agg(*seeded(0)).select("key", F.array(*(F.col(f"h{i}.node") for i in range(HUBS))).alias("hubs"))
    linked(pairs.union(many.join(hubs, "key").select(F.col("node").alias("a"), F.explode("hubs").alias("b"))))
    outside = None
    for turn in range(1, HUB_ROUNDS + 1):
        left = materialize(many.join(labels, "node"), "left")
        sizes = left.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"), *seeded(turn))
        top = F.max(F.struct("k", "comp", *(f"h{i}" for i in range(HUBS)))).alias("top")
        apart = sizes.groupBy("key").agg(top, F.count(F.lit(1)).alias("comps")).filter("comps > 1").select("key", F.col("top.comp").alias("top"), F.array(*(F.col(f"top.h{i}.node") for i in range(HUBS))).alias("hubs"))
        rest = materialize(left.join(apart, "key"), "rest")
        now = rest.filter("comp <> top").count()
        if now == 0 or turn == HUB_ROUNDS or (outside is not None and now > 0.9 * outside):
            break
        outside = now
        linked(rest.filter("comp <> top").select(F.col("node").alias("a"), F.explode("hubs").alias("b")))
        many = rest.select("key", "node")  # a key whose nodes are one component stays so
    if now:
        join_by(outside_links(rest, ends, texts, width, percent))
    least = labels.join(ends.select("node", "stands"), "node").groupBy("comp").agg(F.min("stands").alias("all"))
    of = labels.join(least, "comp").select("node", F.col("all").alias("wide"))
    of = nodes.select("node", "stands").join(of, "node", "left").select("node", F.coalesce("wide", "stands").alias("stands"))
    return found.select("doc_id", "digest", "n", "node"), materialize(of.select("node", F.col("stands.doc_id").alias("component_id"), "stands"), "of")


def components(docs: DataFrame, width: int = 2, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    found, of = joined(docs, width, percent)
    out = found.join(of, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component: the one with the smallest id; without any id, the one with the smallest digest.

    Documents without words stay. Of rows that share an id and a text one stays.
    """
    found, of = joined(docs, width, percent)
    rows = found.join(of, "node", "left")
    stays = F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("stands.doc_id")) & (F.col("digest") == F.col("stands.digest")))
    gone = materialize(rows.filter(~stays).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct(), "gone")
    again = materialize(rows.filter(stays & F.col("node").isNotNull()).groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).count().filter("count > 1").drop("count"), "again")
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (digest(docs) == F.col("__digest"))
    left = docs.join(small(gone, KEYS), same, "left_anti")
    if again.isEmpty():
        return left
    again = small(again, KEYS)
    once = docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, same, "left_anti").unionByName(once)
