"""Near-duplicates against brute force over all pairs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import neardup


def sets_of(texts, width):
    return [frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if (w := (t or "").lower().split()) else frozenset() for t in texts]


def brute(rows, width):
    """(doc_id, shingles, component) by row."""
    sets = sets_of([t for _, t in rows], width)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)), find(i)) for i, (d, _) in enumerate(rows)]


def made(width, n=120):
    r = random.Random(width)
    rows, start = [], ["w%d" % r.randrange(500) for _ in range(120)]
    for i in range(n):
        w = list(start) if i % 3 else ["v%d" % r.randrange(300) for _ in range(60)]
        for _ in range(r.randrange(12 if width == 2 else 5)):
            w[r.randrange(len(w))] = "e%d" % r.randrange(10**6)
        rows.append((i, " ".join(w)))
    other = ["n%d" % i for i in range(100)]
    rows += [(500, " ".join(other)), (None, " ".join([*other[:-1], "last"])), (None, " ".join([*other[:-5], *["z%d" % i for i in range(5)]])), (None, " ".join(["q%d" % i for i in range(40)])), (None, " ".join(["q%d" % i for i in range(40)]))]
    return rows + [(200, None), (201, " "), (202, "a"), (203, "A"), (204, "a b"), (None, rows[1][1]), (1, rows[1][1]), (1, "another text of the same id")]


@pytest.mark.parametrize("width", [2, 5])
def test_components(spark, width):
    rows = made(width)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, digest int")
    got = Counter(tuple(r) for r in neardup.components(docs, width).collect())
    assert got == Counter((d, n, c, d == c) for d, n, c, _ in brute(rows, width))


def test_outside_blocks_join_what_hubs_leave(spark, monkeypatch):
    """One chain of near copies in which few pairs are links, without rounds of hubs and with tiny blocks."""
    monkeypatch.setattr(neardup, "HUB_ROUNDS", 1)
    monkeypatch.setattr(neardup, "BLOCK_NODES", 7)
    monkeypatch.setattr(neardup, "COLUMNS", 16)
    r = random.Random(1)
    rows, w = [], ["w%d" % i for i in range(150)]
    for i in range(90):
        w = list(w)
        for _ in range(r.choice((3, 7, 9))):
            w[r.randrange(len(w))] = "e%d" % r.randrange(10**6)
        rows.append((i, " ".join(w)))
    got = Counter(tuple(x) for x in neardup.components(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert got == Counter((d, n, c, d == c) for d, n, c, _ in brute(rows, 2))


def test_rounds_leave_out_keys_that_are_whole(spark, monkeypatch):
    """Keys and labels are joined once a round, and only for keys that still have several components."""
    monkeypatch.setattr(neardup, "FEW", 2)
    sizes, write = [], neardup.materialize

    def counted(df, name, *codec):
        out = write(df, name, *codec)
        if name == "left":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(neardup, "materialize", counted)
    r = random.Random(1)
    rows, w = [(1000 + i, "copy of one and the same long text with many words in it and then number%d" % i) for i in range(30)], ["w%d" % i for i in range(150)]
    for i in range(60):
        w = list(w)
        for _ in range(r.choice((3, 7, 9))):
            w[r.randrange(len(w))] = "e%d" % r.randrange(10**6)
        rows.append((i, " ".join(w)))
    got = Counter(tuple(x) for x in neardup.components(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert got == Counter((d, n, c, d == c) for d, n, c, _ in brute(rows, 2))
    assert len(sizes) > 1 and sizes[1] < sizes[0] and sizes == sorted(sizes, reverse=True)


def test_block_links_equal_pairs():
    r = random.Random(4)
    texts = [" ".join("w%d" % r.randrange(14) for _ in range(r.randrange(4, 30))) for _ in range(60)]
    sets = [neardup.shingles(t.encode(), 2) for t in texts]
    both = neardup.common_sizes(sets[:20], sets[20:])
    assert (both == np.array([[len(np.intersect1d(a, b)) for b in sets[20:]] for a in sets[:20]])).all()
    empty = pa.table({"node": pa.array([], pa.int64()), "comp": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "side": pa.array([], pa.int32()), "sketch": pa.array([], pa.list_(pa.int64())), "packed": pa.array([], pa.binary())})
    assert neardup.block_links(empty, 2, 80) == []


def test_keep_one(spark):
    rows = made(5)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, digest int")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    best = {}
    for (d, t), (_, n, _, top) in zip(rows, brute(rows, 5), strict=True):
        if n and (top not in best or (d is None, d or 0) < (best[top][0] is None, best[top][0] or 0)):
            best[top] = (d, t)
    with_id = {x for x in best.values() if x[0] is not None}
    assert {x for x in got if x[0] is not None and x[1] and x[1].strip()} == with_id
    assert sum(n for x, n in got.items() if x[1] and x[1].strip()) == len(best)
    assert got[200, None] == 1 and got[201, " "] == 1


@pytest.mark.parametrize("keys", [1_000_000, 3])
def test_keep_one_moves_texts_only_for_many_keys(spark, monkeypatch, keys):
    """Few keys are broadcast whatever Spark's threshold; with more the texts are shuffled, for the same rows."""
    monkeypatch.setattr(neardup, "KEYS", keys)
    rows = [x for x in made(5) if x[0] is not None and x[0] != 1]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
        assert ("Exchange hashpartitioning" in kept._jdf.queryExecution().executedPlan().toString()) == (keys == 3)
        got = sorted(r["doc_id"] for r in kept.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == sorted(d for d, n, c, _ in brute(rows, 5) if not n or d == c) and len(got) < len(rows) - 3


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.components(none).count() == 0 and neardup.keep_one(none).count() == 0
