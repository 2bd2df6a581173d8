"""The vectors closest to others by cosine, in blocks of products instead of a row for each pair.

Vectors of the usual length with a norm that can't vanish or overflow are packed in blocks. A task
pairs some blocks of queries with a part of the others, as Spark's product of two tables does, which
stores no pair: a product of matrices in single precision, with a bound on its error, finds what can be
among a query's best, and only that is summed up as the plan's SQL does, component by component in
double precision. What is found are all rows that can be among the k best by rounded score and id; the
rank itself is Spark's. Vectors without a norm (null, with nulls, of zeros) have the score 0 with
all others, by smallest id; for vectors that aren't finite or of another length the pairs are made one
by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dialect import Spark

#: Vectors in a block of queries and of others, blocks that a task takes one after another, bytes of a part, sums at a time.
QUERIES, OTHERS, BLOCKS, PART_BYTES, SUMS = 1024, 2048, 32, 64 << 20, 1 << 18
#: Scores this much below the k-th best can still have its rounded score, at 9 digits.
BAND = 2e-9


def _dot(a: str, b: str) -> str:
    return Spark().fold(f"zip_with({a}, {b}, (x, y) -> struct(x AS x, y AS y))", "CAST(v.x AS DOUBLE) * v.y")


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, one component after another."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


class _Best:
    """What can be among the k best of each query of a block."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.norm, self.least = np.sqrt(_sums(q, q)), np.full(len(ids), -np.inf)
        self.unit = (q / self.norm[:, None]).astype(np.float32)
        self.found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.waiting = 0

    def add(self, ids: np.ndarray, c: np.ndarray) -> None:
        norm = np.sqrt(_sums(c, c))
        near = self.unit @ (c / norm[:, None]).astype(np.float32).T
        error = (c.shape[1] + 8) * 1.2e-7
        least = self.least - error
        fresh = np.flatnonzero(self.least == -np.inf)
        if len(fresh) and len(ids) > self.k:
            own = np.where(ids == self.ids[fresh, None], -np.inf, near[fresh])
            least[fresh] = np.partition(own, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - 2 * error - BAND
        i, j = np.divmod(np.flatnonzero(near >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]), len(ids))
        for at in range(0, len(i), SUMS):
            x, y = i[at : at + SUMS], j[at : at + SUMS]
            s = _sums(self.q[x], c[y]) / (self.norm[x] * norm[y])
            good = (ids[y] != self.ids[x]) & (s >= self.least[x])
            self.found.append((x[good], ids[y[good]], s[good]))
            self.waiting += int(good.sum())
            if self.waiting > SUMS:
                self.cut()
        if len(fresh):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        """Of rows with the same score only k smallest ids can be wanted, and no score much below the k-th."""
        slot, vec_id, s = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((vec_id, -s, slot))
        slot, vec_id, s = slot[order], vec_id[order], s[order]
        new = np.flatnonzero(np.r_[True, (np.diff(slot) != 0) | (np.diff(s) != 0)][: len(slot)])
        few = np.arange(len(slot)) - np.repeat(new, np.diff(np.r_[new, len(slot)])) < self.k
        slot, vec_id, s = slot[few], vec_id[few], s[few]
        first = np.searchsorted(slot, np.arange(len(self.ids)))
        full = np.flatnonzero(np.bincount(slot, minlength=len(self.ids)) >= self.k)
        self.least[full] = s[first[full] + self.k - 1] - BAND
        keep = s >= self.least[slot]
        self.found, self.waiting = [(slot[keep], vec_id[keep], s[keep])], 0
        return self.found[0]


def _pack(width: int, kind: str, key: str) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        m = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)
        return pa.table({key: t[key].slice(0, 1), "ids": pa.array([t["vec_id"].to_numpy().astype("<i8").tobytes()], pa.binary()), "m": pa.array([m.tobytes()], pa.binary())})

    return run


def _among_usual(rows: DataFrame, width: int, kind: str, n: int, k: int, every: int) -> DataFrame:
    """Rows (qid, vec_id, s) of vectors of one width with norms, all that can be among the k best."""

    def blocks(x: DataFrame, count: int, name: str) -> DataFrame:
        return x.select(F.pmod(F.xxhash64("vec_id", "x"), F.lit(count)).alias(name), "vec_id", "x").groupBy(name).applyInArrow(_pack(width, kind, name), f"{name} long, ids binary, m binary")

    asking = rows.filter(F.col("vec_id") % every == 0)
    n_blocks, n_others = max(1, -(-asking.count() // QUERIES)), max(1, -(-n // OTHERS))
    tasks = 3 * rows.sparkSession.sparkContext.defaultParallelism
    left = max(-(-n_blocks // BLOCKS), min(n_blocks, tasks // 3))
    right = max(-(-n * (width * np.dtype(kind).itemsize + 8) // PART_BYTES), min(n_others, -(-tasks // left)))
    q = blocks(asking, n_blocks, "block").select("block", F.col("ids").alias("q_ids"), F.col("m").alias("q_m")).repartition(left)
    c = blocks(rows, n_others, "part").select("ids", "m").repartition(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(ids, m):
            a = np.frombuffer(ids.as_buffer(), "<i8")
            return a, np.frombuffer(m.as_buffer(), kind).reshape(len(a), width).astype(float)

        def done():
            slot, vec_id, s = best.cut()
            return pa.RecordBatch.from_arrays([pa.array(best.ids[slot]), pa.array(vec_id), pa.array(s)], ["qid", "vec_id", "s"])

        block, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = [x[i] for x in batch.columns]
                if best is None or row[0].as_py() != block:
                    if best is not None:
                        yield done()
                    block, best = row[0].as_py(), _Best(*read(row[1], row[2]), k)
                best.add(*read(row[3], row[4]))
        if best is not None:
            yield done()

    return q.crossJoin(c.hint("shuffle_replicate_nl")).mapInArrow(run, "qid long, vec_id long, s double")


def _firsts(rows: DataFrame, k: int) -> DataFrame:
    """The rows of the smallest ids, so many that any one id can be left out, as ids."""
    few = rows.groupBy("vec_id").count().orderBy("vec_id").limit(k + 1)
    return few.select("vec_id", F.explode(F.sequence(F.lit(1), F.least("count", F.lit(k)))).alias("nth")).drop("nth")


def closest(vectors: DataFrame, k: int = 8, every: int = 10) -> DataFrame:
    """Rows (qid, vec_id, cosine, rnk): for each row (vec_id, embedding) whose id ``every`` divides, its k closest."""
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    rows = vectors.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long"), F.col("embedding").alias("x")).withColumn("norm", F.expr(f"sqrt({_dot('x', 'x')})"))
    sure = "norm BETWEEN 1e-150D AND 1e150D"
    counted = rows.groupBy(F.when(F.expr(sure), F.size("x")).alias("width"), F.expr("coalesce(norm, 0D) = 0D").alias("empty")).count().collect()  # as many as there are lengths
    lengths = {r["width"]: r["count"] for r in counted if r["width"] is not None}
    width = max(lengths, key=lambda w: (lengths[w], w), default=0)
    n_usual, n_empty = lengths.get(width, 0), sum(r["count"] for r in counted if r["empty"])
    n_odd = sum(r["count"] for r in counted) - n_usual - n_empty
    rows = rows.withColumn("kind", F.expr(f"CASE WHEN coalesce(norm, 0D) = 0D THEN 'empty' WHEN {sure} AND size(x) = {width} THEN 'usual' ELSE 'odd' END"))
    usual, empty = rows.filter("kind = 'usual'"), rows.filter("kind = 'empty'")
    out = rows.filter("false").select(F.col("vec_id").alias("qid"), "vec_id", F.lit(0.0).alias("s"))
    if n_usual:
        out = out.unionByName(_among_usual(usual, width, kind, n_usual, k, every))
    if n_empty:
        for asking, others in ((usual, empty), (empty, rows.filter("kind <> 'odd'"))):
            ids = asking.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("qid"))
            out = out.unionByName(ids.join(F.broadcast(_firsts(others, k)), F.col("qid") != F.col("vec_id")).select("qid", "vec_id", F.lit(0.0).alias("s")))
    if n_odd:
        a, b = rows.filter(F.col("vec_id") % every == 0).alias("a"), rows.alias("b")
        pairs = a.join(b, F.expr("a.vec_id <> b.vec_id AND (a.kind = 'odd' OR b.kind = 'odd')"))
        out = out.unionByName(pairs.select(F.col("a.vec_id").alias("qid"), F.col("b.vec_id").alias("vec_id"), F.expr(f"CASE WHEN a.norm * b.norm > 0 THEN {_dot('a.x', 'b.x')} / (a.norm * b.norm) ELSE 0 END").alias("s")))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("s", 9).desc(), "vec_id"))
    return out.withColumn("rnk", rank).filter(F.col("rnk") <= k).select("qid", "vec_id", F.round("s", 6).alias("cosine"), "rnk")
