"""Exact top-k search by inner product, without random access to scores (sequential reads of sorted lists).

Vectors are quantised to floor(256 * x). Rows are packed into blocks of bounded size where they lie; the stated queries
are packed likewise and dealt to every block by an equi-join of blocks. In a block each dimension is a list sorted by
value; a query reads all its lists in step, from the end that its sign prefers, the next STEPS-th part at a time. What has
been read of a vector gives a lower bound of its score (lists in which it was not met count with their least value) and an
upper bound (with the list's current value). After each part a query stops if no vector that it has not met can reach the
k-th lower bound and few of the others can; final scores are then resolved for those. Blocks' best are merged by rank. The
queries of a block read together, so that the bounds after a part are a few matrix products; `Lists.read` has what share of
the lists each of them read.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter vectors are filled
with zeros; rows that repeat a vec_id count once, with the best of their vectors; a vec_id asked with several vectors keeps its best scores of all; an empty table gives no rows; extra columns, also such with clashing names, are ignored. Integers are exact up to 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.common import arrow_batches, stage

BLOCK, QUERIES = 4096, 1024
SCALE = 256
#: Parts that lists are read in, and the share of vectors that may be left when reading stops.
STEPS, OPEN = 16, 1 / 8
_BLOCK = "n long, dim int, ids binary, data binary, width int"


def _quantised(ids: list, vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids and an int64 matrix of the rows that take part."""
    keep, rows = [], []
    for i, v in zip(ids, vectors, strict=True):
        if i is None or v is None or any(x is None for x in v):
            continue
        a = np.floor(np.asarray(v, np.float64) * SCALE)
        if np.isfinite(a).all():
            keep.append(i)
            rows.append(a)
    dim = max((len(a) for a in rows), default=0)
    out = np.zeros((len(rows), dim), np.int64)
    for k, a in enumerate(rows):
        out[k, : len(a)] = a
    return np.array(keep, np.int64), out


def _packs(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        rows: list = []

        def out(m: int) -> pa.RecordBatch:
            a, x = _quantised(ids[:m], rows[:m])
            x = narrowest(x)
            del ids[:m], rows[:m]
            return pa.RecordBatch.from_arrays([pa.array([len(a)], pa.int64()), pa.array([x.shape[1]], pa.int32()), pa.array([a.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([x.itemsize], pa.int32())], names=["n", "dim", "ids", "data", "width"])

        for b in batches:
            ids += b.column(0).to_pylist()
            rows += b.column(1).to_pylist()
            while len(ids) >= size:
                yield out(size)
        if ids:
            yield out(len(ids))

    return run


class Lists:
    """A block's sorted lists: for each dimension the rows by rising value. Rows are in order of their ids."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        first: dict[tuple[int, bytes], int] = {}
        for i, (own, v) in enumerate(zip(ids.tolist(), data, strict=True)):
            first.setdefault((own, v.tobytes()), i)
        keep = np.array(sorted(first.values(), key=lambda i: ids[i]), int)
        self.ids, self.data = ids[keep], data[keep]
        self.order = np.argsort(self.data, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.data, self.order, 0)
        self.starts = np.flatnonzero(np.r_[True, self.ids[1:] != self.ids[:-1]]) if len(keep) else np.empty(0, int)
        self.read = np.empty(0)

    def candidates(self, owns: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the rows that may be among its best k distinct ids, by reading the lists as far as that needs."""
        n, d = self.data.shape
        most = d * int(np.abs(self.data).max(initial=0)) * int(np.abs(queries).max(initial=0))
        kind = np.float32 if most < 1 << 24 else np.float64
        slack = 0.0 if most < 1 << 53 else most * 2.0**-45  # beyond that, sums are rounded
        plus, minus = np.maximum(queries, 0).T.astype(kind), np.minimum(queries, 0).T.astype(kind)
        least, largest = self.sorted[0].astype(kind)[:, None], self.sorted[-1].astype(kind)[:, None]
        # what was met: a mark and the value, in the lists read from their high and from their low ends
        high_met, high_read, low_met, low_read = (np.zeros((n, d), kind) for _ in range(4))
        columns = np.arange(d)[None]
        left, depth = np.arange(len(queries)), 0
        out: list[np.ndarray] = [np.arange(n)] * len(queries)
        self.read = np.ones(len(queries))
        for step in range(1, STEPS + 1):
            to = n * step // STEPS
            for rows, met, read in ((self.order[n - to : n - depth], high_met, high_read), (self.order[depth:to], low_met, low_read)):
                met[rows, columns] = 1
                read[rows, columns] = self.data[rows, columns]
            depth = to
            up, down = plus[:, left], minus[:, left]
            exact = high_read @ up + low_read @ down

            def bounds(a: np.ndarray, b: np.ndarray, up: np.ndarray = up, down: np.ndarray = down, exact: np.ndarray = exact) -> tuple[np.ndarray, np.ndarray]:
                """(scores of all rows with a and b for what was not met, the score of a row that was met nowhere)."""
                unmet = (a * up).sum(0) + (b * down).sum(0)
                return exact + (unmet - high_met @ (a * up) - low_met @ (b * down)), unmet

            low = bounds(least, largest)[0] - slack
            low[self.ids[:, None] == owns[left][None]] = -np.inf
            by_id = np.maximum.reduceat(low, self.starts, 0)
            kth = np.partition(by_id, len(by_id) - k, 0)[len(by_id) - k] if len(by_id) >= k else np.full(len(left), -np.inf)
            kth = np.maximum(kth, floors[left])
            now = (self.sorted[max(n - 1 - depth, 0)].astype(kind)[:, None], self.sorted[min(depth, n - 1)].astype(kind)[:, None])
            high, unmet = bounds(*now)
            open_ = (high + slack >= kth).T
            done = ((unmet + slack < kth) & (open_.sum(1) <= n * OPEN)) | (depth == n)
            for j in np.flatnonzero(done):
                out[left[j]] = np.flatnonzero(open_[j])
                self.read[left[j]] = step / STEPS
            left = left[~done]
            if not len(left):
                break
        return out

    def top(self, owns: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each query (score, vec_id) of the best k distinct ids but its own; scores under its floor may be left out."""
        if not len(self.ids):
            return [[]] * len(queries)
        out = []
        for own, q, c in zip(owns.tolist(), queries, self.candidates(owns, queries, floors, k), strict=True):
            c = c[self.ids[c] != own]
            scores = self.data[c] @ q  # final scores of those that remain
            best: dict[int, int] = {}
            for at in np.lexsort((self.ids[c], -scores)):
                best.setdefault(int(self.ids[c[at]]), int(scores[at]))
                if len(best) == k:
                    break
            out.append([(s, i) for i, s in best.items()])
        return out


def narrowest(x: np.ndarray) -> np.ndarray:
    """x in the smallest integer type that holds it."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the best k of vectors (vec_id, embedding) for each of queries (same columns)."""
    spark = vectors.sparkSession
    arrow_batches(spark, 2048)
    blocks = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_packs(BLOCK), _BLOCK).filter("n > 0")
    blocks = stage(blocks.withColumn("b", F.monotonically_increasing_id()), "topk-blocks")
    asked = queries.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    parts = max(1, math.ceil(asked.count() / QUERIES))
    asked = asked.repartition(parts).mapInArrow(_packs(QUERIES), _BLOCK).filter("n > 0")
    asked = stage(asked.withColumn("g", F.spark_partition_id()), "topk-queries")
    # every query block meets every block; the key of a meeting is (query block, slice of blocks)
    spread = max(1, blocks.count())  # a slice holds about one block, however many there are
    left = blocks.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(spread)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = asked.select("g", F.col("dim").alias("qdim"), F.col("ids").alias("qids"), F.col("data").alias("qdata"), F.col("width").alias("qwidth")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    # never broadcast: Spark sizes a side by its files, before it is repeated for every slice or query block
    pairs = left.hint("merge").join(right.hint("merge"), ["g", "s"]).select("dim", "ids", "data", "width", "qdim", "qids", "qdata", "qwidth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, bytes], dict[int, int]] = {}  # each query's best so far, over the blocks of this task
        for b in batches:
            for r in b.to_pylist():
                ids, qids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["qids"], np.int64)
                data = np.frombuffer(r["data"], f"i{r['width']}").astype(np.int64).reshape(len(ids), -1)
                q = np.frombuffer(r["qdata"], f"i{r['qwidth']}").astype(np.int64).reshape(len(qids), -1)
                d = max(r["dim"], r["qdim"])
                lists = Lists(ids, np.pad(data, ((0, 0), (0, d - data.shape[1]))))
                q = np.pad(q, ((0, 0), (0, d - q.shape[1])))
                keys = [(own, v.tobytes()) for own, v in zip(qids.tolist(), q, strict=True)]
                floors = np.array([min(f.values()) if len(f := known.get(key, {})) >= k else -np.inf for key in keys])
                rows = []
                for key, got in zip(keys, lists.top(qids, q, floors, k), strict=True):
                    best = known.get(key, {})
                    for s, i in got:
                        best[i] = max(s, best.get(i, s))
                        rows.append((key[0], i, s))
                    known[key] = dict(sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k])
                cols = list(zip(*rows, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    best = pairs.mapInArrow(run, "query_id long, vec_id long, score long").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(vectors: DataFrame) -> DataFrame:
    """The contract's columns: queries are the rows whose vec_id is divisible by 50."""
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
