"""Exact top-k search by inner product, pruned by segment statistics at several resolutions (operator 5).

1. An orthonormal rotation, fitted on SAMPLE rows at most, turns vectors so that their variance lies in
   few leading components. It leaves inner products as they are, so it only makes the bounds tighter.
2. A rotated vector is cut into segments, short ones in front; with each segment's mean and deviation,
   Cauchy-Schwarz gives q.x <= sum over segments of length * (mean_q * mean_x + deviation_q * deviation_x), which is
   the lower bound |q|^2 + |x|^2 - 2 q.x of the squared distance in other words. Coarse segments are tried first,
   then finer ones for what survives, then exact integer scores of the vectors as they were.
3. A query's bound is its k-th best score so far, to begin with that over the sample, so no vector that belongs to
   a result is dropped; ties go to the smaller id. Where most pairs survive, their scores are one matrix product.

The query set is stated by the caller and may grow with the data: it is taken in blocks of about
QUERY_BYTES, one at a time (collected, broadcast, run over all candidates, released), and the candidates'
partitions return their own k best for each query.

Vectors that are null, empty, or hold a null or non-finite component, and rows with a null id, take no
part; vectors are compared with those of their own length only. Components beyond a double's range after scaling are
held at its end. Scores are exact integers; one beyond a long's range counts as the long's end.
A repeated id is a candidate for other queries each time it occurs, and as a query it counts once (its smallest
vector). Extra columns are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.llm._spark import cut

QUERY_BYTES = 32 << 20
SAMPLE = 4096
#: Shares of the components at which segments end, coarse to fine.
SEGMENTS = ((1 / 16, 1 / 8, 1 / 4, 1 / 2, 1), tuple((i + 1) / 32 for i in range(16)) + (5 / 8, 3 / 4, 7 / 8, 1))
_ROWS = 1024
_EXACT = 2.0**53
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (array of double): floor(scale * x) of each component, without what takes no part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    top = F.lit(sys.float_info.max)
    whole = lambda e: F.when(F.abs(e) < 2.0**44, F.floor(e * scale).cast("double")).otherwise(F.greatest(F.least(e * scale, top), -top))
    return vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0").where(F.coalesce(good, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v")
    )


def rotation(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns, those of most variance in the sample first."""
    if not len(sample) or not np.isfinite(sample).all() or np.abs(sample).max() > 1e150:
        return np.eye(sample.shape[1])
    _, directions = np.linalg.eigh(sample.T @ sample)
    return directions[:, ::-1]


def statistics(v: np.ndarray, shares: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, means and deviations of the segments of each row."""
    ends = np.unique(np.ceil(np.asarray(shares) * v.shape[1]).astype(int))
    starts = np.concatenate(([0], ends[:-1]))
    length = ends - starts
    mean = np.add.reduceat(v, starts, axis=1) / length
    spread = v - np.repeat(mean, length, axis=1)
    return length, mean, np.sqrt(np.add.reduceat(spread * spread, starts, axis=1) / length)


def upper_bounds(q: tuple, x: tuple) -> np.ndarray:
    """Bounds of the inner products of all rows of two sets, from their statistics."""
    sides = lambda s: np.concatenate((s[1], s[2]), axis=1) * np.sqrt(np.tile(s[0], 2))
    a, b = sides(q), sides(x)
    return a @ b.T + 1e-9 * np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :] + 1


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two sets of whole numbers, within a long."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < _EXACT:
        return (q @ x.T).astype(np.int64)
    a, b = ([[int(e) for e in row] for row in m.tolist()] for m in (q, x))
    return np.asarray([[max(-_LONG - 1, min(_LONG, sum(map(int.__mul__, one, other)))) for other in b] for one in a], dtype=np.int64)


class Best:
    """The k best (score, id) of each of a block of queries of one length, fed with candidates in any order."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, turn: np.ndarray, floor: np.ndarray | None = None):
        self.ids, self.v, self.k, self.turn = ids, v, k, turn
        with np.errstate(over="ignore", invalid="ignore"):
            self.levels = [statistics(v @ turn, s) for s in SEGMENTS]
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor  # no result scores less
        self.score = np.full((len(ids), k), -_LONG - 1)  # with _LONG as vec: none yet
        self.vec = np.full((len(ids), k), _LONG)
        self.pairs = self.scored = 0

    def feed(self, ids: np.ndarray, x: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            turned = x @ self.turn
            own = [statistics(turned, s) for s in SEGMENTS]
        least = np.maximum(self.floor, self.score[:, -1].astype(np.float64))
        least -= 1e-9 * np.where(np.isfinite(least), np.abs(least), 0)
        rows, columns = np.arange(len(self.ids)), np.arange(len(ids))
        may = None
        for level, other in zip(self.levels, own, strict=True):
            with np.errstate(over="ignore", invalid="ignore"):
                bound = upper_bounds([level[0], level[1][rows], level[2][rows]], [other[0], other[1][columns], other[2][columns]])
            may = (~(bound < least[rows, None])) & (True if may is None else may)  # a bound that is no number drops nothing
            may &= self.ids[rows, None] != ids[None, columns]
            p, r = may.any(axis=1), may.any(axis=0)
            rows, columns, may = rows[p], columns[r], may[p][:, r]
            if not len(rows):
                break
        self.pairs += len(self.ids) * len(ids)
        self.scored += may.sum()
        if not len(rows):
            return
        score = exact(self.v[rows], x[columns])
        good = may & (score >= self.score[rows, -1:])
        a, b = np.nonzero(good)
        score = score[a, b]
        a, b = rows[a], columns[b]
        if not len(a):
            return
        rows = np.unique(a)
        q = np.concatenate((a, np.repeat(rows, self.k)))
        s = np.concatenate((score, self.score[rows].ravel()))
        v = np.concatenate((ids[b], self.vec[rows].ravel()))
        order = np.lexsort((v, ~s, q))
        q, s, v = q[order], s[order], v[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.k
        self.score[q[top], place[top]], self.vec[q[top], place[top]] = s[top], v[top]

def _matrices(column: pa.Array):
    """(length, rows, matrix) of the vectors of each length, in bounded parts."""
    starts = column.offsets.to_numpy()
    values, size = column.values.to_numpy(zero_copy_only=False), np.diff(starts)
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        for i in range(0, len(rows), _ROWS):
            part = rows[i : i + _ROWS]
            yield n, part, values[starts[part][:, None] + np.arange(n)]


def _search(shared, k: int):
    def run(batches):
        best = {n: Best(ids, v, k, turn, floor) for n, (ids, v, turn, floor) in shared.value.items()}
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for n, rows, x in _matrices(batch.column("v")):
                if n in best:
                    best[n].feed(ids[rows], x)
        for own in best.values():
            i, j = np.nonzero((own.vec != _LONG) | (own.score != -_LONG - 1))
            yield pa.RecordBatch.from_arrays([pa.array(own.ids[i]), pa.array(own.vec[i, j]), pa.array(own.score[i, j])], names=["query_id", "vec_id", "score"])

    return run


def _block(rows: list, sample: list, k: int) -> dict:
    """By length: ids, vectors and rotation of a block's queries, and the k-th best score of each over the sample."""
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["v"]), []).append(r)
    out = {}
    for n, own in by.items():
        ids, v = np.asarray([r["vec_id"] for r in own]), np.asarray([r["v"] for r in own], dtype=np.float64)
        known = [r for r in sample if len(r["v"]) == n]
        x = np.asarray([r["v"] for r in known], dtype=np.float64).reshape(-1, n)
        turn, floor = rotation(x) if len(x) else np.eye(n), np.full(len(ids), -np.inf)
        other = np.asarray([r["vec_id"] for r in known], dtype=np.int64)
        if len(x) > k and float(np.abs(v).max()) * float(np.abs(x).max()) * n < _EXACT:
            for i in range(0, len(ids), _ROWS):
                score = np.where(ids[i : i + _ROWS, None] == other[None, :], -np.inf, v[i : i + _ROWS] @ x.T)
                floor[i : i + _ROWS] = np.partition(score, -k, axis=1)[:, -k]
        out[n] = ids, v, turn, floor
    return out


def search(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of candidates (vec_id, v) for each of queries (vec_id, v), but itself."""
    spark = queries.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    size = queries.agg(F.sum(8 * F.size("v") + 16)).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    total = candidates.agg(F.count("*"), F.max(F.size("v"))).first()
    wide = max(1, min(SAMPLE, QUERY_BYTES // (8 * max(1, total[1] or 1))))
    sample = candidates.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30)) < int(min(1.0, wide / max(1, total[0])) * (1 << 30))).select("vec_id", "v").collect()
    found = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()  # about QUERY_BYTES
        shared = spark.sparkContext.broadcast(_block(rows, sample, k))
        part = candidates.select("vec_id", "v").mapInArrow(_search(shared, k), "query_id long, vec_id long, score long")
        if blocks > 1:
            part = cut(part)
            shared.unpersist()
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM x q JOIN x c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
