"""Nearest neighbours by a block matrix join with int8 tiles, error bounds and heaps.

Queries are split into groups and candidates into groups; every cell (query group, candidate group) is one unit
of work, so no task holds more than two groups and work spreads over cells. Vectors are quantised to int8 with one
scale each. A tile's products of int8 values are exact in float arithmetic, and

    |x.y - sx*sy*(qx.qy)| <= |ex|*|y| + |sx*qx|*|ey|,   e = x - s*q,

bounds the quantisation error, so a candidate whose upper bound lies below the k-th largest lower bound cannot be
among the k nearest. Survivors are recomputed in double precision from the original vectors, component after component, so that a pair has
the same score to the last bit wherever it is computed, and equal vectors tie. The cells' lists are merged by a bounded
heap for each query. So the result is exact.

A cell holds ``QUERIES_A_GROUP`` and ``ROWS_A_GROUP`` vectors at most, in the type they are given in. All pairs of queries and candidates are
what is asked for; each candidate is sent once to every group of queries, that is N / (20 * QUERIES_A_GROUP) times.

Repeated rows of one vec_id and vector are one row from the start, and cells are formed by vec_id and vector, so an
id of many vectors is spread over cells. Bounds and heaps count distinct vec_ids, each with its largest score.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part; vectors of
another length than the query's are no candidates; fewer candidates than ``k`` give all of them; ties go to the smaller vec_id;
components of any finite size take part (a score beyond the doubles is infinite, and a
sum of opposite infinities counts as the smallest); an empty table gives an empty result; a row is not its own candidate, nor is a repeated row of the same vec_id; a query_id of several vectors has the largest
score over them. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES_A_GROUP, ROWS_A_GROUP, TILE, QUERIES_AT_ONCE = 8192, 8192, 2048, 512
#: Largest components within which no product, square or sum of products leaves the range of doubles; vectors beyond are compared without bounds.
PLAIN = (1e-140, 1e140)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 values and scales of row vectors."""
    scale = np.abs(x).max(axis=1) / 127
    return np.rint(x / scale[:, None]).astype(np.int8), scale


def _bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    most = np.abs(x).max(axis=1)
    odd = (most < PLAIN[0]) | (most > PLAIN[1])
    x = np.where(odd[:, None], 1.0, x)
    q, s = quantised(x)
    back = q * s[:, None]
    error = np.linalg.norm(x - back, axis=1)
    error[odd] = np.inf
    return q.astype(np.float32 if x.shape[1] <= 1000 else np.float64), s, np.linalg.norm(x, axis=1), np.linalg.norm(back, axis=1), error


def offer(heap: list[tuple[float, int]], held: dict[int, float], k: int, score: float, name: int) -> None:
    """Put a candidate into a heap of ``k`` distinct names; a name counts with its largest score, ``held`` has the heap's."""
    if name in held:
        if score > held[name]:
            heap[heap.index((held[name], -name))] = (score, -name)
            heapq.heapify(heap)
            held[name] = score
    elif len(heap) < k:
        heapq.heappush(heap, (score, -name))
        held[name] = score
    elif (score, -name) > heap[0]:
        del held[-heapq.heapreplace(heap, (score, -name))[1]]
        held[name] = score


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner product of each row of ``x`` with the same row of ``y``, summed from the first component to the last."""
    total = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(x.shape[1]):
            total += x[:, d] * y[:, d]
    return np.where(np.isnan(total), -np.inf, total)


def nearest_in_cell(ids: np.ndarray, x: np.ndarray, cand_ids: np.ndarray, y: np.ndarray, k: int, tile: int = TILE):
    """For each query the k nearest of the candidates: list of (score, vec_id), best first, a vec_id once."""
    order = np.argsort(cand_ids, kind="stable")
    cand_ids, y = cand_ids[order], y[order]
    qx, sx, nx, bx, ex = _bounds(x)
    heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
    held: list[dict[int, float]] = [{} for _ in ids]
    for at in range(0, len(cand_ids), tile):
        part, names = y[at : at + tile], cand_ids[at : at + tile]
        qy, sy, ny, by, ey = _bounds(part)
        near = (qx @ qy.T).astype(np.float64) * sx[:, None] * sy[None, :]
        slack = ex[:, None] * ny[None, :] + bx[:, None] * ey[None, :]
        slack = slack * (1 + 1e-9) + 1e-12 * (nx[:, None] * ny[None, :])
        low = near - slack
        low[ids[:, None] == names[None, :]] = -np.inf
        firsts = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        if len(firsts) < len(names):
            low = np.maximum.reduceat(low, firsts, axis=1)
        kept = min(k, low.shape[1])
        floor = np.partition(low, low.shape[1] - kept, axis=1)[:, low.shape[1] - kept]
        worst = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        floor = np.maximum(np.where(kept == k, floor, -np.inf), worst)
        alive = near + slack >= floor[:, None]
        alive &= ids[:, None] != names[None, :]
        rows, cols = np.nonzero(alive)
        for at_ in range(0, len(rows), 65_536):
            r, c = rows[at_ : at_ + 65_536], cols[at_ : at_ + 65_536]
            for q, score, name in zip(r.tolist(), products(x[r], part[c]).tolist(), names[c].tolist()):
                offer(heaps[q], held[q], k, score, name)
    return [[(s, -n) for s, n in sorted(h, reverse=True)] for h in heaps]


def _matrix(frame: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = frame.column("v").combine_chunks()
    ids = frame.column("vec_id").to_numpy()
    return ids, column.flatten().to_numpy().reshape(len(ids), -1).astype(np.float64)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, queries_a_group: int = QUERIES_A_GROUP, rows_a_group: int = ROWS_A_GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of each row with vec_id divisible by ``every``."""
    spark = vectors.sparkSession
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).filter("vec_id is not null and size(v) > 0 and forall(v, e -> e is not null and not isnan(double(e)) and abs(double(e)) < double('Infinity')) and exists(v, e -> e <> 0)")
    sound = sound.groupBy("vec_id", "v").agg(F.size("v").alias("dim"))
    sizes = {r["dim"]: (r["n"], r["q"]) for r in sound.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()}
    schema = "query_id long, rank int, vec_id long, score double"
    if not any(q for _, q in sizes.values()):
        return spark.createDataFrame([], schema)
    count = lambda which, room: F.create_map(*[F.lit(x) for d, nq in sizes.items() for x in (d, max(1, -(-nq[which] // room)))])[F.col("dim")]
    group = lambda n: F.pmod(F.xxhash64("vec_id", "v"), n)
    nq, nr = count(1, queries_a_group), count(0, rows_a_group)
    every_one = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    asked = sound.filter(F.col("vec_id") % every == 0).select("dim", group(nq).alias("g"), every_one(nr).alias("h"), "vec_id", "v")
    given = sound.select("dim", every_one(nq).alias("g"), group(nr).alias("h"), "vec_id", "v")

    def cell(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            (ids, x), (names, y) = _matrix(left), _matrix(right)
            for i in range(0, len(ids), QUERIES_AT_ONCE):
                for q, found in zip(ids[i : i + QUERIES_AT_ONCE].tolist(), nearest_in_cell(ids[i : i + QUERIES_AT_ONCE], x[i : i + QUERIES_AT_ONCE], names, y, k)):
                    out[0].extend([q] * len(found))
                    out[1].extend(n for _, n in found)
                    out[2].extend(s for s, _ in found)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    lists = asked.groupBy("dim", "g", "h").cogroup(given.groupBy("dim", "g", "h")).applyInArrow(cell, "query_id long, vec_id long, score double")

    def merged(batches):
        """Rows come sorted by query; the heap of one query at a time."""
        now, heap, held = None, [], {}

        def done():
            best = sorted(heap, reverse=True)
            return pa.RecordBatch.from_arrays([pa.array([now] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([-n for _, n in best], pa.int64()), pa.array([s for s, _ in best], pa.float64())], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for q, n, s in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score"))):
                if q != now:
                    if heap:
                        yield done()
                    now, heap, held = q, [], {}
                offer(heap, held, k, s, n)
        if heap:
            yield done()

    return lists.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merged, schema)
