"""Exact top-k search: a Voronoi kNN join over integer inner products.

Vectors get one more component that gives every row the same length, queries a
zero there: the largest inner product is then the smallest distance. Rows go to
their nearest pivot; each cell is summed up by its size, smallest and largest
distance. From these a query has an upper bound of the distance of its k-th
neighbour and, per cell, a lower bound (triangle inequality and the plane between
two pivots). It is sent to the cells whose lower bound does not pass the upper
one, and a task solves one block of a cell: its rows in memory, queries streamed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_batches, staged

#: Rows of a cell that one task holds, rows a cell should have, and pivots at most. They change no result.
BLOCK, CELL, PIVOTS = 16_384, 2_048, 256
SLACK = 1e-9


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``dim``."""
    out = np.zeros((len(lists), dim))
    size = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(lists)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out[row, at] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _distances(v: np.ndarray, more: np.ndarray, pivots: np.ndarray, length: float) -> np.ndarray:
    """Distances to the pivots in the lengthened space; ``more`` is the rows' further component."""
    extra = np.sqrt(np.maximum(length - (pivots * pivots).sum(1), 0))
    square = ((v * v).sum(1) + more * more)[:, None] + length - 2 * (v @ pivots.T + more[:, None] * extra)
    return np.sqrt(np.maximum(square, 0))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits they stay at the largest or smallest long."""
    if float(np.abs(q).sum(1).max(initial=0)) * float(np.abs(x).max(initial=0)) < 2 ** 53:
        return (q @ x.T).astype(np.int64)
    whole = np.array([[int(c) for c in r] for r in q], object).reshape(q.shape)
    other = np.array([[int(c) for c in r] for r in x], object).reshape(x.shape)
    return np.clip(whole @ other.T, -2 ** 63, 2 ** 63 - 1).astype(np.int64)


def _best(q_ids, q, ids, x, k: int):
    """(query, row, score) of each query's k best rows of a block that is sorted by id."""
    score = _products(q, x)
    own = q_ids[:, None] == ids[None, :]
    order_by = np.where(own, np.iinfo(np.int64).min, score)
    take = min(k + 1, score.shape[1])
    least = np.partition(order_by, score.shape[1] - take, axis=1)[:, score.shape[1] - take]
    r, c = np.nonzero((order_by >= least[:, None]) & ~own)
    order = np.lexsort((c, -score[r, c].astype(object) if (score == np.iinfo(np.int64).min).any() else -score[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    r, c = r[place < k], c[place < k]
    return q_ids[r], ids[c], score[r, c]


def exact_topk(data: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id",
               vec_col: str = "embedding", block: int = BLOCK, cell: int = CELL, pivots: int = PIVOTS) -> DataFrame:
    """Each query's ``k`` best rows: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties to the smaller id.

    A vector stands for ``floor(scale * x)`` of its components. ``is_query`` is a
    condition on ``id_col``. Candidates are all rows but the query's own.

    Edge cases: null vectors, vectors with a null or non-finite component and rows
    without an id take no part; shorter vectors count as padded with zeros (an
    empty one scores 0 everywhere); rows that share an id are one, with the
    smallest of their vectors; fewer than ``k`` candidates give all of them;
    scores beyond 64 bits stay at the end of the range; other columns are ignored;
    an empty table gives no rows.
    """
    spark = data.sparkSession
    arrow_batches(spark)
    vec = F.col(vec_col).cast("array<double>")
    sound = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    # floor() ends at 64 bits; from 2^52 on a double is whole already
    scaled = F.transform(vec, lambda x: x * float(scale))
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x))
    rows = staged(data.filter(vec.isNotNull() & sound & F.col(id_col).isNotNull())
                  .select(F.col(id_col).cast("long").alias("id"), whole.alias("v")).groupBy("id").agg(F.min("v").alias("v")), "topk-rows")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, length, dim = rows.agg(F.count("*"), F.coalesce(F.max(square), F.lit(0.0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    wanted = max(1, min(pivots, n // cell))
    centre = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()]
    p = np.zeros((max(1, len(centre)), dim))
    for i, v in enumerate(centre):
        p[i, :len(v)] = v

    def place(batches):
        for b in batches:
            v = _matrix(b.column(1), dim)
            d = _distances(v, np.sqrt(np.maximum(length - (v * v).sum(1), 0)), p, length)
            near = d.argmin(1) if len(d) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32)),
                                              pa.array(d[np.arange(len(d)), near])], ["id", "v", "cell", "dist"])

    placed = staged(rows.mapInArrow(place, "id long, v array<double>, cell int, dist double"), "topk-cells")
    cells = placed.groupBy("cell").agg(F.count("*"), F.min("dist"), F.max("dist")).collect()  # a row for each pivot at most
    size, low, high = np.zeros(len(p)), np.full(len(p), np.inf), np.zeros(len(p))
    for c, m, a, z in cells:
        size[c], low[c], high[c] = m, a, z
    gap = np.sqrt(np.maximum(((p[:, None] - p[None]) ** 2).sum(-1) + (np.sqrt(np.maximum(length - (p * p).sum(1), 0))[:, None]
                             - np.sqrt(np.maximum(length - (p * p).sum(1), 0))[None]) ** 2, 0))

    def route(batches):
        for b in batches:
            q = _matrix(b.column(1), dim)
            d = _distances(q, np.zeros(len(q)), p, length)
            sent = []
            for row in d:
                far = row + high
                order = np.argsort(far)
                have = np.cumsum(size[order])
                enough = np.searchsorted(have, k + 1)  # k rows besides the query's own
                most = far[order[enough]] if enough < len(order) else np.inf
                i = int(row.argmin())
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.where(gap[i] > 0, (row * row - row[i] ** 2) / (2 * gap[i]), 0)
                least = np.maximum(np.maximum(row - high, low - row), plane)
                tolerance = SLACK * (1 + np.sqrt(length) + row[i])
                sent.append(np.flatnonzero((size > 0) & ~(least > most + tolerance * 100)).astype(np.int32).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sent, pa.list_(pa.int32()))], ["id", "v", "cells"])

    blocks = np.maximum(1, np.ceil(size / block)).astype(int)
    parts = F.element_at(F.lit(blocks.tolist()).cast("array<int>"), F.col("cell") + 1)
    asked = (placed.filter(is_query).select("id", "v").mapInArrow(route, "id long, v array<double>, cells array<int>")
             .select("id", "v", F.explode("cells").alias("cell"))
             .select("id", "v", "cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("block"), F.lit(1).alias("kind")))
    held = placed.select("id", "v", "cell", F.pmod(F.xxhash64("id"), parts).cast("int").alias("block"), F.lit(0).alias("kind"))
    dealt = held.unionByName(asked).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind", "id")

    def solve(batches):
        at, ids, xs, x = None, [], [], None
        for b in batches:
            c, bl, kind = (b.column(j).to_numpy() for j in (2, 3, 4))
            step = np.flatnonzero((np.diff(c) != 0) | (np.diff(bl) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *step], [*step, len(c)]):
                if lo == hi:
                    continue
                if (key := (c[lo], bl[lo])) != at:
                    at, ids, xs, x = key, [], [], None
                own, v = b.column(0).slice(lo, hi - lo).to_numpy(), _matrix(b.column(1).slice(lo, hi - lo), dim)
                if kind[lo] == 0:
                    ids.append(own)
                    xs.append(v)
                    continue
                if not xs:
                    continue
                if x is None:
                    block_ids, x = np.concatenate(ids), np.concatenate(xs)
                for s in range(0, len(v), 256):
                    q, r, score = _best(own[s:s + 256], v[s:s + 256], block_ids, x, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(r), pa.array(score)], ["query_id", "vec_id", "score"])

    found = dealt.select("id", "v", "cell", "block", "kind").mapInArrow(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
