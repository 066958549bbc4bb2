"""Nearest neighbours by inner product: low-dimensional stable projections in a kd-tree, with a chi-square stopping test.

Largest inner product is made smallest distance by one more coordinate (all vectors reach the largest norm, queries are scaled to
it). A cell holds at most about CELL vectors; in each, DIMENSIONS Gaussian projections of the vectors stand in a kd-tree. A query
visits the leaves in the order of their projected distance and verifies every vector of a leaf on the original coordinates. For a
vector at distance d, the squared projected distance over d squared follows a chi-square law with DIMENSIONS degrees of freedom;
the search ends when the next leaf lies so far that a closer vector than the k-th found would stand in it with probability below
1 - CONFIDENCE. Every vector is indexed; cells see all queries in blocks, and the best of all cells are merged.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors are compared within
their number of dimensions. Fewer candidates than k give fewer rows; ties go to the smaller id. Rows with equal id and equal
vector count once; a query is never its own neighbour.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 8
#: Upper point of the chi-square law with 8 degrees of freedom for the probability 0.99 (fixed value).
CONFIDENCE, STOP = 0.99, 20.090
CELL, QUERIES, LEAF = 16_384, 4_096, 32
SEED = 20_090


class ProjectedTree:
    """Vectors of one cell, reordered so that each leaf of the tree is a range."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm2: float):
        self.norm2 = norm2
        # The coordinate that brings every vector to the largest norm.
        rest = np.sqrt(np.maximum(norm2 - np.einsum("ij,ij->i", vectors, vectors), 0.0))
        self.plane = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, DIMENSIONS))
        points = vectors @ self.plane[:-1] + rest[:, None] * self.plane[-1]
        order, todo, leaves = np.arange(len(ids)), [(0, len(ids))], []
        while todo:
            a, b = todo.pop()
            if b - a <= LEAF:
                leaves.append((a, b))
                continue
            part = points[order[a:b]]
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], half)]
            todo += [(a, a + half), (a + half, b)]
        leaves.sort()
        self.ids, self.vectors, points = ids[order], vectors[order], points[order]
        starts, ends = np.array([a for a, _ in leaves]), np.array([b for _, b in leaves])
        # Rows of each leaf, filled up with -1.
        slots = np.arange((ends - starts).max())
        self.leaf_rows = np.where(starts[:, None] + slots < ends[:, None], starts[:, None] + slots, -1)
        self.low = np.minimum.reduceat(points, starts, axis=0)
        self.high = np.maximum.reduceat(points, starts, axis=0)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the best k found."""
        scale = np.sqrt(self.norm2 / (query @ query))
        at = (query * scale) @ self.plane[:-1]
        gap = np.maximum(np.maximum(self.low - at, at - self.high), 0.0)
        bound = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(bound, kind="stable")
        # Products of whole leaves are rounded in another order than single ones: what lies this close is compared again.
        close = 1e-9 * self.norm2 / scale
        rows, scores, last, done, step = np.zeros(0, np.int64), np.zeros(0), -np.inf, 0, 4
        while done < len(order):
            if len(rows) >= k:
                distance2 = 2.0 * self.norm2 - 2.0 * scale * last
                if bound[order[done]] > STOP * max(distance2, 0.0) + 1e-9 * self.norm2:
                    break
            more = self.leaf_rows[order[done : done + step]].ravel()
            more = more[more >= 0]
            found = self.vectors[more] @ query
            good = (found >= last - close) & (self.ids[more] != query_id)
            rows, scores = np.concatenate([rows, more[good]]), np.concatenate([scores, found[good]])
            if len(rows) >= k:
                last = np.partition(scores, len(scores) - k)[len(scores) - k]
                good = scores >= last - close
                rows, scores = rows[good], scores[good]
            done += step
            step *= 2
        exact = (self.vectors[rows] * query).cumsum(axis=1)[:, -1] if len(rows) else scores
        top = np.lexsort((self.ids[rows], -exact))[:k]
        return self.ids[rows][top], exact[top]


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found for each query; both sides have the same two columns."""

    def made(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))

    base, asked = made(vectors), made(queries)
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm2).alias("norm2"))
    asks = asked.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("asks"))
    plan = sizes.join(asks, "d").select(
        "d", "norm2", F.ceil(F.col("n") / CELL).cast("int").alias("cells"), F.ceil(F.col("asks") / QUERIES).cast("int").alias("blocks")
    )
    plan = F.broadcast(plan)  # one row for each number of dimensions
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    number = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    left = base.withColumn("d", F.size("v")).join(plan, "d").select("d", "norm2", "id", "v", number("cells").alias("cell"), spread("blocks").alias("block"))
    right = asked.withColumn("d", F.size("v")).join(plan, "d").select("d", "id", "v", number("blocks").alias("block"), spread("cells").alias("cell"))

    def found(mine: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(asking):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, points = _distinct(mine)
        tree = ProjectedTree(ids, points, float(mine["norm2"].iloc[0]))
        out = []
        for q, point in zip(*_distinct(asking)):
            near, score = tree.search(int(q), point, k)
            out.append(pd.DataFrame({"query_id": q, "vec_id": near, "score": score}))
        return pd.concat(out)

    cells = left.groupBy("d", "cell", "block").cogroup(right.groupBy("d", "cell", "block"))
    best = cells.applyInPandas(found, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _distinct(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, rows with equal id and vector once."""
    ids, points = frame["id"].to_numpy(np.int64), np.stack(frame["v"].to_numpy()).astype(np.float64)
    if len(np.unique(ids)) == len(ids):
        return ids, points
    both = np.unique(np.column_stack([ids.view(np.float64), points]).view(np.int64), axis=0)
    return both[:, 0].copy(), both[:, 1:].copy().view(np.float64)
