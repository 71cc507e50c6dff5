"""Operator 13. Centroid clustering (k-means over integers) by exponion search.

Each vector keeps its cluster, an upper bound of the distance to its own centroid and a lower bound of the distance to any other. A vector whose
upper bound is below its lower bound, or below half of the distance from its centroid to the nearest other one, stays without a look at any
centroid. The others scan the centroids inside a ball around their own: of radius 2 u + s, u being the distance to it and s its distance to its
nearest neighbour; the nearest and the second nearest centroid lie in that ball. Each centroid has the list of all others by distance, so a ball
is a prefix of a list. All comparisons that skip work are strict and the radius is inclusive, so a tie is always seen and goes to the smaller
number. Distances are exact integers; bounds are doubles with a margin above their rounding.

Rows with their bounds are a table written once a round; sums of clusters are exact integers, added up in each task before the shuffle (one row a cluster and
task), so a cluster that holds most vectors is no hot key. Driver and tasks hold the k centroids alone.

Defined results: vectors that are null, of another width, or hold a null or a non-finite component take no part, and neither do those with a component beyond
2^27 after scaling (squared distances would not fit 64 bits); copies and repeated ids each count and have their own rows; of equal start hashes (repeated ids) the smaller vector
comes first; rows without an id are clustered, but never start a cluster; fewer vectors than k give as many clusters as vectors; an empty table gives no rows; sums of distances
beyond 64 bits are null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import forget, materialize

LARGEST = 1 << 27
STATE = "id long, v array<int>, c int, u double, l double, d long"


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(axis=-1)


def clearly_less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a < b by more than what rounding can have done to either."""
    return a + (1e-6 + 1e-9 * np.abs(a)) < b


class Centroids:
    """k centroids, and for each the list of all by their distance from it, itself first."""

    def __init__(self, c: np.ndarray):
        self.c = c
        apart = np.sqrt(np.stack([squared(c, own) for own in c]).astype(np.float64))
        np.fill_diagonal(apart, -1.0)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.sorted = np.take_along_axis(apart, self.order, axis=1)
        self.nearest = self.sorted[:, 1] if len(c) > 1 else np.full(1, np.inf)
        self.scanned = 0  # distances computed in searches

    def assign(self, x: np.ndarray, a: np.ndarray, u: np.ndarray, l: np.ndarray) -> np.ndarray:  # noqa: E741
        """Moves a, u and l to the nearest centroids; returns the exact squared distances."""
        stays = lambda i: clearly_less(u[i], np.maximum(l[i], self.nearest[a[i]] / 2))
        todo = np.flatnonzero(~stays(slice(None)))
        u[todo] = np.sqrt(squared(x[todo], self.c[a[todo]]).astype(np.float64))
        todo = todo[~stays(todo)]
        for own in np.unique(a[todo]):
            mine = todo[a[todo] == own]
            radius = 2 * u[mine] + self.nearest[own]
            reach = np.searchsorted(self.sorted[own], radius + (1e-6 + 1e-9 * radius), side="right")
            by = np.argsort(-reach, kind="stable")
            mine, reach = mine[by], reach[by]
            best, second = np.full((2, len(mine)), np.iinfo(np.int64).max)
            at = np.full(len(mine), -1)
            for k, j in enumerate(self.order[own][: reach[0]]):
                n = np.searchsorted(-reach, -k)  # those whose ball holds this centroid
                d = squared(x[mine[:n]], self.c[j])
                better = (d < best[:n]) | ((d == best[:n]) & (j < at[:n]))
                second[:n] = np.where(better, best[:n], np.minimum(second[:n], d))
                best[:n], at[:n] = np.where(better, d, best[:n]), np.where(better, j, at[:n])
                self.scanned += int(n)
            a[mine], u[mine] = at, np.sqrt(best.astype(np.float64))
            l[mine] = np.where(second == np.iinfo(np.int64).max, np.inf, np.sqrt(second.astype(np.float64)))
        return squared(x, self.c[a])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


class ExponionKMeans:
    """k clusters of vectors of one width, each component taken as floor(scale * x).

    seed: the k rows of the smallest sha256 of "seed:id" are the first centroids. rounds: of assignment and move, before the last assignment.
    """

    def __init__(self, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2):
        self.k, self.rounds, self.width, self.scale, self.seed = k, rounds, width, scale, seed
        self.centroids = np.zeros((0, width), dtype=np.int64)

    def rows(self, df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        v, scaled = F.col("v"), lambda x: F.floor(x * self.scale)
        rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v")).where(v.isNotNull() & (F.size(v) == self.width))
        fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * self.scale <= LARGEST)
        return rows.where(F.forall(v, fits)).select("id", F.transform(v, lambda x: scaled(x).cast("int")).alias("v"))

    def moved(self, state: DataFrame, shift: np.ndarray | None) -> DataFrame:
        """state with every vector at its nearest centroid; shift: how far each centroid has moved since the last time (null: no bounds yet)."""
        c, width = self.centroids, self.width
        if shift is not None:
            most = np.array([np.delete(shift, j).max() if len(shift) > 1 else 0.0 for j in range(len(shift))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids = Centroids(c)
            for batch in batches:
                x = matrix(batch.column("v"), width)
                if not len(x):
                    continue
                a, u, low = (np.array(batch.column(n).to_numpy(zero_copy_only=False)) for n in ("c", "u", "l"))
                if shift is not None:
                    u, low = u + shift[a], low - most[a]
                d = centroids.assign(x, a, u, low)
                own = {"id": batch.column("id"), "v": batch.column("v"), "c": pa.array(a.astype(np.int32)), "u": pa.array(u), "l": pa.array(low), "d": pa.array(d)}
                yield pa.RecordBatch.from_pydict(own)

        return state.mapInArrow(run, STATE)

    def sums(self, state: DataFrame) -> dict[int, tuple[int, list[int]]]:
        """Of every cluster: how many vectors it has, and their sum."""
        k, width = len(self.centroids), self.width

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64)
            for batch in batches:
                a = batch.column("c").to_numpy(zero_copy_only=False)
                np.add.at(n, a, 1)
                np.add.at(total, a, matrix(batch.column("v"), width))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"c": pa.array(some.astype(np.int32)), "n": pa.array(n[some]), "s": pa.array(list(total[some]), type=pa.list_(pa.int64()))})

        parts = state.select("c", "v").mapInArrow(part, "c int, n long, s array<long>")
        own = parts.groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))
        return {r["c"]: (r["n"], r["s"]) for r in own.collect()}  # k rows at most

    def cluster(self, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
        spark, rows = df.sparkSession, self.rows(df, id_col, vec_col)
        start = rows.where("id is not null").orderBy(F.sha2(F.concat(F.lit(f"{self.seed}:"), F.col("id").cast("string")), 256), "v").limit(self.k)
        self.centroids = np.array([r["v"] for r in start.collect()], dtype=np.int64).reshape(-1, self.width)
        if not len(self.centroids):
            return spark.createDataFrame([], f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        state, shift = rows.select("id", "v", F.lit(0).alias("c"), F.lit(float("inf")).alias("u"), F.lit(0.0).alias("l"), F.lit(0).cast("long").alias("d")), None
        for i in range(self.rounds):
            before, state = state, materialize(self.moved(state, shift), "exponion")
            if i:
                forget(spark, before)
            new = self.centroids.copy()
            for j, (n, total) in self.sums(state).items():
                new[j] = [s // n for s in total]
            shift = np.sqrt(squared(new, self.centroids).astype(np.float64))
            self.centroids = new
        last = materialize(self.moved(state, shift).select("id", "c", "d"), "clusters")
        if self.rounds:
            forget(spark, state)
        inertia = {r["c"]: r["i"] for r in last.groupBy("c").agg(F.expr("try_sum(d)").alias("i")).collect()}
        every = None if None in inertia.values() or sum(inertia.values()) >= 1 << 63 else sum(inertia.values())
        digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
        names = spark.createDataFrame([(j, inertia[j], every, digest(self.centroids[j])) for j in inertia], "c int, cluster_inertia long, inertia long, centroid_sha256 string")
        # k rows
        return last.join(F.broadcast(names), "c").select(F.col("id").alias(id_col), F.col("c").alias("cluster"), F.col("d").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")
