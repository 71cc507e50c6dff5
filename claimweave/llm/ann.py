"""Operator 1. Approximate nearest neighbours by a permutation index.

Each vector is represented by the order of its nearest pivots and posted in the inverted files of these pivots
(vector, rank of the pivot), early ranks first. The files are kept by blocks of vectors. A query reads in each block the files of its own nearest
pivots alone and adds up the footrule agreement of the vectors that it meets there; those of the greatest are reranked by the exact inner product.

With ranks cut at ``depth`` m and an absent pivot at rank m, the footrule distance of two permutations is
m(m+1) - 2 * sum over shared pivots of (m - max(rank_q, rank_x)), so the postings of the query's pivots
alone give the full order.

A permutation knows the direction alone, and nearness is the inner product: agreement is turned into an upper estimate of the cosine by a straight line, fitted in each block on pairs
of its own vectors, and two deviations of these pairs from it; vectors are ranked by estimate times length. Where all have one length this is the footrule order.
Of a block of n different vectors, share * n + spare * k are reranked. Both fall with the fourth root of the table's rows beyond four blocks, and pivots grow with the root: the 20 nearest of
more rows are nearer, so they stand out against the rest in shorter files and fewer reranked rows. The permutations of queries are computed once, not in each block.

Defined results: null, zero, ragged (another length than most vectors) and non-finite vectors take no part,
neither as query nor as candidate; an empty table gives no rows; equal scores go to the smaller id; equal
vectors are indexed once per block with all their ids, so copies never crowd each other out; ids that
repeat are repeated candidates; query rows that repeat (id and vector) are one query, an id of several vectors is answered for each; rows with a null id take no part;
no row of the query's own id is its neighbour; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HIT = "query_id long, q long, vec_id long, score double"
#: How many products with pivots, and how many postings and agreements, are held at a time.
PRODUCTS, CELLS = 1 << 20, 1 << 18


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): the rows that take part, in double precision."""
    v = F.col("v")
    return (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        .where(v.isNotNull() & F.col("id").isNotNull() & (F.size(v) > 0))
        # array_contains is null where a null is among the components, so such rows go too; NaN equals NaN there
        .where(~F.array_contains(v, F.lit(float("nan"))) & (F.array_max(v) < float("inf")) & (F.array_min(v) > float("-inf")) & ((F.array_max(v) != 0) | (F.array_min(v) != 0)))
    )


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, lengths as shares of the longest), also where squares of components would overflow."""
    largest = np.abs(x).max(axis=1, initial=0)
    unit = x / largest[:, None]
    norms = np.linalg.norm(unit, axis=1)
    lengths = norms * (largest / largest.max(initial=0))
    return unit / norms[:, None], lengths


def matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64)


def permutations(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The indices of each row's nearest pivots, nearest first; ties to the smaller index, but at the cut any of them."""
    depth, columns = min(depth, len(pivots)), pivots.T.astype(np.float32)
    out = np.empty((len(x), depth), dtype=np.int64)
    step = max(1, PRODUCTS // max(1, len(pivots)))
    for lo in range(0, len(x), step):
        far = -(x[lo : lo + step].astype(np.float32) @ columns)
        near = np.sort(np.argpartition(far, depth - 1, axis=1)[:, :depth], axis=1) if 0 < depth < len(pivots) else np.broadcast_to(np.arange(depth), (len(far), depth))
        out[lo : lo + step] = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)
    return out


class InvertedFiles:
    """The postings of one block: for each pivot, the vectors that have it among their nearest, by the pivot's rank."""

    def __init__(self, order: np.ndarray, pivots: int, depth: int):
        """order: the permutations of the block's vectors."""
        self.depth, self.size = depth, len(order)
        at = np.argsort((order * depth + np.arange(order.shape[1])).ravel(), kind="stable")
        self.vector = (at // order.shape[1]).astype(np.int32)
        self.weight = (depth - at % order.shape[1]).astype(np.float64)
        self.start = np.concatenate(([0], np.cumsum(np.bincount(order.ravel(), minlength=pivots))))

    def cosine_line(self, unit: np.ndarray, order: np.ndarray, pairs: int = 128) -> tuple[float, float]:
        """(level, slope) of an upper estimate of the cosine by agreement, over some vectors, evenly spaced in the block, beside all others."""
        some = np.unique(np.linspace(0, len(unit) - 1, min(pairs, len(unit))).astype(int))
        other = np.arange(len(unit)) != some[:, None]
        agree = np.concatenate([a for _, a in self.agreements(order[some])])[other]
        cos = (unit[some] @ unit.T)[other]
        if not len(agree) or agree.min() == agree.max():
            return 0.0, 1.0
        spread = agree - agree.mean()
        slope = max(float((spread * cos).sum() / (spread**2).sum()), 1e-12)
        level = float(cos.mean()) - slope * float(agree.mean())
        return level + 2 * float((cos - level - slope * agree).std()), slope

    def agreements(self, orders: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Half of (largest footrule distance - footrule distance) of each order to each vector of the block, for some orders at a time, so that memory is bounded."""
        first = self.start[orders]
        counts = self.start[orders + 1] - first
        cost = counts.sum(axis=1) + self.size
        at = [*np.unique((np.cumsum(cost) - cost) // CELLS, return_index=True)[1], len(orders)]
        rank = (self.depth - np.arange(orders.shape[1])).astype(np.float64)
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            n = counts[lo:hi].ravel()
            post = np.repeat(first[lo:hi].ravel() - np.cumsum(n) + n, n) + np.arange(n.sum())
            cell = np.repeat(np.repeat(np.arange(hi - lo) * self.size, orders.shape[1]), n) + self.vector[post]
            weight = np.minimum(self.weight[post], np.repeat(np.tile(rank, hi - lo), n))
            yield slice(lo, hi), np.bincount(cell, weight, (hi - lo) * self.size).reshape(hi - lo, self.size)

    def agreement(self, order: np.ndarray) -> np.ndarray:
        return next(self.agreements(order[None]))[1][0]


class PermutationIndex:
    """fit() takes the pivots from a bounded sample; search() indexes every row, block by block.

    pivots: how many rows become pivots (those of the smallest hash of their vector: the bound of the sample). Where not given, 32 a dimension or 18 times the root of the rows, 8192 at most.
    depth: how many of its nearest pivots represent a vector. Where not given, one a dimension, 96 to 2048.
    share, spare: see above. block: vectors of a block; in tables of more than 32 blocks they grow up to block_bytes. query_bytes: of a block of queries. They bound a task's memory at every table size.
    """

    def __init__(self, pivots: int | None = None, depth: int | None = None, share: float = 0.04, spare: int = 8, block: int = 4096, block_bytes: int = 16 << 20, query_bytes: int = 32 << 20):
        self.n_pivots, self.depth, self.share, self.spare, self.block, self.block_bytes, self.query_bytes = pivots, depth, share, spare, block, block_bytes, query_bytes
        self.pivots, self.files = np.zeros((0, 0)), 0

    def fit(self, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> PermutationIndex:
        rows = valid(df, id_col, vec_col)
        widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
        if widths:
            n = self.n_pivots or min(8192, max(1024, 32 * widths["w"], math.ceil(18 * math.sqrt(widths["count"]))))
            # equal vectors hash alike, so a vector of many copies is one pivot at most; hashes are shuffled first, and vectors of the smallest alone
            hashed = rows.where(F.size("v") == widths["w"]).withColumn("h", F.xxhash64("v"))
            last = hashed.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
            picked = hashed.where(F.col("h") <= last).groupBy("h").agg(F.min("v").alias("v")).orderBy("h")
            self.pivots = directions(np.array([r["v"] for r in picked.collect()], dtype=np.float64))[0]
            self.files = min(self.depth or min(2048, max(96, widths["w"])), len(self.pivots))
        return self

    def reranked(self, rows: int, k: int) -> tuple[float, int]:
        """The share of a block and the number besides that are reranked where the table has so many rows."""
        root = max(1, rows / (4 * self.block)) ** 0.25
        return self.share / root, max(2 * k, math.ceil(self.spare * k / root))

    def search(self, queries: DataFrame, data: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """query_id, rank, vec_id, score: the k nearest rows of data found for each query, its own id left out."""
        pivots, width = self.pivots, self.pivots.shape[1] if len(self.pivots) else -1
        rows = valid(data, id_col, vec_col).where(F.size("v") == width)
        asked = valid(queries, id_col, vec_col).where(F.size("v") == width).dropDuplicates(["id", "v"])
        n = rows.count()
        blocks = max(1, math.ceil(n / max(self.block, min(n / 32, self.block_bytes / (8 * max(1, width))))))
        query_blocks = max(1, math.ceil(asked.count() * 8 * max(1, width) / self.query_bytes))
        both = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("id", "v"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        left = both(rows, "db", blocks, "qb", query_blocks).withColumn("qb", F.col("qb").cast("long"))
        depth, (share, spare) = max(1, self.files), self.reranked(n, k)
        nearest = F.pandas_udf(lambda v: pd.Series(list(permutations(directions(matrix(v))[0], pivots, depth))), "array<int>")
        right = both(asked.withColumn("q", F.xxhash64("v")).withColumn("p", nearest("v")), "qb", query_blocks, "db", blocks).withColumn("db", F.col("db").cast("long"))

        def block(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            return search_block(d, q, pivots, depth, share, spare, k)

        found = left.groupBy("db", "qb").cogroup(right.groupBy("db", "qb")).applyInPandas(block, HIT)
        # the limit on the rank is applied in each task before the shuffle too, and nothing is gathered for a query
        rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_block(d: pd.DataFrame, q: pd.DataFrame, pivots: np.ndarray, depth: int, share: float, spare: int, k: int) -> pd.DataFrame:
    if not len(d) or not len(q):
        return pd.DataFrame({"query_id": [], "q": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "q": "int64", "vec_id": "int64", "score": "float64"})
    x, where = np.unique(matrix(d["v"]), axis=0, return_inverse=True)
    every = np.sort(d["id"].to_numpy())
    order = np.lexsort((d["id"].to_numpy(), where.ravel()))
    ids, starts = d["id"].to_numpy()[order], np.searchsorted(where.ravel()[order], np.arange(len(x) + 1))
    unit, norms = directions(x)
    order = permutations(unit, pivots, depth)
    files = InvertedFiles(order, len(pivots), depth)
    level, slope = files.cosine_line(unit, order)
    budget = min(len(x), math.ceil(share * len(x)) + spare)
    qid, qh, asked = q["id"].to_numpy(), q["q"].to_numpy(), matrix(q["v"])
    found = []
    for some, agree in files.agreements(np.stack(q["p"].to_numpy())):
        agree *= slope
        agree += level
        agree *= norms
        near = np.argpartition(agree, len(x) - budget, axis=1)[:, len(x) - budget :]
        hit = best_of(near, x, asked[some], qid[some], ids, starts, every, k)
        found.append((qid[some][hit[0]], qh[some][hit[0]], *hit[1:]))
    return pd.DataFrame(dict(zip(("query_id", "q", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))


def best_of(near: np.ndarray, x: np.ndarray, asked: np.ndarray, qid: np.ndarray, ids: np.ndarray, starts: np.ndarray, every: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score): by exact inner products, each query's k best rows of the vectors near it."""
    # of the copies of one vector, the k smallest other ids can be among the nearest; rows of the query's own id come on top
    own = np.searchsorted(every, qid, "right") - np.searchsorted(every, qid)
    rough = np.stack([x[n] @ v for n, v in zip(near, asked, strict=True)])
    width, most = near.shape[1], k + int(own.max())
    keep = np.ones(near.shape, dtype=bool)
    if width > most:
        keep = rough >= (np.partition(rough, width - most, axis=1)[:, width - most] - 1e-9 * (1 + np.abs(rough).max(axis=1)))[:, None]
    query, at = keep.nonzero()
    vector = near[query, at]
    score = (x[vector] * asked[query]).sum(axis=1)  # row by row, so that a pair has one score wherever it is computed
    sizes = np.minimum(np.diff(starts)[vector], k + own[query])
    spread = np.repeat(np.arange(len(vector)), sizes)
    vid, query, score = ids[starts[vector][spread] + np.arange(len(spread)) - np.repeat(np.cumsum(sizes) - sizes, sizes)], query[spread], score[spread]
    other = vid != qid[query]
    vid, query, score = vid[other], query[other], score[other]
    top = np.lexsort((vid, -score, query))
    top = top[np.arange(len(top)) - np.searchsorted(query[top], query[top]) < k]
    return query[top], vid[top], score[top]
