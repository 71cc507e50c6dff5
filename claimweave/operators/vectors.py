"""Stated queries against all vectors by cosine: blocks of queries meet blocks of rows, a pair of blocks a task, in numpy.

A sum runs over the components in their order, in doubles, so that equal vectors give equal figures wherever they stand. Searches leave a pair of blocks with its k best
alone; only who asks for all pairs gets them. A pair of vectors of different lengths, or with a null component, has no cosine and comes last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.operators.retrieve import dealt

#: Queries of a tile, so that its sums stay in a core's cache.
TILE = 64


def _matrix(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as columns, their norms); a vector with a null component (which pandas gives as nan) is told by its caller."""
    m = np.ascontiguousarray(np.stack(vectors.to_list()).astype("float64").T)
    return m, np.sqrt(_sum(m, m))


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[1:])
    part = np.empty_like(out)
    for x, y in zip(a, b, strict=True):
        np.multiply(x, y, out=part)
        out += part
    return out


def _tiles(q: pd.DataFrame, v: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]]:
    """(queries, rows, cosines, the key they are ordered by), a tile of queries at a time; no cosine is nan with the least key, a true nan has the largest."""
    v = v.sort_values("v", ignore_index=True)
    size = lambda d, c: np.where(d["whole"], d[c].map(len), -1).astype(int)
    ql, vl = size(q, "a"), size(v, "b")
    sides = {n: (np.flatnonzero(vl == n), *_matrix(v["b"][vl == n])) for n in np.unique(ql) if n > 0 and (vl == n).any()}
    for n in np.unique(ql):
        own = q[ql == n]
        for at in range(0, len(own), TILE):
            tile = own.iloc[at : at + TILE]
            cos, key = np.full((len(tile), len(v)), np.nan), np.full((len(tile), len(v)), -np.inf)
            if n in sides:
                where, m, norms = sides[n]
                a, mine = _matrix(tile["a"])
                with np.errstate(all="ignore"):
                    both = mine[:, None] * norms[None, :]
                    found = np.where(both == 0, 0.0, _sum(a[:, :, None], m[:, None, :]) / both)
                cos[:, where], key[:, where] = found, np.where(np.isnan(found), np.inf, found)
            if n >= 0 and (vl != n).any() or n == 0:
                # a vector of length 0 has the cosine 0 with any other, whatever their components
                zero = lambda c, whole: np.array([bool(w) and not np.square(np.asarray(x, dtype="float64")).sum() for x, w in zip(c, whole, strict=True)])
                level = (zero(tile["a"], tile["whole"])[:, None] & v["whole"].to_numpy(dtype=bool)[None, :]) | zero(v["b"], v["whole"])[None, :]
                cos[level] = key[level] = 0.0
            yield tile, v, cos, key


def _rows(tile: pd.DataFrame, v: pd.DataFrame, cos: np.ndarray, key: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    none = key[i, j] == -np.inf
    found = pd.Series(cos[i, j]) if not none.any() else pd.Series(np.where(none, None, cos[i, j]), dtype=object)
    return pd.DataFrame({"q": tile["q"].to_numpy()[i], "v": v["v"].to_numpy()[j], "cos": found, "same": (tile["ql"].to_numpy()[:, None] == v["vl"].to_numpy()[None, :])[i, j]})


def _blocks(queries: DataFrame, rows: DataFrame, f, schema: str, block: int) -> DataFrame:
    whole = lambda c: ~F.exists(c, lambda x: x.isNull())
    q, v = dealt(queries.withColumn("whole", whole("a")), "q", rows.withColumn("whole", whole("b")), "v", block)
    keys = ["_qb", "_rb"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [] if left.empty or right.empty else [f(t, *x) for t, *x in _tiles(left, right)]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(run, schema)


PAIR = "q long, v long, cos double, same boolean"


def pairs(queries: DataFrame, rows: DataFrame, block: int = 512) -> DataFrame:
    """(q, v, cos, same) of all pairs of queries (q, a, ql) and other rows (v, b, vl); same: of one label."""

    def every(tile, v, cos, key):
        i, j = np.nonzero(tile["q"].to_numpy()[:, None] != v["v"].to_numpy()[None, :])
        return _rows(tile, v, cos, key, i, j)

    return _blocks(queries, rows, every, PAIR, block)


def best(queries: DataFrame, rows: DataFrame, k: int, kind: str = "any", margin: float = 0.0, block: int = 2048) -> DataFrame:
    """Of every pair of blocks the k best pairs of each query, and any that are not farther than margin behind: among them are the k best of all. kind: 'any', 'same' or 'other' label."""

    def chosen(tile, v, cos, key):
        ok = tile["q"].to_numpy()[:, None] != v["v"].to_numpy()[None, :]
        if kind != "any":
            told = tile["ql"].notna().to_numpy()[:, None] & v["vl"].notna().to_numpy()[None, :]
            ok &= told & ((tile["ql"].to_numpy()[:, None] == v["vl"].to_numpy()[None, :]) == (kind == "same"))
        if key.shape[1] <= k:
            return _rows(tile, v, cos, key, *np.nonzero(ok))
        # rows stand by id, so of equal ones at the bound the first are enough
        by = np.where(ok, key, -np.inf)
        bound = np.partition(by, -k, axis=1)[:, -k][:, None]
        take = ok & (by > bound)
        room = k - take.sum(axis=1, keepdims=True)
        level = ok & (by == bound)
        take |= level & (np.cumsum(level, axis=1) <= room)
        if margin:
            take |= ok & (by >= bound - margin) & np.isfinite(bound)
        return _rows(tile, v, cos, key, *np.nonzero(take))

    return _blocks(queries, rows, chosen, PAIR, block)


def ahead(queries: DataFrame, rows: DataFrame, block: int = 2048) -> DataFrame:
    """(q, n): how many other rows come before a given one (queries with its cosine c, null where it has none, and id at), by cosine and then id."""

    def counted(tile, v, cos, key):
        c, at, ids = tile["c"].to_numpy(dtype="float64")[:, None], tile["at"].to_numpy()[:, None], v["v"].to_numpy()[None, :]
        c = np.where(tile["none"].to_numpy()[:, None], -np.inf, np.where(np.isnan(c), np.inf, c))
        before = (tile["q"].to_numpy()[:, None] != ids) & ((key > c) | ((key == c) & (ids < at)))
        return pd.DataFrame({"q": tile["q"].to_numpy(), "n": before.sum(axis=1)})

    return _blocks(queries.withColumn("none", F.col("c").isNull()), rows, counted, "q long, n long", block).groupBy("q").agg(F.sum("n").alias("n"))


def recall(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Recall of the rows of a query's label among its k best, and the mean reciprocal rank of the first of them, over all queries that have a pair."""
    from claimweave.operators.graph import written  # noqa: PLC0415
    from claimweave.operators.retrieve import top_k  # noqa: PLC0415

    label = lambda df, c: df.groupBy(F.col(c).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    # a query is among the rows, and no pair of its own
    own = queries.select("q", F.col("ql").alias("label")).join(rows.select(F.col("v").alias("q"), F.lit(1).alias("_in")).distinct(), "q", "left")
    relevant = own.join(F.broadcast(label(rows, "vl")), "label", "left").select("q", (F.coalesce("n", F.lit(0)) - F.when(F.col("label").isNotNull(), F.coalesce("_in", F.lit(0))).otherwise(0)).alias("relevant"))
    found = written(top_k(best(queries, rows, k), "q", "cos", "v", k).where("same").groupBy("q").agg(F.count(F.lit(1)).alias("found"), F.min("place").alias("first")))
    late = queries.join(found, "q", "left_anti")
    least = top_k(best(late, rows, 1, "same"), "q", "cos", "v", 1).select("q", F.col("cos").alias("c"), F.col("v").alias("at"))
    far = ahead(late.join(least, "q"), rows).select("q", F.lit(0).cast("long").alias("found"), (F.col("n") + 1).alias("first"))
    place: Column = F.coalesce(1 / F.col("first"), F.lit(0.0))
    return relevant.join(found.union(far), "q", "left").agg(F.round(F.avg(F.try_divide(F.coalesce("found", F.lit(0)), F.least("relevant", F.lit(k)))), 6).alias("recall"), F.round(F.avg(place), 6).alias("mrr"), F.count(F.lit(1)).alias("queries"))
