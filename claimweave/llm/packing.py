"""Operator 10. Best-fit packing into bins of several permitted sizes.

Documents longer than the largest size are cut into pieces of that size and a rest; every piece is packed whole. Rows
are dealt by hash to shards of bounded size. In a shard, pieces go, longest first, to the open bin with the least
room that still holds them; where none does, a new bin is opened. The permitted sizes are optimised jointly: the
shard is packed once for each opening policy (the cheapest size by the cost of a token where the piece fills it as often as it fits,
and each single size, raised where a piece needs more), every bin is then downsized to the least permitted size that holds its contents,
and the packing of least total cost is kept.

Defined results: documents of zero or null length are not packed and do not appear; ties go to the
older bin and the smaller (id, piece); repeated ids are packed as often as they occur, and repeats of one id and length are numbered and dealt to
different shards; a null id is packed as such; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import materialize

SIZES = (1024, 2048, 4096, 8192)
#: Pieces of a shard, about; bounds a task's memory at every table size.
SHARD = 8192
PLACED = "shard long, bin long, size int, filled int, doc_id long, piece int, n_pieces int, start long, length int, offset int"


def cost(size: int) -> float:
    """What a sequence of this length costs to train on: linear layers and attention."""
    return size * (1 + size / 32768)


def place(lengths: np.ndarray, sizes: tuple[int, ...], opening: int | None) -> tuple[np.ndarray, list[int]]:
    """Best fit of lengths (longest first). opening: the size of a new bin; None: the cheapest for what is still to come."""
    bin_of, room, made = np.zeros(len(lengths), dtype=np.int64), [], 0
    rooms: list[tuple[int, int]] = []
    for i, n in enumerate(lengths.tolist()):
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            left, b = rooms.pop(at)
        else:
            able = [s for s in sizes if s >= n]
            if opening is None:
                # the filling to expect: the piece itself as often as it fits, which what comes later (shorter) can only better
                size = min(able, key=lambda s: (cost(s) / (s // n * n), s))
            else:
                size = next((s for s in able if s >= opening), able[-1])
            left, b = size, made
            made += 1
            room.append(size)
        bin_of[i] = b
        if left > n:
            insort(rooms, (left - n, b))
    return bin_of, room


def pack(lengths: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each length, size of each bin after downsizing, filling of each bin) of the cheapest packing."""
    best = None
    for opening in (None, *sizes):
        bin_of, room = place(lengths, sizes, opening)
        filled = np.bincount(bin_of, lengths, len(room)).astype(np.int64)
        size = np.array(sizes)[np.searchsorted(sizes, filled)]
        total = sum(map(cost, size.tolist()))
        if best is None or total < best[0]:
            best = total, bin_of, size, filled
    return best[1:]


def best_fit(docs: DataFrame, length_col: str, id_col: str = "doc_id", sizes: tuple[int, ...] = SIZES, shard: int = SHARD) -> DataFrame:
    """One row a piece: shard, bin, size, filled, doc_id, piece, n_pieces, start, length, offset (in the bin)."""
    sizes = tuple(sorted(set(sizes)))
    top = sizes[-1]
    n = F.col("n")
    # written once and before any filter: the lengths are read again and again, and a function that gives them would run each time
    rows = materialize(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{length_col}`").cast("long").alias("n")), "lengths").where("n > 0")
    total = rows.agg(F.sum(F.ceil(n / top))).first()[0] or 0
    rows = rows.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("times")).select("doc_id", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    shards = max(1, -(-int(total) // shard))
    pieces = (
        rows.withColumn("n_pieces", F.ceil(n / top).cast("int"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
        .withColumn("start", F.col("piece").cast("long") * top)
        .withColumn("length", F.least(F.lit(top), n - F.col("start")).cast("int"))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length", "copy"), F.lit(shards)))
    )

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.lexsort((pdf["piece"], pdf["id"], pdf["known"], -pdf["length"]))].reset_index(drop=True)
        pdf["doc_id"] = pd.arrays.IntegerArray(pdf["id"].to_numpy(dtype=np.int64), ~pdf["known"].to_numpy(dtype=bool))
        bin_of, size, filled = pack(pdf["length"].to_numpy(dtype=np.int64), sizes)
        pdf = pdf.assign(bin=bin_of, size=size[bin_of], filled=filled[bin_of])
        pdf["offset"] = pdf.groupby("bin")["length"].cumsum() - pdf["length"]
        return pdf[[c.split()[0] for c in PLACED.split(", ")]]

    # a null id travels beside the others, which would else become floating
    return pieces.select("shard", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNotNull().alias("known"), "piece", "n_pieces", "start", "length").groupBy("shard").applyInPandas(one, PLACED)
