"""Operator 12. Ranked lexical search by a bit-sliced impact index.

A term's impact in a document is an integer: its weight times its saturated, length-normalised frequency. The index of a block of documents holds for each term one bitmap a bit of
its impacts (bit slices over the documents of the block, in the order of their ids). A query's scores are the sum of its terms' slices by bitwise carry arithmetic, 64 documents a machine word; the k best come from the
sum's slices, the most significant first: the documents surely among the best, and those still tied with the k-th. Only these are decoded.

Two passes over the documents. The first counts documents, words, and the document frequencies of the queries' terms. The second builds the index block
by block and searches each block once for all queries; a task hands on the k best of each query among its documents, never more. Blocks are bounded by documents
and by postings, queries by the bytes of their texts (more queries are more passes). Slices hold only the bitmap words in which the term has documents.

Defined results: null and wordless texts are no documents of the collection; items without an id take no part; the texts of one item id are one query, each of its terms once; items without a known term have no rows;
repeated documents are ranked as often as they stand; documents without an id come last among equal scores; empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.words import as_bytes, words

BLOCK_DOCS, BLOCK_POSTINGS = 1 << 16, 1 << 21
#: Bytes of query texts that are answered in one pass.
QUERY_BYTES = 8 << 20
SHIFTS = np.arange(63, dtype=np.int64)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


class BlockIndex:
    """Bit slices of the impacts in one block. term, doc, impact: its postings; documents are numbered in the order of their ids."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int):
        self.words = -(-docs // 64)
        some = impact > 0
        order = np.lexsort((doc[some], term[some]))
        term, doc, impact = term[some][order], doc[some][order], impact[some][order]
        self.bits = int(impact.max()).bit_length() if len(impact) else 0
        word, bit = doc >> 6, np.uint64(1) << (doc & 63).astype(np.uint64)
        groups = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(word, prepend=-1))
        self.at = word[groups]  # the bitmap word of each group of postings
        self.slices = np.zeros((self.bits, len(groups)), dtype=np.uint64)
        for b in range(self.bits if len(groups) else 0):
            self.slices[b] = np.bitwise_or.reduceat(np.where((impact >> b) & 1, bit, np.uint64(0)), groups)
        known, first = np.unique(term[groups], return_index=True)
        self.span = dict(zip(known.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(groups)], strict=True), strict=True))

    def total(self, terms: list[int]) -> np.ndarray:
        """The slices of the terms' sum."""
        spans = [self.span[t] for t in terms if t in self.span]
        total = np.zeros((self.bits + len(spans).bit_length(), self.words), dtype=np.uint64)
        for first, end in spans:
            at = self.at[first:end]
            part, carry = total[:, at], np.zeros(end - first, dtype=np.uint64)
            for b, add in enumerate(self.slices[:, first:end]):
                half = part[b] ^ add
                both = part[b] & add
                part[b] = half ^ carry
                carry = both | (half & carry)
            for b in range(self.bits, len(part)):
                if not carry.any():
                    break
                part[b], carry = part[b] ^ carry, part[b] & carry
            total[:, at] = part
        return total


def best(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the k documents of the largest sums above 0; of equal sums the smaller numbers."""
    sure, tied = np.zeros(total.shape[1], dtype=np.uint64), np.bitwise_or.reduce(total, axis=0)
    if count(tied) > k:
        for row in total[::-1]:
            upper = tied & row
            n = count(sure) + count(upper)
            if n > k:
                tied = upper
                continue
            sure, tied = sure | upper, tied & ~row
            if n == k:
                break
    numbers = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
    found = numbers(sure)
    found = np.concatenate((found, numbers(tied)[: k - len(found)]))
    bits = (total[:, found >> 6] >> (found & 63).astype(np.uint64)) & np.uint64(1)
    return found, (bits.astype(np.int64) << SHIFTS[: len(total), None]).sum(axis=0)


class BitSlicedSearch:
    """base: the share of the length norm that no length changes, of 100."""

    def __init__(self, k: int = 50, base: int = 50, block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS, query_bytes: int = QUERY_BYTES):
        self.k, self.base, self.block_docs, self.block_postings, self.query_bytes = k, base, block_docs, block_postings, query_bytes

    def statistics(self, rows: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, list[int]]:
        """Documents with words, all their words, and the document frequency of each term."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have, docs, length = Counter(), 0, 0
            for batch in batches:
                for text in as_bytes(batch.column("text")):
                    own = words(text)
                    docs, length = docs + bool(own), length + len(own)
                    have.update(set(map(vocabulary.get, own)))
            have.pop(None, None)
            have[-1], have[-2] = docs, length
            yield pa.RecordBatch.from_pydict({"t": pa.array(list(have), pa.int32()), "n": pa.array(list(have.values()), pa.int64())})

        own = {r["t"]: r["n"] for r in rows.select("text").mapInArrow(part, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}
        return own.get(-1, 0), own.get(-2, 0), [own.get(t, 0) for t in range(len(vocabulary))]

    def answer(self, rows: DataFrame, queries: list[tuple[int, list[bytes]]]) -> DataFrame:
        """(item, doc, score): the k best of each query among the documents of each task."""
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in queries for t in own}))}
        n, length, df = self.statistics(rows, vocabulary)
        heavy = np.array([weight(n, d) if d else 0 for d in df], dtype=np.int64)
        asked = [(item, [i for t in own if heavy[i := vocabulary[t]] > 0]) for item, own in queries]
        k, base, most_docs, most_postings = self.k, self.base, self.block_docs, self.block_postings

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top: dict[int, list] = {}
            ids, sizes, norms, term, tf = [], array("q"), array("q"), array("i"), array("q")

            def search() -> None:
                """Indexes the block that has been gathered, and asks it."""
                order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)), dtype=np.int64)
                number = np.empty(len(ids), dtype=np.int64)
                number[order] = np.arange(len(ids))
                doc = np.repeat(np.arange(len(ids)), np.array(sizes))
                terms, freq = np.array(term, dtype=np.int64), np.array(tf)
                index = BlockIndex(terms, number[doc], heavy[terms] * saturation(freq, np.array(norms)[doc]), len(ids))
                for q, (_, own) in enumerate(asked):
                    found, score = best(index.total(own), k)
                    if len(found):
                        new = [(-s, i is None, i) for s, i in zip(score.tolist(), (ids[j] for j in order[found]), strict=True)]
                        top[q] = sorted(top.get(q, []) + new, key=lambda x: (x[0], x[1], x[2] or 0))[:k]
                ids.clear()
                for a in (sizes, norms, term, tf):
                    del a[:]

            for batch in batches:
                for i, text in zip(batch.column("id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                    own = words(text)
                    if not own:
                        continue
                    have = Counter(map(vocabulary.get, own))
                    have.pop(None, None)
                    if not have:
                        continue
                    ids.append(i), sizes.append(len(have)), norms.append(100 - base + base * len(own) * n // length)
                    term.extend(have.keys()), tf.extend(have.values())
                    if len(ids) >= most_docs or len(term) >= most_postings:
                        search()
            if ids:
                search()
            for q, found in top.items():
                yield pa.RecordBatch.from_pydict({
                    "item": pa.array([asked[q][0]] * len(found), pa.int64()), "doc": pa.array([x[2] for x in found], pa.int64()), "score": pa.array([-x[0] for x in found], pa.int64())})

        return rows.mapInArrow(run, "item long, doc long, score long")

    def search(self, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
        """item_id, rank, doc_id, score (by the names given): the k best documents of each item."""
        pick = lambda df, key, text: df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
        rows, own = pick(docs, id_col, text_col).where("text is not null"), pick(items, item_col, item_text).where("id is not null and text is not null")
        parts = max(1, math.ceil((own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / self.query_bytes))
        found = None
        for part in range(parts):
            queries: dict[int, dict[bytes, None]] = {}
            for r in own.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toLocalIterator():
                queries.setdefault(r["id"], {}).update(dict.fromkeys(words(r["text"].encode())))
            answers = self.answer(rows, [(i, list(t)) for i, t in sorted(queries.items())])
            found = answers if found is None else found.union(answers)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
        return found.withColumn("rank", rank).where(F.col("rank") <= self.k).select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
