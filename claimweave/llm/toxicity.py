"""Operator 6. Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their beginnings of three to seven letters, hashed into a fixed space, and of each
beginning also that two, or four, different words of the text have it; a text has a term or not. The machine is  bias + sum w_i + sum_{i<j} <v_i, v_j>  through the logistic function, so that
two terms together (an insult with a group mention) can weigh more, or less, than each alone.

Terms are hashed for many words at once, in arrays of a bounded number of words; a worker keeps nothing from text to text.

Fitting: how many labelled texts of each class have each hashed term is counted over all labelled rows; the
``features`` terms that tell most about the label enter the machine. Its weights are learned by AdaGrad on a bounded
sample of labelled texts (``sample`` different ones of each class, those of the smallest hash), of which only the
numbers of their terms come to the driver. Class weights undo the sample's other share of labels.

Defined results: null and empty texts have no term and get the bias alone; texts are read whole; without labelled
rows every score is as good as 0 (e^-50); with labels of one class every score is the smoothed share of that class; rows of repeated ids
are scored each for itself; rows whose label is null are not learned from, and copies of a text are learned from once;
other columns are kept, and a column called score or predicted is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import forget, materialize

#: Letters: A-Z, a-z and all code points from 128 on but those of the blocks of signs.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SIGNS = re.compile("[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u2000-\u2bff\u3000-\u303f\ufe30-\ufe4f\uff00-\uff20]")
#: Words that are hashed at once, about.
PART = 100_000
#: Lengths of beginnings, and how many words with one make a term of their own.
BEGINNINGS, LEVELS = (3, 4, 5, 6, 7), (2, 4)
_K, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> set[bytes]:
    """The different words of a text, lower-cased."""
    if not text:
        return set()
    if not (text := text.lower()).isascii():
        text = SIGNS.sub(" ", text)
    return set(text.encode("utf-8", "surrogatepass").translate(LETTERS).split())


def level_term(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (h * np.uint64(0x9E3779B1) + np.uint64(level * 0x85EBCA6B)) >> np.uint64(7) & np.uint64((1 << bits) - 1)


def hashes(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its hash, and of its beginnings (word number, hash)."""
    c = np.frombuffer(b" ".join(words).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blanks = np.flatnonzero(c == 32)
    starts, ends = np.concatenate(([0], blanks + 1)), np.concatenate((blanks, [len(c)]))
    size, cut = ends - starts, np.uint64(64 - bits)
    c = np.concatenate((c, np.full(BEGINNINGS[-1], 32, dtype=np.uint32))).astype(np.uint64)
    h, number, found = np.full(len(words), 7, dtype=np.uint64), [], []
    for j in range(BEGINNINGS[-1]):
        h = (h + c[starts + j]) * _K
        h ^= h >> np.uint64(29)
        if j + 1 in BEGINNINGS:
            number.append(at := np.flatnonzero(size > j + 1))
            found.append(h[at] * _M >> cut)
    power = np.full(int(size.max()) + 1, _K, dtype=np.uint64).cumprod()
    place = np.arange(len(c) - BEGINNINGS[-1]) - np.repeat(starts, np.append(np.diff(starts), size[-1]))
    c = np.where(c == 32, np.uint64(0), c)[: len(place)]
    whole = np.add.reduceat(c * power[place], starts)
    whole ^= whole >> np.uint64(31)
    return whole * _M >> cut, np.concatenate(number), np.concatenate(found)


class Terms:
    """The hashed terms of texts; ``among``: only these, renumbered by their place."""

    def __init__(self, bits: int, among: np.ndarray | None = None):
        self.bits, self.place = bits, None
        if among is not None:
            every = np.arange(1 << bits, dtype=np.uint64)
            self.place = np.full(1 << bits, -1, dtype=np.int32)
            self.place[among] = np.arange(len(among), dtype=np.int32)
            self.by_level = [self.place[level_term(every, n, bits)] for n in LEVELS]
            self.counted = np.any([x >= 0 for x in self.by_level], axis=0)

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Parts of the texts, and for each the pairs (number of the text in the part, term), once each and in order."""
        held, words, first = [], 0, 0
        for i, text in enumerate(texts, 1):
            held.append(own := words_of(text))
            words += len(own)
            if words >= PART or i == len(texts):
                yield slice(first, i), *self.of_part(held)
                held, words, first = [], 0, i

    def of_part(self, sets: list[set[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets), dtype=np.uint64), list(map(len, sets)))
        if not len(row):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        shift, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        whole, number, found = hashes(list(chain.from_iterable(sets)), self.bits)
        rows, terms = [row, row[number]], [whole, found]
        counted = slice(None) if self.place is None else self.counted[found]
        keys, n = np.unique(row[number][counted] << shift | found[counted], return_counts=True)
        for k, least in enumerate(LEVELS):
            rows.append((own := keys[n >= least]) >> shift)
            terms.append(level_term(own & mask, least, self.bits) if self.place is None else self.by_level[k][own & mask])
        if self.place is not None:
            terms[:2] = [self.place[t] for t in terms[:2]]
            kept = [t >= 0 for t in terms]
            rows, terms = [r[k] for r, k in zip(rows, kept, strict=True)], [t[k].astype(np.uint64) for t, k in zip(terms, kept, strict=True)]
        keys = np.unique(np.concatenate(rows) << shift | np.concatenate(terms))
        return (keys >> shift).astype(np.int64), (keys & mask).astype(np.int64)


def gain(a: Column, b: Column, n0: float, n1: float) -> Column:
    """Information gain of a term about the label: a of n0 texts of label 0 have it, b of n1 of label 1."""
    def entropy(x: Column, y: Column) -> Column:
        p, q = x / (x + y), y / (x + y)
        return -(p * F.log(p) + q * F.log(q))

    has, lacks = (a + 0.25, b + 0.25), (F.lit(n0 + 0.25) - a, F.lit(n1 + 0.25) - b)
    share = (a + b + 0.5) / (n0 + n1 + 1)
    return entropy(F.lit(n0 + 0.5), F.lit(n1 + 0.5)) - share * entropy(*has) - (1 - share) * entropy(*lacks)


class FactorizationMachine:
    """bits: size of the hashed space. features: terms that enter. factors: length of v. sample: the most rows of each class that are learned from."""

    def __init__(self, bits: int = 20, features: int = 4096, factors: int = 8, sample: int = 12_000, epochs: int = 24, rate: float = 0.1, l2: float = 1e-5, seed: int = 7):
        self.bits, self.n_features, self.factors, self.sample = bits, features, factors, sample
        self.epochs, self.rate, self.l2, self.seed = epochs, rate, l2, seed
        self.terms = np.zeros(0, dtype=np.int64)
        self.bias, self.w, self.v = -50.0, np.zeros(0), np.zeros((0, factors))

    def fit(self, docs: DataFrame, text_col: str = "text", label_col: str = "toxic", where: Column | None = None) -> FactorizationMachine:
        rows = (docs if where is None else docs.where(where)).select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
        bits = self.bits

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            terms, n = Terms(bits), np.zeros((1 << bits, 2), dtype=np.int64)
            total = np.zeros(2, dtype=np.int64)
            for pdf in batches:
                y = pdf["y"].to_numpy(dtype=np.int64)
                total += np.bincount(y, minlength=2)
                for part, row, term in terms(pdf["text"].tolist()):
                    for label in (0, 1):
                        n[:, label] += np.bincount(term[y[part][row] == label], minlength=1 << bits)
            h = np.flatnonzero(n.any(axis=1))
            yield pd.DataFrame({"h": [-1, *h], "n0": [total[0], *n[h, 0]], "n1": [total[1], *n[h, 1]]})

        counts = rows.mapInPandas(count, "h long, n0 long, n1 long").groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        counts = materialize(counts, "terms")  # at most 2^bits rows; only the best of them come to the driver
        n = np.array(counts.where("h = -1").agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first(), dtype=np.float64)
        if not n.all():
            self.bias = math.log((n[1] + 0.5) / (n[0] + 0.5)) if n.any() else -50.0
            return self
        best = counts.where("h >= 0").select("h", F.round(gain(F.col("n0"), F.col("n1"), *n.tolist()), 12).alias("g")).orderBy(F.desc("g"), "h").limit(self.n_features).collect()
        self.terms = np.sort(np.array([r["h"] for r in best], dtype=np.int64))
        forget(docs.sparkSession, counts)
        self.learn(*self.drawn(rows, n), n)
        return self

    def drawn(self, rows: DataFrame, n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The term numbers and labels of the sample."""
        bits, among, kind = self.bits, self.terms, np.uint16 if len(self.terms) <= 1 << 16 else np.uint32

        @F.pandas_udf("binary")
        def numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            terms = Terms(bits, among)
            for texts in batches:
                out = []
                for part, row, term in terms(texts.tolist()):
                    size = part.stop - part.start
                    out += [x.tobytes() for x in np.split(term.astype(kind), np.searchsorted(row, np.arange(1, size)))]
                yield pd.Series(out, dtype=object)

        # hashes alone tell which texts are drawn; only these are parted into terms
        keyed = rows.select("y", "text", F.xxhash64("text").alias("h"))
        last = [keyed.where(F.col("y") == y).select("h").distinct().orderBy("h").limit(self.sample).agg(F.max("h")).first()[0] for y in (0, 1)]
        drawn = keyed.where(F.col("h") <= F.when(F.col("y") == 1, last[1]).otherwise(last[0])).groupBy("y", "h").agg(F.first("text").alias("text"))
        got = drawn.select("y", "h", numbers("text").alias("x")).orderBy("y", "h").collect()
        return [np.frombuffer(r["x"], dtype=kind) for r in got], np.array([r["y"] for r in got], dtype=np.float64)

    def learn(self, xs: list[np.ndarray], y: np.ndarray, n: np.ndarray) -> None:
        rng = np.random.default_rng(self.seed)
        k, size = self.factors, len(self.terms)
        w, v, b = np.zeros(size), rng.normal(0, 0.02, (size, k)), math.log(n[1] / n[0])
        gw, gv, gb = np.full(size, 1e-6), np.full((size, k), 1e-6), 1e-6
        weight = np.where(y == 1, n[1] / max(1, (y == 1).sum()), n[0] / max(1, (y == 0).sum()))
        weight /= weight.mean()
        for _ in range(self.epochs):
            order = rng.permutation(len(xs))
            for start in range(0, len(order), 256):
                rows = order[start : start + 256]
                size_of = np.array([len(xs[i]) for i in rows])
                idx = np.concatenate([xs[i] for i in rows]).astype(np.int64)
                row = np.repeat(np.arange(len(rows)), size_of)
                total = np.zeros((len(rows), k))
                if len(idx):
                    own = v[idx]
                    total = np.stack([np.bincount(row, own[:, f], len(rows)) for f in range(k)], axis=1)
                    z = b + np.bincount(row, w[idx], len(rows)) + 0.5 * ((total**2).sum(axis=1) - np.bincount(row, (own**2).sum(axis=1), len(rows)))
                else:
                    z = np.full(len(rows), b)
                d = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[rows])
                gb += float(d.sum()) ** 2 / len(rows) ** 2
                b -= self.rate * float(d.mean()) / math.sqrt(gb)
                if not len(idx):
                    continue
                uniq, inv = np.unique(idx, return_inverse=True)
                g = np.bincount(inv, d[row]) / len(rows) + self.l2 * w[uniq]
                gw[uniq] += g**2
                w[uniq] -= self.rate * g / np.sqrt(gw[uniq])
                each = d[row, None] * (total[row] - own)
                g = np.stack([np.bincount(inv, each[:, f]) for f in range(k)], axis=1) / len(rows) + self.l2 * v[uniq]
                gv[uniq] += g**2
                v[uniq] -= 0.2 * self.rate * g / np.sqrt(gv[uniq])
        self.w, self.v, self.bias = w, v, b

    def predict(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with score (0 to 1) and predicted (1 from a score of 0.5 on)."""
        bits, among, w, v, bias = self.bits, self.terms, self.w, self.v, self.bias
        square = (v**2).sum(axis=1)

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            terms = Terms(bits, among)
            for texts in batches:
                z = np.zeros(len(texts))
                for part, row, x in terms(texts.tolist()):
                    add = lambda a, row=row, n=part.stop - part.start: np.bincount(row, a, n)
                    total = sum(add(v[x, f]) ** 2 for f in range(v.shape[1]))
                    z[part] = bias + add(w[x]) + 0.5 * (total - add(square[x]))
                yield pd.Series(1 / (1 + np.exp(-np.clip(z, -50, 50))))

        rows = docs.drop("score", "predicted")
        return rows.withColumn("score", score(F.col(text_col).cast("string"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
