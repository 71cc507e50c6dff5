"""Operator 5. Language-model scores by the likelihood of the subword lattice.

A text is its blank-separated words, each a lattice of all its segmentations into pieces of an existing
vocabulary, and one end. A piece has a unigram probability; the spelled probability of a word is the sum over all its
segmentations, by forward recursion in log space, with the chance that no further piece follows. Characters
without a piece of their own go through their byte pieces, so every text has a probability above zero.

A training word has one more arc, itself as a whole: P(word) = max(c - d, 0) / N + (d V / N) * P_spelled(word), c its count of N
training tokens of V types, d = n1 / (n1 + 2 n2) the discount that words seen once and twice suggest. What is discounted is
spelled, so all probabilities add up to one.

The vocabulary's own scores (ranks, of which the prior 1 / (rank + 100) follows) weight the pieces at first;
``rounds`` of expectation maximization over all training words, each counted once, then fit the weights to the corpus.

Data flow: workers count words (training and all) within their tasks, the counts are summed by word and written to
the shared folder. Words of more than 1/frequent of all tokens (fewer than ``frequent`` words, by that
definition) are broadcast and settled where the text is read; each other word goes with the rows that have it,
word by word as one list a batch, to its count and its lattice score.

Defined results: null counts as the empty text, which is one end; each row is scored for itself, repeated ids too; no training rows leave all counts 0 and the prior weights;
id columns may have any names, but one called as a result is left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from claimweave.llm.common import materialize
from claimweave.llm.tokens import MARK, default_model

#: Words that a worker counts before it hands the counts on; words that it weighs at once; tokens that it settles at once.
FLUSH, WEIGHED, SETTLED = 300_000, 60_000, 1_000_000
LN10 = math.log(10)
#: Code points of the dense transition table; others take the general way.
DENSE = 128
NONE = -1e300
#: The share of ends in what is spelled, for texts of no training word.
END = 1e-3
RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


class Lattice:
    """Pieces with log weights. score() and expect() take arrays of words."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(model_file, "rb") as f:
            spec = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        normal = [(i, p.piece) for i, p in enumerate(spec.pieces) if p.type == 1]
        self.size = len(spec.pieces)
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}
        self.end = next(i for i, p in enumerate(spec.pieces) if p.piece == "</s>")
        self.ids = {p: i for i, p in normal}
        self.longest = max(map(len, self.ids))
        chars = Counter(c for p in self.ids for c in p if c in self.ids)
        self.dense = {c: k + 1 for k, (c, _) in enumerate(chars.most_common(DENSE - 1))}
        rows, children, piece = [[-1] * DENSE], [{}], [-1]
        for p, i in self.ids.items():
            if all(c in self.dense for c in p):
                at = 0
                for c in p:
                    if (to := children[at].get(c)) is None:
                        to = children[at][c] = len(rows)
                        rows[at][self.dense[c]] = to
                        rows.append([-1] * DENSE), children.append({}), piece.append(-1)
                    at = to
                piece[at] = i
        # a state that follows no piece; from it nothing leads on
        self.next = np.array(rows, dtype=np.int32)
        self.piece = np.array(piece, dtype=np.int32)
        self.codes = np.zeros(0x3000, dtype=np.uint8)
        for c, k in self.dense.items():
            if ord(c) < len(self.codes):
                self.codes[ord(c)] = k

    def prior(self) -> np.ndarray:
        """log weights from the vocabulary's order: the first merges are the most frequent pieces."""
        p = np.zeros(self.size)
        for rank, i in enumerate(sorted(self.ids.values())):
            p[i] = 1 / (rank + 100)
        for i in self.bytes.values():
            p[i] = 1e-6
        p[self.end] = 1e-3
        return self.logs(p)

    def logs(self, p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.maximum(np.log(p / p.sum()), NONE)

    def maximize(self, expected: np.ndarray, smooth: float = 0.05) -> np.ndarray:
        """log weights from expected counts; every piece, byte and the end keeps a little."""
        able = np.zeros(self.size)
        able[[*self.ids.values(), *self.bytes.values(), self.end]] = smooth
        return self.logs(expected + able)

    def spelling(self, logs: np.ndarray) -> float:
        """What turns the sum over a word's segmentations into its probability: it starts with a mark, and then it stops."""
        p = np.exp(logs)
        start = sum(p[i] for t, i in self.ids.items() if t.startswith(MARK))
        further = sum(p[i] for t, i in self.ids.items() if not t.startswith(MARK)) + sum(p[i] for i in self.bytes.values())
        return math.log(max(1e-12, 1 - further)) - math.log(start)

    def groups(self, words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
        """Words of dense code points as (places, codes with the mark before), one group a length; the places of others."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = np.where(text < len(self.codes), self.codes[np.minimum(text, len(self.codes) - 1)], 0)
        starts = np.cumsum(sizes) - sizes
        odd = np.zeros(len(words), dtype=bool)
        odd[np.repeat(np.arange(len(words)), sizes)[code == 0]] = True
        odd |= sizes > 48
        mark, out = self.dense[MARK], []
        for n in np.unique(sizes[~odd]):
            at = np.flatnonzero((sizes == n) & ~odd)
            own = code[starts[at][:, None] + np.arange(n)[None, :]]
            out.append((at, np.concatenate((np.full((len(at), 1), mark, dtype=own.dtype), own), axis=1)))
        return out, np.flatnonzero(odd).tolist()

    def edges(self, code: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, rows, pieces) of a group, by the place where a piece begins and then its length."""
        n, found = code.shape[1], []
        for i in range(n):
            state, rows = np.zeros(len(code), dtype=np.int32), np.arange(len(code))
            for j in range(i, min(n, i + self.longest)):
                state = self.next[state, code[rows, j]]
                keep = state >= 0
                state, rows = state[keep], rows[keep]
                if not len(rows):
                    break
                p = self.piece[state]
                if len(has := np.flatnonzero(p >= 0)):
                    found.append((i, j + 1, rows[has], p[has]))
        return found

    def score(self, words: list[str], logs: np.ndarray) -> np.ndarray:
        """The natural log of each word's probability over all segmentations."""
        out = np.zeros(len(words))
        groups, odd = self.groups(words)
        for at, code in groups:
            out[at] = self.forward(self.edges(code), code, logs)[:, -1]
        for i in odd:
            out[i] = self.one(words[i], logs)
        return out

    def forward(self, edges: list, code: np.ndarray, logs: np.ndarray) -> np.ndarray:
        alpha = np.full((len(code), code.shape[1] + 1), NONE)
        alpha[:, 0] = 0
        for i, j, rows, piece in edges:
            alpha[rows, j] = np.logaddexp(alpha[rows, j], alpha[rows, i] + logs[piece])
        return alpha

    def one_edges(self, word: str) -> list[tuple[int, int, tuple[int, ...]]]:
        text, out = MARK + word, []
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + self.longest) + 1):
                if (p := self.ids.get(text[i:j])) is not None:
                    out.append((i, j, (p,)))
            if text[i] not in self.ids:
                out.append((i, i + 1, tuple(self.bytes[b] for b in text[i].encode("utf-8", "surrogatepass"))))
        return out

    def one(self, word: str, logs: np.ndarray, expected: np.ndarray | None = None, n: float = 1) -> float:
        edges, size = self.one_edges(word), len(word) + 2
        alpha = np.full(size, NONE)
        alpha[0] = 0
        weights = [sum(logs[p] for p in ps) for _, _, ps in edges]
        for (i, j, _), w in zip(edges, weights, strict=True):
            alpha[j] = np.logaddexp(alpha[j], alpha[i] + w)
        if expected is not None:
            beta = np.full(size, NONE)
            beta[-1] = 0
            for (i, j, _), w in zip(reversed(edges), reversed(weights), strict=True):
                beta[i] = np.logaddexp(beta[i], beta[j] + w)
            for (i, j, ps), w in zip(edges, weights, strict=True):
                for p in ps:
                    expected[p] += n * math.exp(min(0.0, alpha[i] + w + beta[j] - alpha[-1]))
        return float(alpha[-1])

    def expect(self, words: list[str], n: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """How often each piece occurs in n times each word, in expectation over the segmentations."""
        expected = np.zeros(self.size)
        groups, odd = self.groups(words)
        for at, code in groups:
            edges = self.edges(code)
            alpha = self.forward(edges, code, logs)
            beta = np.full_like(alpha, NONE)
            beta[:, -1] = 0
            for i, j, rows, piece in reversed(edges):
                beta[rows, i] = np.logaddexp(beta[rows, i], beta[rows, j] + logs[piece])
            for i, j, rows, piece in edges:
                share = np.exp(alpha[rows, i] + logs[piece] + beta[rows, j] - alpha[rows, -1])
                expected += np.bincount(piece, share * n[at[rows]], self.size)
        for i in odd:
            self.one(words[i], logs, expected, float(n[i]))
        return expected


_lattices: dict[str, Lattice] = {}


def lattice(model_file: str) -> Lattice:
    if model_file not in _lattices:
        _lattices[model_file] = Lattice(model_file)
    return _lattices[model_file]


def words_of(text: str) -> list[bytes]:
    """The words of a text, A-Z lowered: on bytes, lower() and split() know just these letters and these six blanks."""
    return text.encode().lower().split()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, train) to (word, train, n), summed within the task. The end of a text is the word ''."""
    held = {True: Counter(), False: Counter()}

    def out() -> Iterator[pa.RecordBatch]:
        for train, c in held.items():
            if c:
                word = pa.array(list(c), type=pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([word, pa.array([train] * len(c)), pa.array(list(c.values()), type=pa.int64())], ["word", "train", "n"])
                c.clear()

    for batch in batches:
        for text, train in zip(batch.column("text"), batch.column("train"), strict=True):
            c = held[train.as_py()]
            c.update(words_of(text.as_py()))
            c[b""] += 1
            if len(c) > FLUSH:
                yield from out()
    yield from out()


def gathered(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The same rows in larger batches."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= size:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


class SubwordLatticeModel:
    """rounds: of expectation maximization. frequent: words of more than 1/frequent of the tokens are settled where the text is."""

    def __init__(self, model_file: str | None = None, rounds: int = 2, frequent: int = 100_000):
        self.model_file, self.rounds, self.frequent = model_file or default_model(), rounds, frequent
        self.counts: DataFrame | None = None
        self.n_tokens = self.n_types = 0
        self.discount = 0.5
        self.logs = np.zeros(0)

    def fit(self, docs: DataFrame, train: Column, text_col: str = "text") -> SubwordLatticeModel:
        """Counts the words of all rows and learns from those that ``train`` marks."""
        text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
        rows = docs.select(text.alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
        counts = rows.mapInArrow(count_words, "word string, train boolean, n long").groupBy("word")
        own = F.coalesce(F.sum(F.when(F.col("train"), F.col("n"))), F.lit(0)).alias("c")
        self.counts = materialize(counts.agg(own, F.sum("n").alias("n")), "words")
        seen = lambda cond: F.count(F.when(cond, 1))
        self.n_tokens, self.n_types, once, twice = (int(x or 0) for x in self.counts.agg(F.sum("c"), seen(F.col("c") > 0), seen(F.col("c") == 1), seen(F.col("c") == 2)).first())
        self.discount = once / (once + 2 * twice) if once and twice else 0.5
        model_file = self.model_file
        self.logs = lattice(model_file).prior()
        for _ in range(self.rounds if self.n_tokens else 0):
            logs = self.logs

            def expect(batches: Iterator[pd.DataFrame], logs: np.ndarray = logs) -> Iterator[pd.DataFrame]:
                own, total = lattice(model_file), np.zeros(len(logs))
                for pdf in gathered(batches, WEIGHED):
                    total += own.expect(pdf["word"].tolist(), np.ones(len(pdf)), logs)
                at = np.flatnonzero(total)
                yield pd.DataFrame({"piece": at, "n": total[at]})

            # one number a piece of the vocabulary comes to the driver
            got = self.counts.where("c > 0 and word <> ''").select("word").mapInPandas(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
            total = np.zeros(len(logs))
            total[got["piece"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.float64)
            self.logs = lattice(model_file).maximize(total)
        return self

    def plain(self) -> SubwordLatticeModel:
        """The numbers alone, as they travel to the workers."""
        own = SubwordLatticeModel(self.model_file, self.rounds, self.frequent)
        own.n_tokens, own.n_types, own.discount = self.n_tokens, self.n_types, self.discount
        return own

    def mixed(self, spelled: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of words with these spelled log probabilities and training counts."""
        n, d = max(1, self.n_tokens), self.discount
        rest = d * self.n_types / n if self.n_tokens else 1.0
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(c - d, 0) / n)
        return np.logaddexp(whole, spelled + math.log(rest)) / LN10

    def score(self, docs: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
        """id_cols, n_tokens, n_known, train_tokens, base_score, score for the texts that fit() has counted."""
        names = [c for c in id_cols if c.lower() not in RESULTS]
        id_cols = [f"id{i}" for i in range(len(names))]
        docs = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, id_cols, strict=True)], F.col(f"`{text_col}`").alias("text"))
        n, v, logs, model_file = self.n_tokens, self.n_types, self.logs, self.model_file
        factor = lattice(model_file).spelling(logs) + math.log(1 - END)
        mixed = self.plain().mixed
        every = self.counts.agg(F.sum("n")).first()[0] or 0
        hot = self.counts.where((F.col("n") * self.frequent > every) & (F.col("word") != "")).toPandas()  # fewer than `frequent` words
        ends = self.counts.where("word = ''").select("c").first()
        words = hot["word"].tolist()
        hot_logs, hot_known = np.log10(hot["c"].to_numpy(dtype=np.float64) + 1), hot["c"].to_numpy() > 0
        hot_scores = mixed(lattice(model_file).score(words, logs) + factor, hot["c"].to_numpy(dtype=np.float64)) if words else np.zeros(0)
        end_c = int(ends[0]) if ends else 0
        end_score = float(mixed(np.array([math.log(END)]), np.array([end_c]))[0])
        shared = docs.sparkSession.sparkContext.broadcast(({w.encode(): i for i, w in enumerate(words)}, hot_logs, hot_known, hot_scores))
        kinds = list(docs.select(*id_cols).schema)
        schema = pa.schema([("word", pa.string()), ("key", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("row", pa.int64()), *[(f.name, to_arrow_type(f.dataType)) for f in kinds], ("tokens", pa.int64()), ("seen", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places, hot_logs, hot_known, hot_scores = shared.value
            n_hot = len(places)
            for batch in batches:
                texts, key, at = batch.column("text"), batch.column("key").to_numpy(), 0
                while at < len(texts):
                    own: list[list[bytes]] = []
                    tokens = 0
                    while at + len(own) < len(texts) and tokens < SETTLED:
                        own.append(words_of(texts[at + len(own)].as_py()))
                        tokens += len(own[-1])
                    here, size = slice(at, at + len(own)), np.array(list(map(len, own)), dtype=np.int64)
                    at += len(own)
                    # numbers of the words: the frequent ones first, then those of this part as they come
                    new = dict.fromkeys(chain.from_iterable(own))
                    number = {w: places[w] for w in places.keys() & new.keys()}
                    for w in number:
                        del new[w]
                    number.update(zip(new, range(n_hot, n_hot + len(new)), strict=True))
                    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(own)), dtype=np.int64, count=tokens)
                    both, times = np.unique(ids * len(own) + np.repeat(np.arange(len(own)), size), return_counts=True)
                    word, row = both // len(own), both % len(own)
                    cut = int(np.searchsorted(word, n_hot))
                    w, r, k = word[:cut], row[:cut], times[:cut]
                    add = lambda x: np.bincount(r, k * x, len(own))  # noqa: E731, B023
                    seen = add(hot_known[w]).astype(np.int64) + int(end_c > 0)
                    none = [pa.nulls(len(own), schema.field(i).type) for i in range(3)]
                    yield pa.RecordBatch.from_arrays([*none, pa.array(key[here]), *[batch.column(f.name)[here].cast(schema.field(f.name).type) for f in kinds], pa.array(size + 1), pa.array(seen), pa.array(add(hot_logs[w]) + math.log10(end_c + 1)), pa.array(add(hot_scores[w]) + end_score)], schema=schema)
                    if cut < len(word):
                        starts = np.concatenate(([0], np.flatnonzero(np.diff(word[cut:])) + 1, [len(word) - cut])).astype(np.int32)
                        text = pa.array(list(new), type=pa.binary()).cast(pa.string())
                        lists = [pa.ListArray.from_arrays(pa.array(starts), pa.array(v)) for v in (key[here][row[cut:]], times[cut:].astype(np.int32))]
                        yield pa.RecordBatch.from_arrays([text, *lists, *[pa.nulls(len(text), f.type) for f in list(schema)[3:]]], schema=schema)

        def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = lattice(model_file)
            for pdf in gathered(batches, WEIGHED):
                yield pd.DataFrame({"w": pdf["word"], "c": pdf["c"], "s": mixed(own.score(pdf["word"].tolist(), logs) + factor, pdf["c"].to_numpy(dtype=np.float64))})

        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        # the numbers of the rows hold from the moment that the table below is written
        rows = docs.select(*id_cols, F.monotonically_increasing_id().alias("key"), text.alias("text"))
        listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
        made = rows.mapInArrow(settle, f"word string, key array<long>, times array<int>, row long, {listed}, tokens long, seen long, base double, score double")
        made = materialize(made, "postings")
        weighed = self.counts.where(F.col("word") != "").where(F.col("n") * self.frequent <= every).select("word", "c").mapInPandas(weigh, "w string, c long, s double")
        posts = made.where("word is not null").select("word", "key", "times").join(weighed, F.col("word") == F.col("w"))
        each = posts.select(F.explode(F.arrays_zip("key", "times")).alias("p"), "c", "s").select(
            F.col("p.key").alias("row"), *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in id_cols], F.lit(0).cast("long").alias("tokens"), F.when(F.col("c") > 0, F.col("p.times")).otherwise(0).cast("long").alias("seen"),
            (F.col("p.times") * F.log10(F.col("c") + 1)).alias("base"), (F.col("p.times") * F.col("s")).alias("score"))
        heads = made.where("row is not null").select("row", *id_cols, "tokens", "seen", "base", "score")
        sums = each.unionByName(heads).groupBy("row").agg(*[F.max(c).alias(c) for c in id_cols], *[F.sum(c).alias(c) for c in ("tokens", "seen", "base", "score")])
        return sums.select(
            *[F.col(i).alias(c) for c, i in zip(names, id_cols, strict=True)], F.col("tokens").alias("n_tokens"), F.col("seen").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") - F.col("tokens") * math.log10(n + v + 1)).alias("base_score"), "score")
