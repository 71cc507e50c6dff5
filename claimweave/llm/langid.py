"""Operator 2. Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (one to three letters, words padded by a
blank), by rank. A document's own most frequent n-grams are compared with each profile: every n-gram adds the
difference of its ranks, or the profile's length where the profile lacks it (out-of-place distance). The
language of the smallest distance wins. ``distance`` is that distance as a share of the largest that a text of at least
``SHORT`` n-grams can have, so that a short text, which tells little, is never far.

N-grams are packed exactly into 64-bit integers (21 bits a code point), counted with sorted arrays; per task
and language only counts leave a worker, in pieces of bounded size.

Defined results: a text that is null or has no letter gives ``und`` and score 0; equal distances go to the
smaller language name; with no profiles at all (no training rows) every document is ``und``; rows with a null
language are not learned from but are predicted; repeated rows give repeated results; whole texts are read; other columns are
kept, and columns called lang_pred, score or distance are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import forget, fresh, materialize

UNKNOWN = "und"
BLANK = 32
#: Counts that a worker holds for a language before it hands them on.
FLUSH = 400_000
#: N-grams that a text must have for a distance near 1.
SHORT = 50

_letter: np.ndarray | None = None


def letters_table() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letter


def grams(text: str) -> np.ndarray:
    """All n-grams of the padded words of a lower-cased text, packed; empty if there is no letter."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    c = np.where(letters_table()[c], c, BLANK)
    c = c[np.concatenate(([True], (c[1:] != BLANK) | (c[:-1] != BLANK)))]
    if len(c) < 3:
        return np.zeros(0, dtype=np.int64)
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate((c[c != BLANK], two, three[c[1:-1] != BLANK]))


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys, most frequent first, ties to the smaller key."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))[:size]]


def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(text, lang) to (lang, gram, n): counts, merged within the task."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out(lang: str) -> pd.DataFrame:
        keys, n = held.pop(lang)
        return pd.DataFrame({"lang": lang, "gram": keys, "n": n})

    for pdf in batches:
        for lang, texts in pdf.groupby("lang", sort=False)["text"]:
            for start in range(0, len(texts), 64):
                parts = [grams(t) for t in texts.iloc[start : start + 64]]
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                if lang in held:
                    both, where = np.unique(np.concatenate((held[lang][0], keys)), return_inverse=True)
                    keys, n = both, np.bincount(where, np.concatenate((held[lang][1], n))).astype(np.int64)
                held[lang] = (keys, n)
                if len(keys) > FLUSH:
                    yield out(lang)
    for lang in list(held):
        yield out(lang)


class RankOrderProfiles:
    """profile_size: n-grams of a profile and of a document that are compared; also the penalty of a missing one."""

    def __init__(self, profile_size: int = 400):
        self.size = profile_size
        self.profiles: dict[str, list[int]] = {}

    def fit(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", where: Column | None = None) -> RankOrderProfiles:
        """Learn from all rows that ``where`` allows. Only profile_size n-grams a language come to the driver."""
        rows = docs if where is None else docs.where(where)
        rows = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
        counts = rows.mapInPandas(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        counts = materialize(counts, "grams")
        # one plan for all languages: the limit on the rank is applied in each task before the shuffle too
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
        tops = counts.withColumn("rank", rank).where(F.col("rank") <= self.size).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("top"))
        self.profiles = {r["lang"]: [x["gram"] for x in r["top"]] for r in tops.orderBy("lang").collect()}
        forget(docs.sparkSession, counts)
        return self

    def predict(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with lang_pred, score and distance (null without a profile or a letter). score: how much nearer the best profile is than the second (0 to 1)."""
        profiles, size = self.profiles, self.size

        @F.pandas_udf("lang_pred string, score double, distance double")
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            judge = Judge(profiles, size)
            for texts in batches:
                yield pd.DataFrame([judge(t) for t in texts], columns=["lang_pred", "score", "distance"])

        rows = docs.drop("lang_pred", "score", "distance")
        (told,) = fresh(rows, "told")
        return rows.withColumn(told, predict(F.col(f"`{text_col}`").cast("string"))).select(*[F.col(f"`{c}`") for c in rows.columns], f"{told}.lang_pred", f"{told}.score", f"{told}.distance")


class Judge:
    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size, self.langs = size, sorted(profiles)
        self.tables = []
        for lang in self.langs:
            keys = np.array(profiles[lang], dtype=np.int64)
            order = np.argsort(keys)
            self.tables.append((keys[order], order))

    def __call__(self, text: str | None) -> tuple[str, float, float | None]:
        if text is None or not self.langs or not len(g := grams(text)):
            return UNKNOWN, 0.0, None
        mine = ranked(*np.unique(g, return_counts=True), self.size)
        far = []
        for keys, rank in self.tables:
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            far.append(int(np.where(keys[at] == mine, np.abs(rank[at] - np.arange(len(mine))), self.size).sum()))
        best = min(range(len(far)), key=lambda i: (far[i], self.langs[i]))
        rest = min((d for i, d in enumerate(far) if i != best), default=self.size * len(mine))
        return self.langs[best], (rest - far[best]) / rest if rest else 0.0, far[best] / (self.size * max(SHORT, len(mine)))
