"""Exact substring search: which texts hold a quote, wherever it begins and ends, by words where it has whole ones and by grams of characters where it has none."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions import text
from claimweave.operators.graph import cut
from claimweave.operators.sizes import small

#: Characters of a gram (three fit into 63 bits); the words of a quote that are looked up (its longest); quotes that are sent to the texts at once.
GRAM, WORDS, QUOTES = 3, 4, 100_000


def codes(chars: np.ndarray, n: int) -> np.ndarray:
    """Every run of n characters as one number; runs of other lengths have other numbers."""
    out = np.zeros(max(0, len(chars) - n + 1), dtype="int64")
    for i in range(n if len(out) else 0):
        out |= (chars[i : len(chars) - n + 1 + i].astype("int64") + 1) << 21 * i
    return out


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the code points of texts, one behind the other, and the number of the text of each). Between two texts stands what no text can have."""
    chars = np.frombuffer("".join(t + "\U0010ffff" for t in texts).encode("utf-32-le"), dtype="uint32").copy()
    size = np.array([len(t) + 1 for t in texts], dtype="int64")
    chars[np.cumsum(size) - 1] = 0x110000
    return chars, np.repeat(np.arange(len(texts)), size)


def met(texts: list[str], grams: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram): by number, which of the grams (sorted) each text has, once each. A table of bits tells most runs before they are looked up."""
    chars, owner = characters(texts)
    bits = lambda x: ((x * np.int64(-7046029254386353131)) >> 44) & 0xFFFFF
    some = np.zeros(1 << 20, dtype=bool)
    some[bits(grams)] = True
    found = []
    for n in sizes:
        own = codes(chars, n)
        at = np.flatnonzero(some[bits(own)])
        place = np.minimum(np.searchsorted(grams, own[at]), len(grams) - 1)
        at, place = (x[grams[place] == own[at]] for x in (at, place))
        found.append(owner[at] * len(grams) + place)
    both = np.unique(np.concatenate(found))
    return both // len(grams), both % len(grams)


def parts(batches: Iterator[pd.DataFrame], most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Batches cut into pieces of about so many characters of their texts (body)."""
    for b in batches:
        yield from (x for _, x in b.groupby(b["body"].str.len().cumsum() // most, sort=False))


def by_grams(quotes: DataFrame, bodies: DataFrame) -> DataFrame:
    """(quote, doc): texts (doc, body) that hold a quote, met by the quote's rarest gram and told by the text itself. A quote shorter than a gram is its own gram.

    Grams are numbers of numpy in batches of texts: how many texts have each is counted in one pass, and a second finds the texts. Quotes go to the texts QUOTES at a time.
    """
    own = cut(quotes.select("quote").where("quote <> ''").distinct())
    n = own.count() // QUOTES + 1
    return reduce(DataFrame.unionByName, [_by_grams(own if n == 1 else own.where(F.pmod(F.xxhash64("quote"), F.lit(n)) == i), bodies) for i in range(n)])


def _by_grams(quotes: DataFrame, bodies: DataFrame) -> DataFrame:
    asked = [r["quote"] for r in quotes.collect()]
    runs = [codes(characters([q])[0][:-1], min(GRAM, len(q))) for q in asked]
    grams = np.unique(np.concatenate([np.empty(0, dtype="int64"), *runs]))
    sizes = sorted({min(GRAM, len(q)) for q in asked})
    told = bodies.where("body is not null").select("doc", "body")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(grams), dtype="int64")
        for b in parts(batches):
            n += np.bincount(met(b["body"].to_list(), grams, sizes)[1], minlength=len(grams))
        yield pd.DataFrame({"gram": grams[n > 0], "n": n[n > 0]})

    df = np.zeros(len(grams), dtype="int64")
    if asked:
        for r in told.select("body").mapInPandas(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most the quotes' own grams
            df[np.searchsorted(grams, r["gram"])] = r["n"]
    places = [np.searchsorted(grams, r) for r in runs]
    # a quote with a gram that no text has is in none
    rarest = [(q, p[np.argmin(df[p])]) for q, p in zip(asked, places, strict=True) if df[p].all()]
    anchors = np.unique(np.array([p for _, p in rarest], dtype="int64"))
    by = [[] for _ in anchors]
    for q, p in rarest:
        by[np.searchsorted(anchors, p)].append(q)
    keys = grams[anchors]

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts(batches):
            texts, docs = b["body"].to_list(), b["doc"].to_list()
            hits = [(q, docs[i]) for i, g in zip(*(x.tolist() for x in met(texts, keys, sizes)), strict=True) for q in by[g] if q in texts[i]] if len(keys) else []
            yield pd.DataFrame(hits, columns=["quote", "doc"])

    return told.mapInPandas(held, f"quote string, doc {bodies.schema['doc'].dataType.simpleString()}").distinct()


def by_words(quotes: DataFrame, bodies: DataFrame) -> DataFrame:
    """(quote, doc): texts with the rarest of the quote's longest whole words (terms). The texts are taken apart once: what they have of the words asked for is kept."""
    asked = cut(quotes.select("quote", F.explode(F.slice(F.transform(F.array_sort(F.transform("terms", lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t")))), lambda x: x["t"]), 1, WORDS)).alias("token")))
    names = small(cut(asked.select("token").distinct()), F.length("token") + 32)
    hits = cut(bodies.select("doc", F.explode(F.array_distinct(text.tokens(F.col("body")))).alias("token")).join(names, "token"))
    frequency = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rarest = asked.join(frequency, "token", "left").groupBy("quote").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("r")).where("r.df > 0").select("quote", F.col("r.token").alias("token"))
    return hits.join(small(cut(rarest), F.length("quote") + 64), "token").select("quote", "doc")


def holding(quotes: DataFrame, bodies: DataFrame) -> DataFrame:
    """(quote, doc): the texts (doc, body) that hold each quote (quote), character by character. Empty and null quotes and texts meet nothing; copies of a doc's row answer once.

    Only words with a blank of the quote on either side are whole words of a text that holds it; the first and the last can be parts of longer ones.
    """
    words = F.split("quote", " ")
    inner = F.concat_ws(" ", F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))
    own = cut(quotes.select("quote").where("quote <> ''").distinct().withColumn("terms", F.array_distinct(text.tokens(inner))))
    worded, bare = own.where(F.size("terms") > 0), own.where(F.size("terms") == 0)
    out = []
    if worded.limit(1).count():
        pairs = small(cut(by_words(worded, bodies).distinct()), F.length("quote") + 64)
        out.append(bodies.join(pairs, "doc").where(F.contains("body", F.col("quote"))).select("quote", "doc").distinct())
    if bare.limit(1).count() or not out:
        out.append(by_grams(bare, bodies))
    return reduce(DataFrame.unionByName, out)
