"""Operator 8. N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct word shingles (64-bit hashes of whole shingles). Documents of equal sets form one
class, known by the 64-bit digest of the set, and only classes are compared. A second digest tells where two sets share the first
one; then all is done again with other digests.

All shingles have one order, rare ones first: by a sketch of how many documents have them (2^22 counters over
all documents), then by hash. Any order gives the same links; a good one gives few candidates. With n shingles
and threshold t, the first n - ceil(t n) + l of two linked classes share at least l of them. Each
class chooses its l (1 to 4) by its estimated candidates: a longer prefix costs postings, but a pair must share
the smaller l of the two before it is verified. The first shingle that two linked classes share is among the first
n - ceil(t n) + 1 of both, so only these stand in posting lists; the longer prefixes of candidates are compared as such.

Candidates are verified in two steps, so that a large group of near copies does not become all its pairs. First every
member of a posting list meets the list's pivot, the class whose shared shingle comes earliest (the least changed copy).
Then, with the components of those links known, all pairs of a list that are still in different components are
candidates, whatever their number: within one component no further link can change the result. Length and position
bounds prune both; the pairs of a long list are dealt by blocks of the list. Sets are compared whole: those of candidates are made again from
their texts, which a bitmap of fixed size picks where they are read, so that no text is shuffled.

Defined results: null, empty and wordless texts have no shingles, link with nothing and are their own component;
component_id is the smallest non-null id of the component (null if all are null); repeated rows each
get their row; ids that repeat with other texts are judged by each text. Columns besides id and text play no part, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import bounded, forget, fresh, materialize

SKETCH_BITS, CHUNK = 22, 1 << 16
MOST_MATCHES = 4
#: Word hashes that a worker remembers.
MEMORY = 100_000
#: Bits of the bitmaps that pick the texts of candidates. Rows of a block of a posting list.
BITMAP, BLOCK = 1 << 26, 512
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]

SHIFT = np.uint64(64 - SKETCH_BITS)

_words: dict[bytes, int] = {}


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text; of the whole sequence where it is shorter."""
    if len(_words) > MEMORY:
        _words.clear()
    own = []
    for w in (text or "").encode().lower().split():  # on bytes: A-Z and the six blanks only
        if (h := _words.get(w)) is None:
            h = _words[w] = xxhash.xxh3_64_intdigest(w)
        own.append(h)
    if not own:
        return np.zeros(0, dtype=np.uint64)
    h = np.array(own, dtype=np.uint64)
    m = min(size, len(h))
    x = np.full(len(h) - m + 1, m, dtype=np.uint64)
    for i in range(m):
        x = (x + h[i : len(h) - m + 1 + i]) * _K[i % 3]
        x ^= x >> np.uint64(29 + i % 3)
    return np.unique(x)


def digest(own: np.ndarray, seed: int = 0) -> int:
    """Signed 64 bits, as Spark's long."""
    h = xxhash.xxh3_64_intdigest(own.tobytes(), seed)
    return h - (1 << 64) if h >> 63 else h


def threshold_count(n: int, num: int, den: int) -> int:
    """The least overlap of a set of n with any linked set."""
    return -(-num * n // den)


class JaccardJoin:
    """num/den: the least Jaccard similarity. shingle: words of a shingle."""

    def __init__(self, num: int = 90, den: int = 100, shingle: int = 3):
        self.num, self.den, self.shingle, self.seed = num, den, shingle, 0

    def sketch(self, texts: DataFrame) -> np.ndarray:
        """For each counter the logarithm of its count in eighths: 2^22 bytes, whatever the input."""
        size = self.shingle

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, held, rows = np.zeros(1 << SKETCH_BITS, dtype=np.int32), [], 0
            for pdf in batches:
                for text in pdf["text"]:
                    held.append((shingles(text, size) >> SHIFT).astype(np.int32))
                    rows += len(held[-1])
                    if rows > 1 << 21:
                        n += np.bincount(np.concatenate(held), minlength=len(n)).astype(np.int32)
                        held, rows = [], 0
            if held:
                n += np.bincount(np.concatenate(held), minlength=len(n)).astype(np.int32)
            for i in range(0, len(n), CHUNK):
                yield pd.DataFrame({"chunk": [i // CHUNK], "n": [zlib.compress(n[i : i + CHUNK].tobytes(), 1)]})

        def total(pdf: pd.DataFrame) -> pd.DataFrame:
            n = sum(np.frombuffer(zlib.decompress(b), dtype=np.int32).astype(np.int64) for b in pdf["n"])
            return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "n": [np.minimum(255, 8 * np.log2(1 + n)).astype(np.uint8).tobytes()]})

        parts = texts.mapInPandas(count, "chunk int, n binary").groupBy("chunk").applyInPandas(total, "chunk int, n binary")
        out = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
        for r in parts.collect():
            out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["n"], dtype=np.uint8)
        return out

    def postings(self, rows: DataFrame, sketch: np.ndarray) -> DataFrame:
        """Member rows (doc, k, n, again: the second digest) and, once a class and task, posting rows (k, token, meta), meta holding n, pos and need."""
        num, den, size, seed = self.num, self.den, self.shingle, self.seed
        shared = rows.sparkSession.sparkContext.broadcast(sketch)

        def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rare, seen = shared.value, set()
            for pdf in batches:
                for start in range(0, len(pdf), 256):
                    part = pdf.iloc[start : start + 256]
                    ks, ns, others, posts = [], [], [], []
                    for text in part["text"]:
                        own = shingles(text, size)
                        ks.append(k := digest(own, seed) if len(own) else None), ns.append(n := len(own)), others.append(digest(own, seed + 1))
                        if not n or k in seen:
                            continue
                        seen.add(k)
                        level = rare[(own >> SHIFT).astype(np.int64)]
                        prefix = n - threshold_count(n, num, den)
                        order = np.lexsort((own, level))[: prefix + MOST_MATCHES]
                        # a pair of classes that share a token costs a verification; the first shared ones weigh most
                        cost = 2.0 ** (level[order] / 8.0)
                        need = 1
                        while need < MOST_MATCHES and prefix + need < n and cost[prefix : prefix + need].mean() > 64 * need:
                            need += 1
                        order = order[: min(n, prefix + need)]
                        posts.append((np.full(len(order), k), own[order].view(np.int64), (n << 32) | (np.arange(len(order)) << 4) | min(need, n)))
                    yield pd.DataFrame({"member": True, "doc": part["doc"], "k": pd.array(ks, dtype="Int64"), "n": ns, "again": others, "token": None, "meta": None})
                    if posts:
                        k, token, meta = map(np.concatenate, zip(*posts, strict=True))
                        yield pd.DataFrame({"member": False, "doc": None, "k": k, "n": None, "again": None, "token": token, "meta": meta})

        return rows.mapInPandas(post, f"member boolean, doc {rows.schema['doc'].dataType.simpleString()}, k long, n int, again long, token long, meta long")

    def viable(self) -> Column:
        """Whether a token shared at pos and pos2 can be the first that two linked sets share: min(n - pos, n2 - pos2) bounds their overlap."""
        most = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
        return (self.num * F.greatest("n", "n2") <= self.den * F.least("n", "n2")) & (most * (self.num + self.den) >= self.num * (F.col("n") + F.col("n2")))

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets reach the threshold."""
        num, den = self.num, self.den

        @F.pandas_udf("boolean")
        def linked(a: pd.Series, b: pd.Series) -> pd.Series:
            out = []
            for x, y in zip(a, b, strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                out.append(den * both >= num * (len(x) + len(y) - both))
            return pd.Series(out, dtype="bool")

        # a class of very many pairs (the pivot of a large group) meets them in parts, each with a copy of its set; the sets of the
        # others come from the one shuffle by class that serves both sides
        hot = materialize(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).where("parts > 1"), "hot")
        own = lambda c: sets.select(F.col("k").alias(c), F.col("own").alias(f"own_{c}"))
        few = F.broadcast(hot) if bounded(hot) else hot
        most = pairs.join(few, "b", "left_anti").join(own("a"), "a").join(own("b"), "b")
        rest = pairs.join(few, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part")).join(own("a"), "a")
        copies = own("b").join(few, "b").select("b", "own_b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        out = [x.where(linked("own_a", "own_b")).select("a", "b") for x in (most, rest.join(copies, ["b", "part"]))]
        return out[0].union(out[1])

    def sets_of(self, rows: DataFrame, wanted: DataFrame) -> DataFrame:
        """(k, own) of the wanted classes (k, doc) and a few others, read again from the texts of their first documents."""
        size, seed = self.shingle, self.seed
        place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP))
        shared = rows.sparkSession.sparkContext.broadcast((bitmap(wanted.select(place("doc").alias("bit"))), bitmap(wanted.select(F.pmod("k", F.lit(BITMAP)).alias("bit")))))

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            docs, classes = shared.value
            seen = set()
            for pdf in batches:
                at = pdf["bit"].to_numpy()
                texts = pdf["text"].to_numpy()[(docs[at >> 3] >> (at & 7) & 1).astype(bool)]
                for start in range(0, len(texts), 256):
                    ks, sets = [], []
                    for t in texts[start : start + 256]:
                        if len(x := shingles(t, size)) and (k := digest(x, seed)) not in seen and classes[(bit := k % BITMAP) >> 3] >> (bit & 7) & 1:
                            seen.add(k), ks.append(k), sets.append(x.tobytes())
                    yield pd.DataFrame({"k": ks, "own": sets})

        # an id that repeats with another text gives a class that no pair asks for
        return rows.select(place("doc").alias("bit"), "text").mapInPandas(read, "k long, own binary").dropDuplicates(["k"])

    def components(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc, n_shingles, k (the class) and component_id, one row a document."""
        return self.rooted(docs, id_col, text_col).drop("root")

    def classified(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """members (doc, k, n), classes (k, doc: the least) and the postings (token, k, meta)."""
        sketch = self.sketch(rows.select("text"))
        while True:
            members, posts = materialize(self.postings(rows, sketch), "shingles", by="member")
            classes = materialize(members.where("k is not null").groupBy("k").agg(F.min("doc").alias("doc"), F.min("again").alias("low"), F.max("again").alias("high")), "classes")
            if not classes.where("low <> high").limit(1).count():
                return members.select("doc", "k", "n"), classes.select("k", "doc"), posts.select("token", "k", "meta")
            self.seed += 2

    def rooted(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """components() with the root of each: its least class. component_id is no key, as ids may be null or repeat."""
        spark = docs.sparkSession
        rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
        members, classes, heads = self.classified(rows)
        # one shuffle by token serves the lists and the join with them; lists of one class have no pair
        n, pos = F.shiftright("meta", 32), F.shiftright(F.col("meta").bitwiseAND(0xFFFFFFFF), 4)
        posts = heads.where(self.den * (n - pos) >= self.num * n).repartition("token")
        first = F.min(F.struct(F.col("meta").bitwiseAND(0xFFFFFFF0).alias("at"), "meta", "k"))
        lists = posts.groupBy("token").agg(first.alias("first"), F.min("k").alias("low"), F.max("k").alias("high")).where("low <> high").select("token", "first")
        posts = materialize(posts.join(lists, "token"), "lists")
        near = parted(posts.where("k <> first.k").select("k", "meta", F.col("first.k").alias("k2"), F.col("first.meta").alias("meta2")))
        near = materialize(near.where(self.viable()).select(F.col("k").alias("a"), F.col("k2").alias("b")).distinct(), "near")
        links = materialize(self.verified(near, self.fetch(rows, classes, near)), "links")
        root = connected(links)
        # what is left: pairs of one list in different components, by the bounds and the number of shared tokens
        lone = posts.join(root, "k", "left").select("token", "k", "meta", F.coalesce("root", "k").alias("root"))
        mixed = lone.groupBy("token").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("r1 <> r2").select("token", "blocks")
        # a table of its own, so that Spark can split a hot token's rows in the join
        mixed = materialize(mixed, "mixed")
        lone = materialize(parted(lone.join(mixed, "token")).drop("meta"), "lone")
        far = self.across(lone)
        tried = near.select(F.least("a", "b").alias("k"), F.greatest("a", "b").alias("k2"))
        far = materialize(far.join(tried, ["k", "k2"], "left_anti"), "across")
        if far.limit(1).count():
            far = materialize(self.sharing(far, heads), "far")
            links = materialize(links.union(self.verified(far, self.fetch(rows, classes, far))), "links")
            root = connected(links)
        best = classes.join(root, "k", "left").withColumn("root", F.coalesce("root", "k"))
        ids = materialize(best.groupBy("root").agg(F.min("doc").alias("component_id")), "ids")
        best = materialize(best.select("k", "root").join(ids, "root").select(F.col("k").alias("b_k"), "root", "component_id"), "best")
        for df in (posts, near, mixed, lone, heads, ids):
            forget(spark, df)
        out = members.where("k is not null").join(best, F.col("k") == F.col("b_k"))
        out = out.select("doc", F.col("n").cast("long").alias("n_shingles"), "k", "component_id", "root")
        none = F.lit(None).cast("long")
        return out.unionByName(members.where("k is null").select("doc", F.lit(0).cast("long").alias("n_shingles"), none.alias("k"), F.col("doc").alias("component_id"), none.alias("root")))

    def across(self, lone: DataFrame) -> DataFrame:
        """(k, k2, need): the viable pairs of a list in different components. Block i of a list meets block j in a group of its own."""
        block, other = F.pmod(F.xxhash64("k"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))
        left = lone.withColumn("i", block).withColumn("j", other)
        right = lone.withColumn("j", block).withColumn("i", other).select("token", "i", "j", *[F.col(c).alias(f"{c}2") for c in ("k", "n", "pos", "need", "root")])
        far = left.join(right, ["token", "i", "j"]).where((F.col("k") < F.col("k2")) & (F.col("root") != F.col("root2")) & self.viable())
        return far.select("k", "k2", F.least("need", "need2").alias("need")).distinct()

    def sharing(self, far: DataFrame, heads: DataFrame) -> DataFrame:
        """(a, b) of the pairs (k, k2, need) whose lengthened prefixes share so many tokens. A prefix is at most a share of its own set."""
        ks = far.select(F.explode(F.array("k", "k2")).alias("k")).distinct()
        heads = heads.join(F.broadcast(ks) if bounded(ks) else ks, "k", "left_semi").groupBy("k").agg(F.collect_set("token").alias("tokens"))
        far = far.join(heads, "k").join(heads.select(F.col("k").alias("k2"), F.col("tokens").alias("tokens2")), "k2")
        return far.where(F.size(F.array_intersect("tokens", "tokens2")) >= F.col("need")).select(F.col("k").alias("a"), F.col("k2").alias("b"))

    def fetch(self, rows: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
        return self.sets_of(rows, materialize(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct().join(classes, "k"), "wanted"))

    def keep_one(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """docs with one document of each component: that of the smallest id (null only where all are), of its classes the least, and of its repeated rows one.

        Ids that stand in one row are decided by their id alone; the rows of other ids, and of null, by id and class."""
        own = materialize(self.rooted(docs, id_col, text_col), "components")
        kept = own.where("k is not null").where(F.col("doc").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.first("component_id").alias("kept_doc"), F.min("k").alias("kept_k"))
        kept = materialize(kept, "kept")
        ids = own.groupBy("doc").agg(F.count(F.lit(1)).alias("times"), F.max("k").alias("k"), F.max("root").alias("root"))
        once = (F.col("times") == 1) & F.col("doc").isNotNull()
        gone = ids.where(once).join(kept, "root").where((F.col("kept_doc") != F.col("doc")) | (F.col("kept_k") != F.col("k"))).select("doc", F.lit(False).alias("odd"))
        i, odd, k, kd, kk = fresh(docs, "id", "odd", "class", "kept_id", "kept_class")
        told = materialize(gone.union(ids.where(~once).select("doc", F.lit(True))), "told").select(F.col("doc").alias(i), F.col("odd").alias(odd))
        told = F.broadcast(told) if bounded(told) else told
        same = F.col(f"`{id_col}`").eqNullSafe(F.col(i))
        stay = docs.join(told, same, "left_anti")
        size, seed = self.shingle, self.seed

        @F.pandas_udf("long")
        def class_of(texts: pd.Series) -> pd.Series:
            return pd.Series([digest(x, seed) if len(x := shingles(t, size)) else None for t in texts], dtype="Int64")

        again = docs.join(told.where(odd), same, "left_semi").withColumn(k, class_of(F.col(f"`{text_col}`").cast("string")))
        kept = kept.select(F.col("kept_doc").alias(kd), F.col("kept_k").alias(kk))
        first = again.where(F.col(k).isNotNull()).dropDuplicates([id_col, k]).join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col(kd)) & (F.col(k) == F.col(kk)), "left_semi")
        return stay.unionByName(first.drop(k)).unionByName(again.where(F.col(k).isNull()).drop(k))


def bitmap(bits: DataFrame) -> np.ndarray:
    """BITMAP bits as bytes, those of the rows (bit) set; its size does not grow with the rows."""
    chunk = 1 << 16

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(chunk, dtype=np.uint8)
        own[pdf["bit"].to_numpy() % chunk] = 1
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "own": [np.packbits(own, bitorder="little").tobytes()]})

    out = np.zeros(BITMAP // 8, dtype=np.uint8)
    for r in bits.distinct().withColumn("chunk", F.floor(F.col("bit") / chunk)).groupBy("chunk").applyInPandas(pack, "chunk long, own binary").collect():
        out[r["chunk"] * (chunk // 8) : (r["chunk"] + 1) * (chunk // 8)] = np.frombuffer(r["own"], dtype=np.uint8)
    return out


def parted(posts: DataFrame) -> DataFrame:
    """meta (and meta2) parted into n, pos and need."""
    for s in [c[4:] for c in posts.columns if c in ("meta", "meta2")]:
        m = F.col(f"meta{s}")
        posts = posts.withColumns({f"n{s}": F.shiftright(m, 32).cast("int"), f"pos{s}": F.shiftright(m.bitwiseAND(0xFFFFFFFF), 4).cast("int"), f"need{s}": m.bitwiseAND(15).cast("int")})
    return posts


def connected(links: DataFrame) -> DataFrame:
    """(k, root) of every class with a link: the least class it reaches. Labels go along links and then jump to their labels' label."""
    spark: SparkSession = links.sparkSession
    both = materialize(links.union(links.select("b", "a")).distinct().where("a <> b"), "both")
    label = materialize(both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).select("k", F.least("k", "m").alias("root")), "label")
    while True:
        near = both.join(label, both["b"] == label["k"]).groupBy("a").agg(F.min("root").alias("m"))
        step = materialize(label.join(near, label["k"] == near["a"]).select("k", F.col("root").alias("was"), F.least("root", "m").alias("mid")), "step")
        jump = step.select(F.col("k").alias("to"), F.col("mid").alias("end"))
        new = materialize(step.join(jump, F.col("mid") == F.col("to")).select("k", "was", F.least("mid", "end").alias("root")), "label")
        moved = new.where("root <> was").limit(1).count()
        forget(spark, step), forget(spark, label)
        label = new.select("k", "root")
        if not moved:
            forget(spark, both)
            return label


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return JaccardJoin().components(docs, id_col, text_col)
