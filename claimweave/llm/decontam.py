"""Operator 7. Benchmark decontamination by a positional inverted index, in DataFrame operations alone.

Terms are the runs of letters, digits and code points above 127 of an A-Z-lowered text. The index holds the
postings (term, document, position) of the training documents. A query phrase is answered from its rarest terms: their posting lists, each moved
back by the term's place in the phrase, are intersected; what is left is compared with the phrase in whole. Document
frequencies come from a pass over all documents; a phrase with a term that no document has is answered at once.

Postings are kept for the terms that some phrase is answered from (its ``rarest`` terms), which bounds the index by
what the queries can read. Documents are keyed by id and a hash of their text, and all
intermediate results are sets, so that repeated rows, ids and items change nothing but their own rows.

Defined results: null and wordless texts have no words, no hits and are not contaminated; items without words
or without an id take no part; without items every document is clean; items of one id and several texts count as one
item; each input row has one result row; other columns are kept, whatever their names, and columns called as a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import ascii_lower, bounded, fresh, materialize

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, RAREST = 13, 2


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BREAK), lambda w: w != "")


def broadcast_if(df: DataFrame, row_bytes: Column | None = None) -> DataFrame:
    """A hint only where the counted size allows; else Spark shuffles the join (and splits skewed parts of it)."""
    return F.broadcast(df) if bounded(df, row_bytes=row_bytes) else df


class PositionalIndex:
    """documents: (doc, hash, words) of the training side. phrases: (phrase, words) to be found in them."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        text = F.col(f"`{text_col}`").cast("string")
        self.docs = docs.select(F.col(f"`{id_col}`").alias("doc"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("hash"), text.alias("text")).withColumn("words", words_of(F.col("text")))

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """(term, df) of those terms that some document has."""
        every = self.docs.select(F.explode(F.array_distinct("words")).alias("term"))
        return every.join(broadcast_if(terms, F.length("term") + 32), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def postings(self, terms: DataFrame) -> DataFrame:
        """(doc, hash, pos, term) for these terms."""
        every = self.docs.select("doc", "hash", F.posexplode("words").alias("pos", "term"))
        return every.join(broadcast_if(terms, F.length("term") + 32), "term")

    def find(self, phrases: DataFrame, rarest: int = RAREST, window: int = WINDOW) -> DataFrame:
        """(doc, hash, phrase, starts, places): where windows of the phrases stand in the documents.

        phrases: (phrase long, words array). Every run of ``window`` words of a phrase counts (the whole phrase where it is shorter).
        starts: the windows' first words in the phrase; shift: document position of the phrase's first word.
        """
        n = F.size("words")
        places = phrases.where(n > 0).select("phrase", "words", F.explode(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))).alias("start"))
        places = places.withColumn("own", F.slice("words", F.col("start") + 1, window))
        offsets = places.select("phrase", "start", F.posexplode("own").alias("offset", "term"), F.size("own").alias("n"))
        terms = phrases.select(F.explode("words").alias("term")).distinct()
        known = offsets.join(self.frequencies(terms), "term").withColumn("at", F.struct("df", (F.col("start") + F.col("offset")).alias("at"), "term"))
        # a term that no document has leaves its windows out here
        chosen = known.groupBy("phrase", "start").agg(F.slice(F.sort_array(F.collect_list("at")), 1, rarest).alias("rare"), F.count(F.lit(1)).alias("has"), F.max("n").alias("n")).where("has = n").select("phrase", "start", "rare")
        chosen = materialize(chosen, "windows")  # of the benchmark's size; read twice
        lists = chosen.select("phrase", F.explode("rare").alias("r")).select(F.col("r.term").alias("term"), "phrase", F.col("r.at").alias("at")).distinct()
        lists = lists.groupBy("term").agg(F.collect_list(F.struct("phrase", "at")).alias("uses"))
        hits = self.postings(lists).select("doc", "hash", "pos", F.explode("uses").alias("u")).select("doc", "hash", "u.phrase", (F.col("pos") - F.col("u.at")).alias("shift"), "u.at")
        lined = hits.groupBy("doc", "hash", "phrase", "shift").agg(F.collect_set("at").alias("ats"))
        asks = chosen.groupBy("phrase").agg(F.collect_list(F.struct("start", F.col("rare.at").alias("need"))).alias("asks"))
        size = F.size("asks") * 40 + 64
        met = lined.join(broadcast_if(asks, size), "phrase")
        met = met.withColumn("starts", F.transform(F.filter("asks", lambda a: (a["start"] + F.col("shift") >= 0) & (F.size(F.array_except(a["need"], F.col("ats"))) == 0)), lambda a: a["start"]))
        met = met.where(F.size("starts") > 0).select("doc", "hash", "phrase", "shift", "starts")
        # what the rarest terms leave is compared whole. A document's candidates are written once, so that their size is known; they travel to its text where they are few,
        # and texts are shuffled only where they are not
        per_doc = materialize(met.groupBy("doc", "hash").agg(F.collect_list(F.struct("phrase", "shift", "starts")).alias("c")), "candidates")
        size = F.lit(64) + F.aggregate("c", F.lit(0), lambda n, x: n + 24 + 4 * F.size(x["starts"]))
        own = self.docs.select("doc", "hash", "text")
        met_docs = broadcast_if(per_doc.withColumnRenamed("doc", "c_doc").withColumnRenamed("hash", "c_hash"), size)
        seen = own.join(met_docs, F.col("doc").eqNullSafe(F.col("c_doc")) & (F.col("hash") == F.col("c_hash")))
        seen = seen.dropDuplicates(["doc", "hash"]).select("doc", "hash", words_of(F.col("text")).alias("words"), "c")
        # only the words around each candidate leave the document's row
        cut = F.transform("c", lambda c: F.struct(c["phrase"].alias("phrase"), c["shift"].alias("shift"), F.transform(c["starts"], lambda s: F.struct(s.alias("start"), F.slice(F.col("words"), s + c["shift"] + 1, window).alias("found"))).alias("starts")))
        cut = seen.select("doc", "hash", F.explode(cut).alias("c")).select("doc", "hash", "c.phrase", "c.shift", "c.starts")
        texts = phrases.select("phrase", F.col("words").alias("p_words"))
        same = lambda x: F.slice(x["found"], F.lit(1), F.least(F.size("p_words"), F.lit(window))) == F.slice(F.col("p_words"), x["start"] + 1, window)
        full = cut.join(broadcast_if(texts, F.size("p_words") * 16 + 64), "phrase").withColumn("starts", F.transform(F.filter("starts", same), lambda x: x["start"]))
        return full.where(F.size("starts") > 0).select("doc", "hash", "phrase", "shift", "starts", F.size("p_words").alias("n"))

    def near(self, first: str, second: str, within: int) -> DataFrame:
        """(doc, hash, a, b): occurrences of two terms at most ``within`` words apart (proximity search)."""
        spark = self.docs.sparkSession
        hits = self.postings(spark.createDataFrame([(first,), (second,)], "term string").distinct()).groupBy("doc", "hash").agg(
            F.sort_array(F.collect_list(F.when(F.col("term") == first, F.col("pos")))).alias("a"), F.sort_array(F.collect_list(F.when(F.col("term") == second, F.col("pos")))).alias("b"))
        close = lambda x, y: (x != y) & (F.abs(x - y) <= within)
        return hits.select("doc", "hash", F.explode("a").alias("a"), "b").select("doc", "hash", "a", F.explode(F.filter("b", lambda y: close(F.col("a"), y))).alias("b"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), words_of(F.col(f"`{item_text}`")).alias("words")).where("item is not null").where(F.size("words") > 0)
    by_text = items.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("phrase", F.xxhash64("words"))
    index = PositionalIndex(docs, id_col, text_col)
    # read twice below: written once, as the search passes over all documents
    found = materialize(index.find(by_text.select("phrase", "words"), window=window), "found")
    # positions inside any window: those of one line-up first, then those of the document
    run = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s + F.col("shift"), s + F.col("shift") + F.least(F.col("n"), F.lit(window)) - 1))))
    places = found.select("doc", "hash", F.explode(run).alias("pos")).distinct().groupBy("doc", "hash").agg(F.count(F.lit(1)).alias("n_hit"))
    names = by_text.select("phrase", "items")
    own = found.select("doc", "hash", "phrase").distinct().join(broadcast_if(names, F.size("items") * 24 + 64), "phrase")
    own = own.groupBy("doc", "hash").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    rows = docs.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    own_hash, h_doc, h_hash, h_n, h_items = fresh(rows, "hash", "h_doc", "h_hash", "h_n", "h_items")
    both = places.alias("p").join(own.alias("o"), F.col("p.doc").eqNullSafe(F.col("o.doc")) & (F.col("p.hash") == F.col("o.hash")))
    both = both.select(F.col("p.doc").alias(h_doc), F.col("p.hash").alias(h_hash), F.col("n_hit").alias(h_n), F.col("items").alias(h_items))
    both = broadcast_if(materialize(both, "hits"), F.size(h_items) * 24 + 64)
    text = F.col(f"`{text_col}`")
    # the words are counted before the join, so that the text goes through it only where it is asked for
    rows = rows.withColumns({own_hash: F.coalesce(F.xxhash64(text.cast("string")), F.lit(0)), "n_words": F.size(words_of(text)).cast("long")})
    joined = rows.join(both, F.col(f"`{id_col}`").eqNullSafe(F.col(h_doc)) & (F.col(own_hash) == F.col(h_hash)), "left")
    listed = F.coalesce(h_items, F.array().cast("array<string>"))
    return (
        joined.withColumn("n_hit", F.coalesce(h_n, F.lit(0)).cast("long"))
        .withColumn("n_items", F.size(listed).cast("long")).withColumn("items_sha256", F.sha2(F.array_join(listed, ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
        .drop(own_hash, h_doc, h_hash, h_n, h_items)
    )
