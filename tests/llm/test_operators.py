"""Each operator against a brute-force version, and on nulls, empty, very long, tied and repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm.ann import InvertedFiles, PermutationIndex, permutations
from claimweave.llm.bitsliced import BitSlicedSearch, BlockIndex, best
from claimweave.llm.decontam import PositionalIndex, decontaminate
from claimweave.llm.exponion import Centroids, ExponionKMeans, squared
from claimweave.llm.jaccard import JaccardJoin
from claimweave.llm.langid import RankOrderProfiles
from claimweave.llm.licenses import PHRASES, TEMPLATES, LicenceScanner, SuffixAutomaton, licence_scan
from claimweave.llm.lm import Lattice, SubwordLatticeModel
from claimweave.llm.packing import SIZES, best_fit, cost
from claimweave.llm.queries import op1_permutation_ann
from claimweave.llm.tokens import default_model, token_counts
from claimweave.llm.toxicity import FactorizationMachine, hashes, level_term
from claimweave.llm.urlfilter import url_filter
from claimweave.llm import wrapper
from claimweave.llm.wrapper import Matching, Node, main_text, parse, read, shaped
from tests.support import SF

DOCS = "doc_id long, text string, extra string, score string, words string"


def frame(spark, rows):
    """Documents with further columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "beta", "gämma", "delta"]) + str(rng.randint(0, 9)) for _ in range(60_000))
    return [(1, None), (2, ""), (3, "   \n "), (4, "word"), (5, long), (6, "the same text here and now"), (6, "the same text here and now"), (7, "the same text here and now"), (None, "no id at all"), (8, "漢字 😀 \x00 <s> ▁x")]


# ---- 1

def test_ann(spark):
    got = defaultdict(list)
    for r in op1_permutation_ann(spark, SF).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    hits = 0
    for q, found in got.items():
        want = sorted(((-(rows[q] * v).sum(), i) for i, v in rows.items() if i != q))[:20]
        assert [x[0] for x in sorted(found)] == list(range(1, 21))
        hits += len({i for _, i in want} & {x[1] for x in found})
    assert len(got) == sum(i % 20 == 0 for i in rows) and hits >= 0.9 * 20 * len(got)


def test_ann_recall_where_the_index_prunes(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:160] = x[99]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = df.where("vec_id % 60 = 39")
    found = defaultdict(set)
    for r in PermutationIndex(block=3000).fit(df).search(q, df, 10).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = total = 0
    for i in found:
        s = x @ x[i]
        s[i] = -9
        want = sorted(range(6000), key=lambda j: (-s[j], j))[:10]
        hits, total = hits + len(set(want) & found[i]), total + 10
    assert len(found) == 100 and hits >= 0.9 * total
    assert found[99] == set(range(100, 110))  # copies: the smallest ids


def test_ann_odd(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [1.0, None]), (100, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0]), (None, [1.0, 1.0]), (3, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in PermutationIndex().fit(df).search(df.where("vec_id % 20 = 0"), df, 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 100), (0, 3, 1), (100, 1, 0), (100, 2, 2), (100, 3, 1)]
    none = df.where("false")
    assert PermutationIndex().fit(none).search(none, none).count() == 0


def test_ann_repeated_queries(spark):
    df = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(60)], "vec_id long, embedding array<double>")
    q = df.where("vec_id % 20 = 0")
    index = PermutationIndex(block=20).fit(df)
    want = sorted(map(tuple, index.search(q, df).collect()))
    assert sorted(map(tuple, index.search(q.union(q).union(q), df).collect())) == want and len(want) == 60


@pytest.mark.parametrize(("n", "width", "norms"), [(6000, 64, "one"), (6000, 128, "one"), (5000, 64, "even"), (5000, 64, "log 0.3"), (5000, 128, "log 1.0")])
def test_ann_recall(spark, n, width, norms):
    """At the defaults, on even directions and vectors of many lengths, nine tenths of the 20 largest inner products are found, though under a tenth of a full block is reranked."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= {"one": 1.0, "even": rng.uniform(0.5, 1.5, (n, 1)), "log 0.3": np.exp(0.3 * rng.standard_normal((n, 1))), "log 1.0": np.exp(rng.standard_normal((n, 1)))}[norms]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index, found = PermutationIndex(), defaultdict(set)
    assert math.ceil(index.share * index.block) + index.spare * 20 < 0.1 * index.block
    for r in index.fit(df).search(df.where("vec_id % 50 = 0"), df, 20).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = 0
    for i, got in found.items():
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(got & set(np.argsort(-s)[:20].tolist()))
    assert len(found) == n // 50 and hits >= 0.9 * 20 * len(found)


def test_ann_reads_short_files(spark):
    """Of 64 dimensions a query reads at most five postings a row (sixteen before), and of a larger table a smaller part is reranked."""
    x = np.random.default_rng(5).standard_normal((4000, 64))
    index = PermutationIndex().fit(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    files = InvertedFiles(permutations(x, index.pivots, index.files), len(index.pivots), index.files)
    asked = permutations(x[:50], index.pivots, index.files)
    assert (files.start[asked + 1] - files.start[asked]).sum() <= 5 * len(x) * len(asked)
    assert index.reranked(16 * 65536, 20)[0] == pytest.approx(index.reranked(65536, 20)[0] / 2) and index.reranked(5000, 20) == (index.share, index.spare * 20)


def test_ann_lengths_beyond_squares(spark):
    """Vectors whose squares overflow or vanish are found by direction and length all the same; infinite ones take no part."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 32))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = 1e-180 * unit[:100]
    rows = [(i, v.tolist()) for i, v in enumerate(1e170 * unit)] + [(-1, [math.inf] + [0.0] * 31), (-2, [-math.inf] + [0.0] * 31)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], df.schema)
    found = defaultdict(set)
    for r in PermutationIndex().fit(df).search(q, df, 20).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = 0
    for i in range(100):
        s = unit @ unit[i]
        s[i] = -9
        hits += len(found[i] & set(np.argsort(-s)[:20].tolist()))
    assert len(found) == 100 and hits >= 0.9 * 20 * 100


@pytest.mark.parametrize("rows", [1, 40, 300])
def test_agreements_in_pieces(rows, monkeypatch):
    """The agreements of many orders at a time are those of each order alone, however the work is cut."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((rows, 8))
    pivots = rng.standard_normal((50, 8))
    files = InvertedFiles(permutations(x, pivots, 20), 50, 20)
    asked = permutations(rng.standard_normal((30, 8)), pivots, 20)
    whole = np.concatenate([a for _, a in files.agreements(asked)])
    monkeypatch.setattr("claimweave.llm.ann.CELLS", 700)
    pieces = list(files.agreements(asked))
    assert [i for s, _ in pieces for i in range(30)[s]] == list(range(30)) and (len(pieces) > 1) == (rows > 1)
    assert (np.concatenate([a for _, a in pieces]) == whole).all() and (np.stack([files.agreement(o) for o in asked]) == whole).all()


def test_inverted_files():
    """Agreement from the postings is that of the whole permutations."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 8))
    orders = permutations(x, x[:100], 64)
    files = InvertedFiles(orders, 100, 64)
    for i in range(20):
        agreement = files.agreement(orders[i])
        weight = np.zeros((2, 100), dtype=np.int64)
        weight[0, orders[i]] = weight[1, orders[i + 1]] = 64 - np.arange(64)
        assert agreement[i + 1] == weight.min(axis=0).sum() and agreement[i] == agreement.max()


def test_ann_ids_that_repeat(spark):
    """Rows of the query's own id hide no other copy; an id of two vectors is answered for each."""
    rows = [(20, [1.0, 0.0])] * 40 + [(i, [1.0, 0.0]) for i in range(1, 8)] + [(40, [1.0, 0.0]), (40, [0.0, 1.0]), (9, [0.5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in PermutationIndex().fit(df).search(df.where("vec_id in (20, 40)"), df, 4).collect()]
    assert sorted(x for x in got if x[0] == 20) == [(20, k, k) for k in (1, 2, 3, 4)]
    assert sorted(x for x in got if x[0] == 40) == sorted([(40, k, k) for k in (1, 2, 3, 4)] + [(40, 1, 9)] + [(40, k + 1, k) for k in (1, 2, 3)])


# ---- 2

def out_of_place(text, profiles, size):
    words = re.findall(r"[^\W\d_]+", text.lower())
    c = Counter()
    for w in words:
        p = f" {w} "
        for n in (1, 2, 3):
            c.update(g for g in (p[i : i + n] for i in range(len(p) - n + 1)) if g.strip())
    rank = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], key(x[0])))][:size]
    mine = rank(c)
    return {lang: sum(abs(p.index(g) - i) if g in p else size for i, g in enumerate(mine)) for lang, p in profiles.items()}, c


def key(g):
    k = 0
    for ch in g:
        k = (k << 21) | ord(ch)
    return k


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = RankOrderProfiles().fit(docs, where=F.col("doc_id") % 3 != 0)
    got = model.predict(docs).select("doc_id", "text", "lang", "lang_pred", "score").collect()
    held = [r for r in got if r["doc_id"] % 3 == 0]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in got)
    unpack = lambda k: "".join(chr(x) for x in ((k >> 42) & 0x1FFFFF, (k >> 21) & 0x1FFFFF, k & 0x1FFFFF) if x)
    profiles = {lang: [unpack(k) for k in p] for lang, p in model.profiles.items()}
    for r in held[:25]:
        far, _ = out_of_place(r["text"], profiles, 400)
        assert r["lang_pred"] == min(far, key=lambda x: (far[x], x))


def test_language_odd(spark, odd):
    docs = frame(spark, odd).withColumn("lang", F.when(F.col("doc_id") < 8, "xx"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in RankOrderProfiles().fit(docs).predict(docs).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[8][0] == "xx" and len(got) == 9
    assert {r["lang_pred"] for r in RankOrderProfiles().fit(docs.where("false")).predict(docs).collect()} == {"und"}


def test_language_distance(spark):
    """What is in a learned language is near, letters at random are far, and a short text is never far."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(8)
    noise = " ".join("".join(rng.choice("qxzwkjvğωжю") for _ in range(9)) for _ in range(300))
    more = spark.createDataFrame([(-1, noise, None), (-2, "Zq xw", None)], docs.schema)
    got = {r["doc_id"]: r for r in RankOrderProfiles().fit(docs).predict(docs.union(more)).collect()}
    assert got[-1]["distance"] > 0.95 and got[-2]["distance"] < 0.6
    assert all(r["distance"] < 0.7 for i, r in got.items() if i >= 0 and r["distance"] is not None)


def test_clashing_names(spark):
    """Columns of any name that the operators use inside stay as they are."""
    names = ["told", "_told", "hash", "h_doc", "h_hash", "h_n", "h_items", "items", "_hash", "_p", "b_host", "b_path", "x_host", "x_path", "full", "short", "salt", "v", "id", "odd", "class", "kept_id", "kept_class", "_id", "_k", "_kept",
             "base", "tokens", "seen", "row", "key", "word", "times", "doc", "k", "n", "root", "token", "meta", "path_", "of", "template", "page", "a.b", "id0", "q", "db", "qb"]
    rows = [(i, t, u, *names) for i, t, u in [(1, "one of many words here", "http://a.com/x"), (2, "one of many words here", "http://a.com/y"), (3, "two", None), (None, None, "http://b.net/es/")]]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "url", *names])
    same = lambda df, n=4: df.count() == n and all(tuple(r) == tuple(names) for r in df.select(*[F.col(f"`{c}`") for c in names]).collect())
    assert same(RankOrderProfiles().fit(docs, lang_col="doc").predict(docs))
    assert same(decontaminate(docs, docs, item_col="doc_id"))
    assert same(url_filter(docs, spark.createDataFrame([("com", "/", "allow")], "host string, path string, verdict string")))
    assert same(JaccardJoin(80, 100, 5).keep_one(docs), 3)
    assert same(token_counts(docs)) and same(main_text(docs, html_col="text"))
    assert same(FactorizationMachine().fit(docs.withColumn("toxic", F.col("doc_id") % 2)).predict(docs))
    assert same(SubwordLatticeModel().fit(docs, train=F.lit(True)).score(docs, ["doc_id", *names]))
    assert best_fit(docs.withColumn("length", F.length("text")), "length").count() == 3


# ---- 3

PAGE = '<html><head><title>t</title><style>p{{}}</style></head><body><div class="top">Site name</div><nav><ul><li><a href="/{i}">link {i}</a></li></ul></nav><div class="body"><h1>Title {i}</h1><p>First &amp; {i} <b>bold<br>line</b><p>Second&nbsp;{i}</div><div class="note">Always the same words</div><div class="comments"><p>Reader {i} says</p></div><form>Sign {i}</form><footer>&copy; {i}</footer>'


def test_wrapper(spark):
    rows = [(i, f"http://a.example.com/{i}", PAGE.format(i=i)) for i in range(6)]
    rows += [(90, "http://b.org/x", "<article><p>Alone</p><script>var a='</p>'</script></article><aside>ad</aside>"), (91, "http://b.org/y", None), (92, None, "<p>No host"), (93, "http://a.example.com/z", ""), (94, "x", "plain <"), (90, "http://b.org/x", "<article><p>Alone</p></article>")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i][0] == f"Title {i}\nFirst & {i} bold line\nSecond {i}", got[i]
    assert got[90] == ("Alone", 5) and got[91] == ("", 0) and got[92][0] == "No host" and got[93] == ("", 0)
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_keeps_copies(spark):
    """Copies of a page are no evidence of a template, alone on their host or among other pages."""
    copy = "<nav>menu {i}</nav><article><h1>Copied</h1><p>The same story</p>{more}</article><div class='note'>House rules</div><script>track({i})</script>"
    more = "<ul><li>Only here</li></ul><blockquote>Quoted</blockquote><table><tr><td>Cell</td></tr></table><h3>Part</h3>"
    rows = [(i, f"http://copies.org/{i}", copy.format(i=0, more="")) for i in range(7)]
    rows += [(10 + i, f"http://mixed.org/{i}", copy.format(i=i % 2, more=more)) for i in range(6)]
    rows += [(20 + i, f"http://mixed.org/o{i}", f"<nav>menu</nav><article><h1>Own {i}</h1><p>Story {i}</p></article><div class='note'>House rules</div>") for i in range(6)]
    rows += [(30 + i, f"http://plain.org/{i % 9}", f"<div><h1>Head {i % 5}</h1><p>Text {i % 5}</p></div><div>House rules</div>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in main_text(df).collect()}
    for i in range(7):
        assert got[i] == "Copied\nThe same story"
    for i in range(6):
        assert got[10 + i] == "Copied\nThe same story\nOnly here\nQuoted\nCell\nPart" and got[20 + i] == f"Own {i}\nStory {i}"
    for i in range(20):
        assert got[30 + i] == f"Head {i % 5}\nText {i % 5}"


BARE = "<div><b>Brand {h}</b></div><div><p>Title {i} of {h}</p><div><p>Body {i}</p><p>More {i}</p></div></div><div>All rights {h}</div>"


def test_wrapper_without_telling_names(spark):
    """Plain elements alone: what is template comes from the templates, however the pages are dealt to tasks."""
    rows = [(100 * h + i, f"http://h{h}.org/{i}", BARE.format(h=h, i=i)) for h in range(3) for i in range(12)]
    # a page with one more element, one without the foot, one of another shape
    rows[3] = (3, rows[3][1], rows[3][2].replace("<div>All", "<div><i>Only</i> here</div><div>All"))
    rows[4] = (4, rows[4][1], rows[4][2].partition("<div>All")[0])
    rows[5] = (5, rows[5][1], "<table><tr><td>Other</td></tr></table>" + rows[5][2])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {100 * h + i: f"Title {i} of {h}\nBody {i}\nMore {i}" for h in range(3) for i in range(12)}
    want[3] += "\nOnly here"
    want[5] = "Other\n" + want[5]
    for parts in (1, 7, 36):
        assert {r["page_id"]: r["text"] for r in main_text(df.repartition(parts, "page_id")).collect()} == want
    alone = read(parse(rows[0][2]), None, {})
    assert alone.startswith("Brand 0\n") and alone.endswith("All rights 0")  # without a template nothing tells them apart


def test_wrapper_deep_and_wide(spark):
    """Very deep and very wide pages are read whole."""
    deep = "<div>" * 3000 + "<section>" * 3000 + "<p>Far down {i}</p>" + "</section>" * 3000 + "</div>" * 3000 + "<p>After {i}</p>"
    mixed = "".join(f"<div class='k{'abcdefgh'[j % 8]}{'xyz'[j % 3]}'>Part {j} of {{i}}</div><section>And {j} {{i}}</section>" for j in range(400))
    nested = "".join(f"<{'div' if j % 2 else 'section'}>" for j in range(4000)) + "<p>Bottom {i}</p>"
    rows = [(10 * k + i, f"http://w{k}.org/{i}", x.format(i=i)) for k, x in enumerate((deep, mixed, nested)) for i in range(6)]
    rows[8] = (12, rows[8][1], "<div class='ka'>Own</div>" + rows[8][2])
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"Far down {i}\nAfter {i}" and got[20 + i] == f"Bottom {i}"
        assert got[10 + i] == ("Own\n" if i == 2 else "") + "\n".join(f"Part {j} of {i}\nAnd {j} {i}" for j in range(400))


def plain_match(a, b, weight):
    """All order-preserving matches of two short lists, one after another: the greatest sum of weights."""
    if not a or not b:
        return 0
    best = max(plain_match(a[1:], b, weight), plain_match(a, b[1:], weight))
    return max(best, weight(a[0], b[0]) + plain_match(a[1:], b[1:], weight)) if a[0].label == b[0].label else best


def plain_common(a, b):
    return 1 + plain_match(a.kids, b.kids, plain_common)


def plain_weight(a, b):
    """Written out: equal texts count at the top, and below it between trees of one shape."""
    labels = lambda n: (n.label, *map(labels, n.kids))
    marks = lambda n: [n.mark, *[m for k in n.kids for m in marks(k)]]
    if labels(a) == labels(b):
        return len(marks(a)) + sum(p == q != 0 for p, q in zip(marks(a), marks(b), strict=True))
    return plain_common(a, b) + (a.mark == b.mark != 0)


def random_tree(rng, depth):
    node = Node(rng.choice(["div", "ul", "section"]), rng.choice([0, 1, 2]))
    node.kids = [random_tree(rng, depth - 1) for _ in range(rng.randrange(4) if depth else 0)]
    return node


def test_tree_matching(monkeypatch):
    """The match has the greatest weight, whether rows are lists or arrays; the pairs are the same in any number of kept rows."""
    rng = random.Random(11)
    for round_ in range(120):
        a, b = ([shaped(random_tree(rng, 2)) for _ in range(rng.randrange(1, 6))] for _ in range(2))
        got = []
        for wide in (0, 1000):
            monkeypatch.setattr(wrapper, "WIDE", wide)
            pairs = Matching().pairs(a, b)
            assert all(a[i].label == b[j].label for i, j in pairs) and pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
            got.append(pairs)
        assert got[0] == got[1]
        if [x.label for x in a] != [y.label for y in b]:
            assert sum(plain_weight(a[i], b[j]) for i, j in got[0]) == plain_match(a, b, plain_weight)
        monkeypatch.setattr(wrapper, "isqrt", lambda n: n)
        assert Matching().pairs(a, b) == got[0]
        monkeypatch.setattr(wrapper, "isqrt", lambda n: 0)
        assert Matching().pairs(a, b) == got[0]
        monkeypatch.undo()


@pytest.mark.parametrize("n", [10, 11, 12, 13, 62, 63, 64, 65, 66, 300])
def test_no_size_changes_the_match(spark, n):
    """A list of n blocks after the menu, on pages with one more or less: its texts are content and the rest goes, at every length."""
    rng = random.Random(n)
    page = lambda k: "<body><div>Home About</div>" + "".join(f"<div><h3>t{rng.random()}</h3><div>{rng.random()} said</div></div>" for _ in range(n + k % 2)) + "<div>All of it ours</div></body>"
    rows = spark.createDataFrame([(k, f"http://h{n}.org/{k}", page(k)) for k in range(6)], "page_id long, url string, html string")
    for r in main_text(rows).collect():
        want = re.findall(r"t0\.[\de-]+|0\.[\de-]+ said|[\d.e-]+ said", r["html"])
        assert r["text"].split("\n") == want, r["text"][:200]


def test_very_many_children():
    """Thousands of children on both sides, with text between: memory stays small and the match is right."""
    left, right = (parse("<body>" + "".join(f"<div>{k} {side if k % 3 else 'same'}</div>" + ("<section>x</section>" if k == at else "") for k in range(1500)) + "</body>") for side, at in (("a", 400), ("b", 700)))
    body = lambda page: page.kids[0] if page.kids[0].label == "body" else page
    pairs = Matching().pairs(body(left).kids, body(right).kids)
    assert len(pairs) == 1500


def test_wrapper_on_pages(spark):
    import html

    for r in main_text(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", F.col("html").alias("h")), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["h"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b)


# ---- 4

def test_tokens(spark, odd):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=default_model())
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "▁", "a", "the", "é", "<s>", "<0x41>", "漢", "😀", "\t", "ing", "　", "Ω"]
    rows = odd + [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(800)]
    for r in token_counts(frame(spark, rows), limit=50).collect():
        t = r["text"] or ""
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (len(sp.encode(t)), len(t.encode()), len(sp.encode(t)) > 50)
    assert token_counts(frame(spark, [])).count() == 0


# ---- 5

def brute_word(lat, logs, word):
    text = "▁" + word
    total = 0.0

    def walk(at, p):
        nonlocal total
        if at == len(text):
            total += math.exp(p)
            return
        for n in range(1, len(text) - at + 1):
            if (i := lat.ids.get(text[at : at + n])) is not None:
                walk(at + n, p + logs[i])
        if text[at] not in lat.ids:
            walk(at + 1, p + sum(logs[lat.bytes[b]] for b in text[at].encode()))

    walk(0, 0.0)
    return math.log(total)


def test_lattice():
    lat = Lattice(default_model())
    logs = lat.prior()
    words = ["the", "thing", "naïve", "漢字", "a", "zq🦄x", "x" * 12, "\x00"]
    assert np.allclose(lat.score(words, logs), [brute_word(lat, logs, w) for w in words])
    # expected counts: letters of all segmentations add up to the letters of the words
    e = lat.expect(["thing", "the"], np.array([2.0, 1.0]), logs)
    size = np.array([0.0] * lat.size)
    for p, i in lat.ids.items():
        size[i] = len(p)
    assert math.isclose((e * size).sum(), 2 * 6 + 4)
    assert lat.score(["y" * 3000], logs)[0] < -3000


def test_lm(spark, odd):
    docs = frame(spark, odd + [(20 + i, f"some words here number{i % 7} and THE end") for i in range(30)])
    model = SubwordLatticeModel(frequent=5).fit(docs, train=F.col("doc_id") % 2 == 0)
    got = model.score(docs, ["doc_id"]).collect()
    assert len(got) == len(odd) + 30
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    rows = odd + [(20 + i, f"some words here number{i % 7} and THE end") for i in range(30)]
    train = Counter(w for i, t in rows if i is not None and i % 2 == 0 for w in [*low(t), None])
    n, v, lat = train.total(), len(train), Lattice(default_model())
    want = defaultdict(list)
    n1, n2 = (sum(c == k for c in train.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    p = np.exp(model.logs)
    start = sum(p[i] for t, i in lat.ids.items() if t[0] == "▁")
    spelled = lambda w: math.exp(lat.score([w], model.logs)[0]) / start * (start + p[lat.end])
    for i, t in rows:
        ws = [*low(t), None]
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws)
        own = sum(math.log10(max(train[w] - d, 0) / n + d * v / n * (0.001 if w is None else 0.999 * spelled(w))) for w in ws) if len(ws) < 1000 else None
        want[i].append((len(ws), sum(w in train for w in ws), n, base, own))
    for r in got:
        w = want[r["doc_id"]][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert math.isclose(r["base_score"], w[3], rel_tol=1e-9)
        assert w[4] is None or math.isclose(r["score"], w[4], rel_tol=1e-9)
    none = SubwordLatticeModel().fit(docs.where("false"), train=F.lit(True))
    assert none.score(docs.where("false"), ["doc_id"]).count() == 0


# ---- 6

def test_toxicity_learns_pairs(spark):
    """'zorg' is toxic only together with 'blit'; neither alone is."""
    rng = random.Random(4)
    fill = ["plain", "words", "of", "text", "and", "more"]
    rows = []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(rng.choice(fill) for _ in range(8)) + (" zorg" if a else "") + (" blit" if b else ""), int(a and b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = FactorizationMachine().fit(df, where=F.col("doc_id") % 5 != 0).predict(df.where("doc_id % 5 = 0")).collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.97 * len(got)


def test_toxicity_against_explicit_pairs(spark):
    """The score is the logistic function of bias, weights and the sum over all pairs of a text's terms, found one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    model = FactorizationMachine(features=200).fit(docs.join(labels, "doc_id"))
    place = {int(h): i for i, h in enumerate(model.terms)}
    one = lambda b: hashes([b], model.bits)
    for r in model.predict(docs.orderBy("doc_id").limit(60)).collect():
        words = {w for w in re.findall(r"[^\W\d_]+", (r["text"] or "").lower())}
        found, starts = set(), Counter()
        for w in words:
            whole, _, own = one(w.encode())
            found.update([int(whole[0]), *map(int, own)])
            assert len(own) == sum(len(w) > n for n in (3, 4, 5, 6, 7))
            starts.update(map(int, own))
        for h, n in starts.items():
            found.update(int(level_term(np.uint64(h), least, model.bits)) for least in (2, 4) if n >= least)
        x = sorted(place[h] for h in found if h in place)
        z = model.bias + sum(model.w[i] for i in x) + sum(float(model.v[i] @ model.v[j]) for k, i in enumerate(x) for j in x[:k])
        assert math.isclose(r["score"], 1 / (1 + math.exp(-max(-50, min(50, z)))), rel_tol=1e-9)


def test_toxicity_odd(spark, odd):
    docs = frame(spark, odd)
    blank = FactorizationMachine().fit(docs.withColumn("toxic", F.lit(None).cast("int")))
    assert all(r["predicted"] == 0 for r in blank.predict(docs).collect())
    one = FactorizationMachine().fit(docs.withColumn("toxic", F.lit(1))).predict(docs)
    assert one.count() == len(odd) and all(0 < r["score"] <= 1 and r["predicted"] == 1 for r in one.collect())
    assert FactorizationMachine().fit(docs.where("false").withColumn("toxic", F.lit(1))).predict(docs.where("false")).count() == 0


# ---- 7

def brute_hits(docs, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        if w and i is not None:
            for s in range(max(0, len(w) - window) + 1):
                wins[tuple(w[s : s + window])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit.update(range(s, s + n)), ids.update(wins[tuple(w[s : s + n])])
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination(spark, odd):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 13, 20, 40])))) for i in range(25)] + [(99, None), (98, " . "), (None, "w1 w2 w3"), (7, "Same Item, again"), (0, "same item again")]
    docs = list(odd)
    for i in range(60):
        src = rng.choice(items[:25])[1].split()
        a = rng.randint(0, len(src))
        docs.append((200 + i, " ".join([rng.choice(vocab) for _ in range(rng.randint(0, 30))] + src[a:] + ["x"] * rng.randint(0, 300) + src[:a])))
    docs += [(300, "same ITEM again. " * 50), (300, "same ITEM again. " * 50), (301, items[0][1])]
    got = decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == brute_hits(docs, items)
    clean = decontaminate(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0 or contaminated").count()
    assert clean == 0 and decontaminate(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_proximity(spark):
    index = PositionalIndex(frame(spark, [(1, "a x b a"), (2, "a x x x b"), (3, "b a")]))
    assert {(r["doc"], r["a"], r["b"]) for r in index.near("a", "b", 2).collect()} == {(1, 0, 2), (1, 3, 2), (3, 1, 0)}


# ---- 8

def brute_roots(docs, num, den, m):
    """The component of each row, by the number of one of its rows."""
    words = lambda t: (t or "").encode().lower().split()
    sets = []
    for d, t in docs:
        w = words(t)
        sets.append((d, frozenset(tuple(w[i : i + m]) for i in range(max(1, len(w) - m + 1))) if w else frozenset()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def brute_components(docs, num, den, m):
    words = lambda t: (t or "").encode().lower().split()
    roots, least = brute_roots(docs, num, den, m), defaultdict(list)
    for (d, _), r in zip(docs, roots, strict=True):
        least[r].append(d)
    size = lambda w: len({tuple(w[i : i + m]) for i in range(max(1, len(w) - m + 1))}) if w else 0
    return sorted(((d, size(words(t)), min((x for x in least[r] if x is not None), default=None)) for (d, t), r in zip(docs, roots, strict=True)), key=str)


@pytest.mark.parametrize(("num", "size"), [(90, 3), (80, 5), (50, 1)])
def test_jaccard(spark, odd, num, size):
    rng = random.Random(num)
    docs = list(odd)
    for g in range(12):
        base = [f"v{rng.randint(0, 400)}" for _ in range(rng.randint(1, 120))]
        for k in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 10**6)}"
            docs.append((1000 + 50 * g + k, " ".join(copy)))
    got = [(r["doc"], r["n_shingles"], r["component_id"]) for r in JaccardJoin(num, 100, size).components(frame(spark, docs)).collect()]
    assert sorted(got, key=str) == brute_components(docs, num, 100, size)


def test_jaccard_keeps_one(spark, odd):
    kept = [r["doc_id"] for r in JaccardJoin(80, 100, 5).keep_one(frame(spark, odd)).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, 4, 5, 6, None, 8], key=str)
    assert JaccardJoin().components(frame(spark, [])).count() == 0


def test_jaccard_keeps_one_of_each_component(spark):
    """Null ids and ids of several texts: texts without near duplicates all stay."""
    text = lambda x: " ".join(f"{x}{i}" for i in range(40))
    rows = [(None, text(x)) for x in "abcd"] + [(None, text("a"))] + [(5, text("e")), (5, text("f")), (5, text("f")), (5, text("f") + " more")]
    rows += [(None, text("g")), (9, text("g")), (7, text("g") + " more"), (7, text("h"))]
    kept = [(r["doc_id"], r["text"]) for r in JaccardJoin(80, 100, 5).keep_one(frame(spark, rows)).collect()]
    either = [x for x in kept if x in ((5, text("f")), (5, text("f") + " more"))]  # one component and one id: the least class
    assert len(either) == 1
    assert sorted(kept, key=str) == sorted([(None, text(x)) for x in "abcd"] + [(5, text("e")), *either, (7, text("g") + " more"), (7, text("h"))], key=str)


# ---- 9

def test_urls(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/e", "block"), (None, "/", "block"), ("both.org", "", "allow"), ("both.org", "", "block")], "host string, path string, verdict string")
    cases = [
        ("http://a.example.com/en/x?q", "block", "example.com/en/"), ("https://WWW.example.COM/en/", "allow", "www.example.com/en/"), ("http://example.com", "allow", None), ("http://notexample.com/en/", "allow", "com/"), ("http://x.net/es#f", "block", "net/e"),
        ("http://com:80/", "allow", None), (None, "allow", None), ("no scheme", "allow", None), ("", "allow", None), ("http://both.org?x", "block", "both.org"), ("http://example.com./en/", "allow", None),
    ]
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(cases)] + [(0, cases[0][0])], "page_id long, url string")
    got = url_filter(df, rules).collect()
    assert len(got) == len(cases) + 1 and all((r["verdict"], r["rule"]) == cases[r["page_id"]][1:] for r in got)
    assert {r["verdict"] for r in url_filter(df, rules.where("false"), default="block").collect()} == {"block"} and url_filter(df.where("false"), rules).count() == 0


# ---- 10

def test_packing(spark):
    rng = random.Random(9)
    docs = [(i, int(rng.lognormvariate(6.5, 1.3))) for i in range(3000)] + [(5000, 40_000), (5001, 0), (5002, None), (7, 10)]
    got = best_fit(spark.createDataFrame(docs, "doc_id long, n long"), "n", shard=900).collect()
    lengths = Counter()
    bins = defaultdict(list)
    for r in got:
        lengths[r["doc_id"]] += r["length"]
        bins[r["shard"], r["bin"]].append(r)
        assert r["start"] == r["piece"] * SIZES[-1] and r["piece"] < r["n_pieces"]
    want = Counter()
    for i, n in docs:
        if n:
            want[i] += n
    assert lengths == want
    total = 0
    for rows in bins.values():
        filled = sum(r["length"] for r in rows)
        assert {(r["filled"], r["size"]) for r in rows} == {(filled, min(s for s in SIZES if s >= filled))}
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        total += cost(rows[0]["size"])
    assert total < 1.12 * sum(n * cost(1024) / 1024 for n in want.values()) * 1.2
    assert best_fit(spark.createDataFrame([], "doc_id long, n long"), "n").count() == 0


def brute_pack(lengths, sizes):
    """The cheapest of the opening policies, each by a walk over all open bins for the one of least room."""
    best = None
    for opening in (None, *sizes):
        bins = []  # [room, contents]
        for n in lengths:
            able = [b for b in bins if b[0] >= n]
            if able:
                b = min(able, key=lambda b: b[0])
            else:
                fit = [s for s in sizes if s >= n]
                size = min(fit, key=lambda s: (cost(s) / (s // n * n), s)) if opening is None else next((s for s in fit if s >= opening), fit[-1])
                bins.append(b := [size, []])
            b[0] -= n
            b[1].append(n)
        packed = sorted(tuple(b[1]) for b in bins)
        total = sum(cost(min(s for s in sizes if s >= sum(p))) for p in packed)
        if best is None or total < best[0]:
            best = total, packed
    return best[1]


def test_packing_is_best_fit(spark):
    rng = random.Random(10)
    for trial in range(3):
        lengths = [rng.randint(1, [300, 1500, 8192][trial]) for _ in range(250)]
        bins = defaultdict(list)
        for r in best_fit(spark.createDataFrame([(None if i == 9 else i, n) for i, n in enumerate(lengths)], "doc_id long, n long"), "n").collect():
            bins[r["shard"], r["bin"]].append(r["length"])
        assert sorted(tuple(sorted(b, reverse=True)) for b in bins.values()) == brute_pack(sorted(lengths, reverse=True), SIZES)


def test_packing_deals_repeats(spark):
    """Very many rows of one id and length go to different shards; large ids beside a null one stay exact."""
    big = (1 << 60) + 1
    got = best_fit(spark.createDataFrame([(7, 100)] * 2000 + [(None, 100), (big, 100)], "doc_id long, n long"), "n", shard=200).collect()
    shards = Counter(r["shard"] for r in got)
    assert len(got) == 2002 and len(shards) == 11 and max(shards.values()) < 300
    assert {r["doc_id"] for r in got} == {7, None, big}


# ---- 11

def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_places(text):
    w = plain_words(text)
    return w, [(i, label) for phrase, label in PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]


def test_licence_scan(spark, odd):
    gpl, mit = "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License."
    rows = [
        *odd, (20, gpl), (21, "x " * 9 + mit + " y"), (22, "CC BY, cc-by cc_by ccby CC  BY. all rights reserved"), (23, TEMPLATES[13][1]), (24, TEMPLATES[13][1].replace("charge,", "charge, really,").replace("copy of", "copies of")),
        (25, "the software and the work of the public"), (26, (mit + " ") * 400), (27, "general public license " * 3000), (28, "general public licence"), (29, mit + " " + gpl), (29, mit + " " + gpl), (30, "released under the other mit license of some kind"),
    ]
    got = licence_scan(frame(spark, rows))
    assert got.columns[:2] == ["doc_id", "text"] and {"extra", "words"} < set(got.columns)
    found = sorted(((r["doc_id"], r["text"] or "", r) for r in got.collect()), key=lambda x: (str(x[0]), x[1]))
    assert len(found) == len(rows)
    for _, text, r in found:
        w, places = plain_places(text)
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= {*r["labels"].split(",")} and 0 <= r["score"] <= 1
        assert all(s["covered"] >= 0.8 * s["size"] and w[s["start"]] in plain_words(" ".join(t for _, t in TEMPLATES)) for s in r["spans"])
    by = {i: r for i, _, r in found}
    assert by[20]["labels"] == "gpl,gpl-3.0" and by[21]["labels"] == "mit" and [tuple(s)[:3] for s in by[21]["spans"]] == [("mit", 9, 13)] and by[23]["labels"] == "mit" == by[24]["labels"]
    assert by[25]["labels"] == "" and by[29]["labels"] == "gpl,gpl-3.0,mit" and len(by[26]["spans"]) == 400 and by[27]["n_base"] == 3000 and by[5]["score"] == 0
    assert licence_scan(frame(spark, [])).count() == 0
    assert LicenceScanner([], []).scan(b"cc by")[1:3] == (0, None)


def test_suffix_automaton():
    """Every run of every sequence is there once with all its ends, and matching statistics are those of a search of all runs."""
    rng = random.Random(5)
    sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(12)]
    automaton = SuffixAutomaton(sequences)
    runs = defaultdict(set)
    for s, seq in enumerate(sequences):
        for i in range(len(seq)):
            for j in range(i, len(seq)):
                runs[tuple(seq[i : j + 1])].add((s, j))
    for run, ends in runs.items():
        assert set(automaton.ends(automaton.find(list(run)))) == ends
    assert sum(automaton.length[s] - automaton.length[automaton.link[s]] for s in range(1, len(automaton.link))) == len(runs)
    scanner = LicenceScanner([(f"t{i}", " ".join("abc"[x] for x in seq)) for i, seq in enumerate(sequences)], [("a b", "ab"), ("c", "c")], least=2)
    text = [rng.choice("abcd") for _ in range(300)]
    known = [scanner.word.get(w.encode()) for w in text]
    found, places = scanner.matches(known)
    longest = [max((n for n in range(i + 2) if tuple("abc".find(w) for w in text[i - n + 1 : i + 1]) in runs), default=0) for i in range(len(text))]
    want = [(i, n) for i, n in enumerate(longest) if n >= 2 and (i + 1 == len(text) or longest[i + 1] != n + 1)]
    assert [(i, n) for i, n, _ in found] == want
    assert sorted(places) == sorted([(i, "ab") for i in range(299) if text[i : i + 2] == ["a", "b"]] + [(i, "c") for i in range(300) if text[i] == "c"])
    # the best chain of each template, by trying all pairs
    for template, chains in scanner.chains(found).items():
        seeds = sorted((e, p, n) for e, n, state in found for t, p in scanner.automaton.ends(state) if t == template)
        value = []
        for k, (e, p, n) in enumerate(seeds):
            before = [v + n - max(seeds[j][0] - (e - n), seeds[j][1] - (p - n), 0) for j, v in enumerate(value) if seeds[j][0] < e and seeds[j][1] < p and e - n + 1 - seeds[j][0] <= scanner.gap + 1 and max(seeds[j][0] - (e - n), seeds[j][1] - (p - n), 0) < n]
            value.append(max([n, *before]))
        assert [c for c, _, _ in chains] == value


# ---- 12

def plain_ranks(rows, items, k=50):
    texts = [(i, Counter(plain_words(t))) for i, t in rows]
    texts = [(i, c) for i, c in texts if c]
    n, length = len(texts), sum(c.total() for _, c in texts)
    asked = defaultdict(set)
    for item, t in items:
        if item is not None:
            asked[item] |= set(plain_words(t))
    out = []
    for item, terms in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for _, c in texts) + 1))) for t in terms}
        scores = []
        for i, c in texts:
            m = 50 + 50 * c.total() * n // length
            scores.append((-sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c), i is None, i))
        scores = sorted((s for s in scores if s[0] < 0), key=lambda x: (x[0], x[1], x[2] or 0))[:k]
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(scores)]
    return sorted(out, key=str)


def test_bit_sliced_search(spark, odd):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "漢字", "Zoë"]
    rows = [*odd, *((100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60)))) for i in range(400)), (50, "w1 w2"), (51, "W1, w2!"), (51, "w1-w2"), (None, "w1 w2"), (None, "word w3 " * 30)]
    items = [(1, "w1 w2 W1"), (1, "the same text"), (2, None), (3, "nothing of the kind zzz"), (None, "w1"), (4, "漢字 Zoë é w5"), (5, " ".join(vocabulary)), (6, "word")]
    docs, asked = frame(spark, rows), spark.createDataFrame([(i, t, 0, 1) for i, t in items], "item_id long, text string, rank int, doc_id int")
    want = plain_ranks(rows, items)
    for args in ({}, {"block_docs": 7}, {"block_postings": 40, "query_bytes": 20}):
        got = BitSlicedSearch(**args).search(docs, asked)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert BitSlicedSearch().search(docs.where("false"), asked).count() == 0 and BitSlicedSearch().search(docs, asked.where("false")).count() == 0
    assert sorted((tuple(r) for r in BitSlicedSearch(k=3).search(docs, asked).collect()), key=str) == plain_ranks(rows, items, 3)


def test_bit_slices():
    """Sums by carries and the k best against plain sums, with ties at the k-th."""
    rng = np.random.default_rng(4)
    for docs, top in ((1, 1), (64, 3), (200, 1 << 20), (1000, 9)):
        dense = rng.integers(0, top + 1, (12, docs)) * (rng.random((12, docs)) < rng.random((12, 1)))
        term, doc = np.nonzero(np.ones_like(dense))
        index = BlockIndex(term, doc, dense.ravel(), docs)
        for terms in ([0], [3, 4], list(range(12)), [7, 99]):
            sums = dense[[t for t in terms if t < 12]].sum(axis=0)
            for k in (1, 5, 50, 5000):
                found, score = best(index.total(terms), k)
                want = sorted((-s, i) for i, s in enumerate(sums.tolist()) if s)[:k]
                assert sorted(zip((-score).tolist(), found.tolist(), strict=True)) == want


# ---- 13

def plain_clusters(rows, k, rounds, width):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if groups[j] else c for j, c in enumerate(centroids)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in last:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], inertia.total(), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in last), key=str)


@pytest.mark.parametrize("grid", [1, 4, 64])
def test_exponion(spark, grid):
    """On a coarse grid most distances tie, and several start centroids are equal."""
    rng = np.random.default_rng(grid)
    rows = [(i, v) for i, v in enumerate((rng.integers(-grid, grid + 1, (300, 3)) / 256).tolist())]
    rows += [(7, [0.0, 0.0, 0.0])] * 40 + [(None, [1.0, -1.0, 0.5]), (8, [float("nan"), 0.0, 0.0]), (9, None), (10, [1.0]), (11, [1.0, None, 0.0]), (12, [float("inf"), 0.0, 0.0]), (13, [])]
    df = spark.createDataFrame([(i, v, 5, "c") for i, v in rows], "vec_id long, embedding array<double>, cluster int, d string").repartition(3)
    for k, rounds in ((9, 4), (1, 2), (60, 1), (1000, 2), (5, 0)):
        got = ExponionKMeans(k=k, rounds=rounds, width=3).cluster(df)
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_clusters(rows, k, rounds, 3), k
    assert ExponionKMeans(width=3).cluster(df.where("false")).count() == 0


def test_exponion_skips():
    """Bounds and balls leave out most distances where clusters are apart, and give the nearest centroid, ties to the smaller number."""
    rng = np.random.default_rng(1)
    middle = rng.integers(-9000, 9000, (40, 8))
    x = middle[rng.integers(0, 40, 5000)] + rng.integers(-300, 300, (5000, 8))
    a, u, low = np.zeros(5000, dtype=np.int32), np.full(5000, np.inf), np.zeros(5000)
    c, moved = middle, np.zeros(40)
    for _ in range(4):
        most = np.array([np.delete(moved, j).max() for j in range(40)])
        u, low, search = u + moved[a], low - most[a], Centroids(c)
        d = search.assign(x, a, u, low)
        every = np.stack([squared(x, own) for own in c])
        assert (a == every.argmin(axis=0)).all() and (d == every.min(axis=0)).all()
        new = np.stack([x[a == j].sum(axis=0) // max(1, (a == j).sum()) if (a == j).any() else c[j] for j in range(40)])
        c, moved = new, np.sqrt(squared(new, c))
    assert search.scanned < 0.02 * 40 * 5000
