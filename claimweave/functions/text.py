"""Text functions as native column expressions. Lengths and positions are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the text rules
SUFFIXES = ["ions", "ion", "ing", "ies", "es", "ed", "s", "e"]
STOP = ["the", "a", "an", "of", "in", "on", "for", "to", "and", "or", "is", "was", "were", "are", "be", "with", "by", "at", "as", "that", "this", "it", "we", "our", "的", "了", "是", "在", "和", "与", "对", "有", "这", "那", "被", "为"]
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"
# fixed value of the quote forms: ideographs, their marks and the full-width forms
QUOTE_CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
COMMON_NUMBERS = ["100", "50", "95", "99"]


def squeeze(text: Column) -> Column:
    """White space of any kind to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fold_marks(text: Column) -> Column:
    """Typographic quotes, dashes and the ellipsis to their plain forms; expects composed text."""
    return F.regexp_replace(F.translate(text, "‘’“”–—", "''\"\"--"), "…", "...")


def normalize_quote(text: Column) -> Column:
    """Marks folded, blanks squeezed, and no blank beside a CJK character. Compatibility forms: text_udf.nfkc first."""
    plain = squeeze(fold_marks(text))
    return F.regexp_replace(F.regexp_replace(plain, rf"(?<=[{QUOTE_CJK}])\s+", ""), rf"\s+(?=[{QUOTE_CJK}])", "")


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")


def quote_faithful(quote: Column, source: Column) -> Column:
    return F.contains(normalize_quote(source), normalize_quote(quote))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; each CJK character by itself. Most characters are told by the plain ranges, which stand first as they cost least."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[a-z0-9[\p{{L}}\p{{N}}&&[^{CJK}]]]++|[{CJK}]"), F.lit(0))


def ascii_tokens(text: Column) -> Column:
    """The set of ASCII runs and single CJK characters, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+|[\x{4E00}-\x{9FFF}]"), F.lit(0)))


def sentences(text: Column) -> Column:
    """ASCII stops end a sentence before white space or the end, CJK stops always."""
    parts = F.split(text, r"(?<=[。！？])|(?<=[.!?])(?=\s|$)")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def stem(word: Column) -> Column:
    """The first suffix that leaves four characters goes, once."""
    low = F.lower(word)
    out = F.when(F.lit(False), low)
    for s in SUFFIXES:
        out = out.when(F.endswith(low, F.lit(s)) & (F.length(low) - len(s) >= 4), F.substring(low, F.lit(1), F.length(low) - len(s)))
    return out.otherwise(low)


def passage_terms(text: Column) -> Column:
    words = F.split(F.lower(text), r"[^\p{L}\p{N}%.$]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP)), stem))


# fixed values of the period rules: dashes and range marks
PERIOD_DASHES = "‐‑‒–—―−－～〜~"


def year_range(text: Column) -> Column:
    """'YYYY' or 'YYYY-YYYY' (any dash or range mark, blanks around) as lo and hi, the smaller first; null where it is neither."""
    plain = F.translate(text, PERIOD_DASHES, "-" * len(PERIOD_DASHES))
    year = lambda k: F.regexp_extract(plain, r"(?U)^\s*(\d{4})\s*(?:-\s*(\d{4}))?\s*$", k)
    lo, hi = F.when(year(1) != "", year(1).cast("int")), F.when(year(2) != "", year(2).cast("int"))
    return F.when(lo.isNotNull(), F.struct(F.least(lo, F.coalesce(hi, lo)).alias("lo"), F.greatest(lo, F.coalesce(hi, lo)).alias("hi")))


def periods_meet(a: Column, b: Column, x: Column | None = None, y: Column | None = None) -> Column:
    """Ranges overlap; where one is no range, one text contains the other. x, y: the year ranges of both, where columns have them: for pairs, so that a row is not read again for each of its pairs."""
    x, y = year_range(a) if x is None else x, year_range(b) if y is None else y
    return F.when(x.isNotNull() & y.isNotNull(), (x["lo"] <= y["hi"]) & (y["lo"] <= x["hi"])).otherwise(F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a)))


def scope_compatible(p1: Column, p2: Column, r1: Column, r2: Column, a1: Column, a2: Column, y1: Column | None = None, y2: Column | None = None) -> Column:
    """Only what both sides state can conflict: periods (with their year ranges, where known), regions, non-empty lists of actors."""
    low = lambda xs: F.transform(xs, F.lower)
    return (
        (p1.isNull() | p2.isNull() | periods_meet(p1, p2, y1, y2)) & (r1.isNull() | r2.isNull() | (F.lower(r1) == F.lower(r2)))
        & (a1.isNull() | a2.isNull() | (F.size(a1) == 0) | (F.size(a2) == 0) | F.arrays_overlap(low(a1), low(a2)))
    )


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))


def digit_signature(text: Column) -> Column:
    return F.array_join(F.array_sort(numbers(text)), ",")


def rare_numbers(text: Column) -> Column:
    """Numbers of three or more significant digits that are neither years nor everyday ones."""
    ok = lambda n: (F.length(F.regexp_replace(F.regexp_replace(n, r"\.", ""), "^0+", "")) >= 3) & ~n.rlike(r"^(19|20)\d\d$") & ~n.isin(*COMMON_NUMBERS)
    return F.array_sort(F.array_distinct(F.filter(numbers(text), ok)))


def shingles(text: Column, size: int = 5) -> Column:
    """The set of character shingles; of a shorter text none. By a character array, as substring() walks the text each time."""
    chars = F.split(text, "")
    n = F.length(text) - size + 1
    one = lambda c: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(*[F.get(c, i + k) for k in range(size)]))
    return F.when(n >= 1, F.array_distinct(F.flatten(F.transform(F.array(chars), one)))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """0 where both sets are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def strip_tags(html: Column) -> Column:
    """Scripts, styles and tags out, seven entities decoded (&amp; last), blanks squeezed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.regexp_replace(text, name, char)
    return squeeze(text)


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """Lower scheme and host, no www., default port, fragment, tracking parameters, double slashes or last slash.

    The native form for URLs whose query needs no re-encoding; text_udf.canonical_url takes every URL.
    """
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([a-zA-Z][\w+.-]*)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"//([^/?#]*)", 1)), r"^www\.", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"//[^/?#]*([^?#]*)", 1), "/{2,}", "/"), "(.)/$", "$1")
    pairs = F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(r"(?i)^(utm_[^=]*|gclid|fbclid|ref)(=|$)"))
    query = F.array_join(pairs, "&")
    return F.when(F.length(u) > 0, F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def number_at_border(hay: Column, needle: Column) -> Column:
    """contains(); a needle with digits must not be flanked by more of a number."""
    quoted = F.regexp_replace(needle, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    whole = F.regexp_like(hay, F.concat(F.lit(r"(?<![\d.,])"), quoted, F.lit(r"(?![\d.,]*\d)")))
    return F.when(needle.rlike(r"\d"), whole).otherwise(F.contains(hay, needle))


def containing_sentence(body: Column, anchor: Column) -> Column:
    """The sentence of body around the first place of anchor, from stop to stop; the anchor where the body lacks it. A dot between digits is no stop; what ends with a stop takes no further sentence."""
    stop = r"(?:。|(?<!\d)\.|\.(?!\d))"
    at, n = F.instr(body, anchor), F.length(anchor)
    # one character of the anchor stays on either side, for what stands next to a stop
    before = F.regexp_replace(F.substring(body, F.lit(1), at), rf"(?s)^.*{stop}(?=.)", "")
    after = F.regexp_extract(F.substring(body, at + n - 1, F.length(body)), rf"(?s)^.(.*?{stop}|.*)", 1)
    last, flank = F.substring(anchor, n, F.lit(1)), F.concat(F.substring(body, F.greatest(at + n - 2, F.lit(1)), F.lit(1)), F.substring(body, at + n, F.lit(1)))
    ended = (last == "。") | ((last == ".") & ~((at + n > F.lit(2)) & flank.rlike(r"^\d\d$")))
    whole = F.concat(F.substring(before, F.lit(1), F.length(before) - 1), anchor, F.when(ended, "").otherwise(after))
    return F.when(at > 0, F.regexp_replace(whole, r"(?U)^\s+|\s+$", "")).otherwise(anchor)


def core_terms(text: Column, stop: list[str]) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop)))


def far_apart(a: Column, b: Column) -> Column:
    """The symmetric difference is more than half of both sets: a narrowing that starts the rounds anew."""
    return (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))) * 2 > F.size(a) + F.size(b)


def request_fingerprint(need: Column, hints: Column) -> Column:
    plain = lambda x: squeeze(F.lower(x))
    return F.sha2(F.concat(plain(need), F.lit("\n"), F.array_join(F.array_sort(F.transform(hints, plain)), "\n")), 256)


def norm_v0(text: Column) -> Column:
    """Folded quotes, dashes, blanks and dots, single blanks."""
    t = F.replace(F.translate(text, "‘’“”–—\u00a0", "''\"\"-- "), F.lit("…"), F.lit("..."))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def normalize_legacy(text: Column) -> Column:
    """The quote form that drops every blank of a text with any Chinese character; kept as a control."""
    t = squeeze(fold_marks(text))
    return F.when(t.rlike(f"[{QUOTE_CJK}]"), F.regexp_replace(t, r"(?U)\s+", "")).otherwise(t)


def recent_year(text: Column, year: int) -> Column:
    """Whether a text names a year of four digits not before the one before this."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{4})\b"), F.lit(1)), lambda y: y.cast("int"))) >= year - 1, F.lit(False))
