"""Text functions that Spark lacks, as Arrow batches: compatibility forms, number words, exact URLs, the text gates."""

from __future__ import annotations

import json
import re
import unicodedata
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

# fixed values of the number rules
ONES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
CHINESE = "零一二三四五六七八九"
CHINESE_NUMBER = "〇零一二三四五六七八九十百千万亿两"
UNITS = "%|‰|倍|x|ms|秒|分钟|小时|天|年|月|日|个|篇|条|名|例|人|位|项|次|种|组|家|所|元|万元|亿元|美元|分|度|kg|g|mg|km|m|cm|mm|GB|MB|KB"
DASHES = "‐‑‒–—―−－⁻"
# fixed values of the polarity rules: operators by class
NEGATIONS = {
    "NEG-S": [
        "不", "未", "没有", "并非", "无", "尚未", "未能", "难以", "否认", "而非", "并不", "not", "no", "never", "failed to", "fail to", "without", "neither", "nor", "unable to", "rather than", "contrary to", "cannot", "did not", "does not", "do not",
        "hardly", "barely", "scarcely", "falls short of", "fall short of", "short of", "far from", "fails to", "insufficient",
        "撤稿", "存疑", "是错的", "反驳", "远逊于", "未达", "达不到", "并未", "disproved", "disproven", "refuted", "retracted", "is false", "overstates", "overstated", "lacks", "seldom", "rarely", "questionable", "debunked",
    ],
    "NEG-N": [
        "comparable", "similar", "equivalent", "on par with", "no different", "did not reach significance", "not statistically significant", "did not differ", "do not differ", "does not differ", "were not different",
        "no significant difference", "no statistically significant difference", "no significant association", "no significant effect", "no difference",
        "相当", "相仿", "接近", "无差异", "无显著差异", "未达显著", "未见差异", "无统计学差异", "没有显著影响", "没有显著差异", "无显著影响", "无显著相关性", "无显著相关", "没有显著相关", "无统计学意义", "未见显著", "差异不显著", "相关性不显著",
    ],
    "NEG-C": ["若", "如果", "除非", "假设", "即便", "在……情况下", "if", "unless", "assuming", "provided that", "would", "could"],
    "NEG-Q": ["是否", "能否", "有待", "尚不清楚", "whether", "remains unclear", "it is unknown"],
    "NEG-R": ["声称", "据称", "有人认为", "号称", "自称", "claimed", "alleged", "purported", "reportedly", "claims to"],
    "NEG-L": ["至多", "最多", "不超过", "仅", "只有", "充其量", "低于", "小于", "不足", "少于", "at most", "up to", "no more than", "only", "below", "fewer than", "less than", "as low as", "under"],
    "NEG-I": ["吗", "呢", "?", "？"],
}
# fixed values: the words that may stand right before a number
BEFORE_NUMBERS = [
    "reached", "reaches", "reach", "achieved", "achieves", "achieve", "attained", "attains", "scored", "scores", "obtained", "obtains", "yields", "yielded", "gives", "gave", "reports", "reported", "shows", "showed", "records", "recorded", "hit", "hits",
    "is", "was", "are", "were", "be", "of", "to", "at", "with", "by", "the", "a", "an", "and", "or", "about", "report", "show", "record", "observe", "observed", "observes", "we", "they", "it", "that", "this", "these", "those",
    "达到", "达", "为", "是", "取得", "到", "有", "共", "计", "的", "率",
]
CONTRAST = ["however", "but", "yet", "nevertheless", "但", "然而", "不过"]
MARKS = {"verified": "已验证", "attributed": "已归因", "estimated": "估计值", "contested": "有反证", "unverified": "未验证", "not_covered": "未覆盖"}
# fixed values of the counter-evidence rules: negations, words of contrary literature, neutral words, comparatives, words of the query language
COUNTER_NOT = ["不", "未", "没有", "并非", "无", "并不", "否", "not", "no", "never", "without", "fails", "fail"]
COUNTER_LITERATURE = [
    "反驳", "质疑", "未能复现", "无法复现", "复现失败", "失败", "争议", "撤稿", "更正", "存疑", "refute", "refutes", "refuted", "contradict", "contradicts", "contradicted", "fails", "failed", "failure", "irreproducible", "unreproducible",
    "retraction", "retracted", "dispute", "disputed", "criticism", "critique", "rebuttal", "erratum", "corrigendum", "overestimate", "overstated", "limitation", "limitations",
]
COUNTER_NEUTRAL = ["reproduce", "reproduced", "reproduces", "reproduction", "reproducibility", "replicate", "replicated", "replicates", "replication", "independent", "verify", "verified", "复现", "重复实验", "独立验证"]
COUNTER_COMPARE = ["高于", "低于", "优于", "劣于", "大于", "小于", "超过", "不足", "higher", "lower", "better", "worse", "above", "below", "exceeds", "under"]
COUNTER_STOP = ["and", "or", "not", "the", "of", "in", "a", "an", "to", "for", "on", "is", "are", "was", "were", "的", "了", "与", "和", "在", "是", "被", "对", "从", "及", "等", "中", "该方法", "该模型", "该研究", "本文", "论文", "研究", "方法", "模型", "结果", "实验"]
CONTROLLED = {*COUNTER_NOT, *COUNTER_LITERATURE, *COUNTER_NEUTRAL, *COUNTER_COMPARE, *COUNTER_STOP}

_NUMBER = {w: i for i, w in enumerate(ONES)} | {w: 10 * (i + 2) for i, w in enumerate(TENS)}
_WORDS = re.compile(rf"\b(?:({'|'.join(TENS)})[\s-]({'|'.join(ONES[1:10])})|({'|'.join([*TENS, *sorted(ONES, key=len, reverse=True)])}))\b", re.I)
_CN = re.compile(f"([{CHINESE}〇]?)(十)([{CHINESE}〇]?)|[{CHINESE}〇]")


def numeric_form(text: str) -> str:
    """One form for numbers however they are written: digits, number words to 99, percent signs, minus signs."""
    t = unicodedata.normalize("NFKC", text).translate({ord(d): "-" for d in DASHES})
    t = re.sub(r"\b10\s*-\s*(\d)", r"10-\1", t)
    t = _WORDS.sub(lambda m: str(_NUMBER[m[1].lower()] + _NUMBER[m[2].lower()] if m[1] else _NUMBER[m[3].lower()]), t)
    value = lambda c, empty: empty if not c else CHINESE.index(c.replace("〇", "零"))
    t = _CN.sub(lambda m: str(10 * value(m[1], 1) + value(m[3], 0) if m[2] else value(m[0], 0)), t)
    t = re.sub(r"(\d)\s*(?:percent|per cent|%|个百分点)", r"\1%", t, flags=re.I)
    return re.sub(r"\s+", " ", t)


def number_bounded(hay: str, needle: str) -> bool:
    if not re.search(r"\d", needle):
        return needle in hay
    return re.search(rf"(?<![\d.,]){re.escape(needle)}(?![\d.,]*\d)", hay) is not None


def stem(word: str) -> str:
    low = word.lower()
    return next((low[: -len(s)] for s in ("ions", "ion", "ing", "ies", "es", "ed", "s", "e") if low.endswith(s) and len(low) - len(s) >= 4), low)


def containment(slot_type: str | None, value: str, anchor: str) -> str | None:
    """How the anchor sentence holds a slot's value: exact, numeric, stem, or not at all."""
    if number_bounded(anchor, value):
        return "exact"
    if slot_type in ("value", "comparator") and number_bounded(numeric_form(anchor), numeric_form(value)):
        return "numeric"
    stems = lambda t: re.sub(r"[a-z]+", lambda m: stem(m[0]), t.lower())
    return "stem" if slot_type == "entity" and stems(value) in stems(anchor) else None


# a pattern for each operator, compiled once: there are more than re keeps
_OPERATORS = {op: re.compile(rf"\b{re.escape(op)}\b" if re.fullmatch(r"[a-z ]+", op) else ".*?".join(map(re.escape, op.split("……")))) for ops in NEGATIONS.values() for op in ops}


def _find(op: str, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _OPERATORS[op].finditer(text)]


def polarity(payload: str, sentence: str) -> str:
    """'pass', or the classes of the operators in whose scope the payload stands, in the order of the table.

    Classes S and R reach from the operator to the end of its clause, C to the end of the sentence, L over the
    payload right behind it; N, Q and I cover their clause or the whole. An even number of S in a clause cancels. A payload that
    has the operator itself is exempt. NEG-P: right before a number stands a word that is not known to assert it.
    """
    text, value = unicodedata.normalize("NFKC", sentence).lower(), unicodedata.normalize("NFKC", payload).lower()
    at = text.find(value)
    if at < 0:
        return "absent"
    clauses, start = [], 0
    for m in re.finditer(r"[;；，,](?!\d)|$", text):
        clauses.append((start, m.end()))
        start = m.end()
    own = next((c for c in clauses if c[0] <= at < c[1]), (0, len(text)))
    found = []
    for name, ops in NEGATIONS.items():
        spans = sorted({s for op in ops if (op in text or "……" in op) and op not in value for s in _find(op, text)})
        merged: list[list[int]] = []
        for a, b in spans:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        inside = [s for s in merged if own[0] <= s[0] < own[1]]
        if name == "NEG-S":
            hit = len([s for s in inside if s[1] <= at]) % 2 == 1
        elif name == "NEG-R":
            hit = any(s[1] <= at for s in inside)
        elif name == "NEG-C":
            hit = any(s[0] <= at for s in merged)
        elif name == "NEG-L":
            hit = any(s[1] <= at <= s[1] + 3 for s in merged)
        elif name == "NEG-I":
            hit = bool(merged)
        else:
            hit = bool(inside)
        if hit:
            found.append(name)
    if is_number(value) and not asserting(word_before(text, at)):
        found.append("NEG-P")
    return ",".join(found) or "pass"


def is_number(value: str) -> bool:
    """Whether a payload as a whole is a number, but for its currency, percent sign or scale."""
    core = re.sub(r"\s*(?:million|billion|thousand|万|亿|千|百分点|个百分点)$", "", re.sub(r"[%‰]$", "", re.sub(r"^[$¥€£]", "", value.strip())), flags=re.I)
    return re.fullmatch(r"[-−+]?[\d〇一二三四五六七八九十百千万亿]+(?:\.\d+)?", re.sub("[,，]", "", core).strip()) is not None


def word_before(text: str, at: int) -> str:
    """The word, or run of Chinese characters, that ends right before a place; empty at the start and after a mark."""
    m = re.search(r"([\u4e00-\u9fff]+|[A-Za-z]+)[\s(（【\[「『\"']*$", text[:at])
    return m[1].lower() if m else ""


def asserting(word: str) -> bool:
    return not word or (word in BEFORE_NUMBERS if word.isascii() else word.endswith(tuple(w for w in BEFORE_NUMBERS if not w.isascii())))


def frame(value: str, discriminator: str, sentence: str) -> str:
    """Whether a number is told apart from competing readings of its unit in the sentence.

    'alone': no other number of the unit; 'told': the discriminator stands in the value's part and in no other; else 'ambiguous'.
    """
    text = re.sub(r"(?<=\d),(?=\d{3})", "", unicodedata.normalize("NFKC", sentence))
    text = re.sub(r"\(?95% CI[^)]*\)?|\bp\s*[<=>]\s*0?\.\d+|\bI2\s*=\s*\d+%", " ", text)
    parts = [p for p in re.split(r"[;；，,]| and (?=[^;,]*\d)|与", text) if p.strip()]
    unit = re.sub(r"[\d.\s]", "", value)
    number = re.compile(rf"(?<![\w.])\d+(?:\.\d+)?\s*{re.escape(unit)}(?!\w)" if unit else r"(?<![\w.])\d+(?:\.\d+)?(?![\w.%])")
    mine = [p for p in parts if number_bounded(p, value)]
    if not mine:
        return "absent"
    rivals = [p for p in parts if p not in mine and number.search(p)]
    if not rivals and len(number.findall(mine[0])) < 2:
        return "alone"
    told = bool(discriminator) and discriminator.lower() in mine[0].lower() and not any(discriminator.lower() in r.lower() for r in rivals)
    return "told" if told and len(number.findall(mine[0])) < 2 else "ambiguous"


def counter_scan(entities: str, query: str, results: str, support: str, known: str) -> str:
    """Whether a search for counter-evidence counts: 'pass' or the first of five conditions that fails (lists are comma-separated)."""
    split = lambda x: [y for y in x.split(",") if y]
    words = re.findall(r"[a-z0-9]+", query.lower())
    asked = [re.findall(r"[a-z0-9]+", e.lower()) for e in split(entities)]
    if not all(set(e) <= set(words) for e in asked):
        return "a"
    extra = [w for w in words if not any(w in e for e in asked)]
    compared = any(w in COUNTER_COMPARE for w in extra)
    if len(extra) > 8 or any(w not in CONTROLLED and not (compared and w.isdigit()) for w in extra):
        return "b"
    # exactly one operator: a negation, another number under comparison, one or two words of contrary literature; a negation right before such a word is one with it
    chinese = [w for w in COUNTER_LITERATURE if not w.isascii() and w in query]
    negated = any(w in COUNTER_NOT for w in extra) or any(w in query for w in COUNTER_NOT if not w.isascii() and not any(w in c for c in chinese))
    contrary = {w for w in extra if w in COUNTER_LITERATURE} | set(chinese)
    joined = any(a in COUNTER_NOT and (b in COUNTER_LITERATURE or b in COUNTER_NEUTRAL) for a, b in zip(words, words[1:], strict=False))
    number = compared and any(w.isdigit() for w in extra)
    if len(contrary) > 2 or (negated and not (joined and contrary)) + bool(contrary) + number != 1:
        return "c"
    got = set(split(results))
    if got and got <= set(split(support)):
        return "d"
    return "pass" if got <= set(split(known)) else "e"


def bare_numbers(skeleton: str) -> list[str]:
    """Numbers of a skeleton that stand outside placeholders {{claim.field}}; years, ordinals and parts of names are none, nor is the unit behind a placeholder."""
    text = re.sub(r"\{\{[^}]*\}\}", "\0", unicodedata.normalize("NFKC", skeleton))
    out = []
    for m in re.finditer(r"(?<![\w.])\d+(?:\.\d+)?(?:[eE][+-]?\d+)?", text):
        before, after = text[: m.start()], text[m.end() :]
        year = re.fullmatch(r"(19|20)\d\d", m[0]) and (re.match(r"\s*年", after) or re.search(r"[(（]\s*$", before) and re.match(r"\s*[)）]", after))
        ordinal = "." not in m[0] and re.search(r"(第|§|No\.|Section|Table|Tab\.|Figure|Fig\.|Chapter|表|图)\s*$", before, re.I)
        hyphened = (after[:1] == "-" and after[1:2].isdigit()) or re.search(r"\d-$", before)
        named = re.search(r"[A-Za-z]-?$", before) or (hyphened and re.search("[A-Za-z]", before.rstrip()[-8:]))
        counted = re.match(rf"\s*(?:{UNITS})(?!\w)", after)
        if not (year or not counted and (ordinal or named)):
            out.append(m[0])
    for pattern in (rf"(?<![A-Za-z])[IVXLCDM]{{2,}}\s*(?:{UNITS})", rf"[{CHINESE_NUMBER}]{{2,}}\s*(?:{UNITS}|百分点|分之)", f"百分之[{CHINESE_NUMBER}]+"):
        out += [m[0].strip() for m in re.finditer(pattern, text) if not text[: m.start()].rstrip().endswith("\0")]
    return out


def render(value: str, status: str, sources: int, clusters: int) -> str:
    return f"{value}〔{MARKS.get(status, '?' + status)}，来源 {sources}/独立簇 {clusters}〕"


def exact_url(url: str | None) -> str | None:
    """The canonical form of any URL; a malformed port leaves the authority as it is."""
    if not url:
        return None
    raw = url.strip()
    parts = urlsplit(raw if "//" in raw else "//" + raw)
    scheme = parts.scheme.lower() or "https"
    place = parts.netloc.lower()
    try:
        port = parts.port
        place = (parts.hostname or "") + (f":{port}" if port is not None and (scheme, port) not in (("http", 80), ("https", 443)) else "")
    except ValueError:
        pass
    path = re.sub("/{2,}", "/", parts.path)
    path = path[:-1] if len(path) > 1 and path.endswith("/") else path
    pairs = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in ("gclid", "fbclid", "ref") and not k.lower().startswith("utm_")]
    return urlunsplit((scheme, place.removeprefix("www."), path, urlencode(pairs), ""))


def merge_patch(target: str | None, patch: str | None) -> str | None:
    """A JSON merge patch (RFC 7386) in canonical form: null removes a key, objects merge, all else replaces. A null text is no document."""
    if target is None or patch is None:
        return target

    def over(old, new):
        if not isinstance(new, dict):
            return new
        left = old if isinstance(old, dict) else {}
        return {k: v for k, v in left.items() if k not in new} | {k: over(left.get(k), v) for k, v in new.items() if v is not None}

    return json.dumps(over(json.loads(target), json.loads(patch)), sort_keys=True, ensure_ascii=False)


def rowwise(f, *columns, kind: DataType = StringType()):
    """f over the columns, an Arrow batch at a time; null where any argument is."""

    @F.pandas_udf(kind)
    def batch(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([None if any(x is None for x in r) else f(*r) for r in rows.itertuples(index=False)], dtype=object)

    return batch(F.struct(*columns))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFC", t)).strip().casefold())


@F.pandas_udf(StringType())
def canonical_url(url: pd.Series) -> pd.Series:
    return url.map(exact_url)


@F.pandas_udf(StringType())
def numeric(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else numeric_form(t))
