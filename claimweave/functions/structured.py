"""Addressable passages of full texts: JATS and the HTML that LaTeXML makes. Python over Arrow batches, as sections nest."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PASSAGES = "array<struct<ord:int,locator:string,text:string,sec:string,title:string>>"
# fixed values: the references that are decoded, &amp; last
REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x2019;", "’"), ("&#8217;", "’"), ("&#xa0;", " "), ("&nbsp;", " "), ("&amp;", "&")]

_JATS = re.compile(r"<(/?)(sec|title|p)\b([^>]*)>", re.I)
_BLOCKS = re.compile(r"<(/?)(section|div|p)\b([^>]*)>", re.I)


def plain(xml: str) -> str:
    """Scripts, styles and tags out, references decoded, blanks squeezed."""
    text = re.sub(r"(?s)<[^>]+>", "", re.sub(r"(?is)<(?:script|style).*?</(?:script|style)>", " ", xml))
    for name, char in REFERENCES:
        text = text.replace(name, char)
    return re.sub(r"\s+", " ", text).strip()


def attribute(attrs: str, name: str) -> str | None:
    m = re.search(rf"""\b{name}=["']([^"']+)["']""", attrs, re.I)
    return m[1] if m else None


def jats(xml: str) -> list[dict]:
    """The paragraphs of the body in page order. One without an id has no locator; a section without id or title has those around it."""
    m = re.search(r"(?is)<body\b[^>]*>(.*)</body>", xml)
    body = m[1] if m else xml
    found: list[tuple[str | None, str, dict]] = []
    secs: list[dict] = [{"id": None, "title": None, "own": True}]
    start = depth = 0
    pid = title = None
    for m in _JATS.finditer(body):
        closing, tag, attrs = m[1], m[2].lower(), m[3]
        if attrs.endswith("/"):
            continue
        if tag == "sec" and not closing:
            secs.append({"id": attribute(attrs, "id") or secs[-1]["id"], "title": None, "own": False, "around": secs[-1]})
        elif tag == "sec":
            depth, title = 0, None
            if len(secs) > 1:
                secs.pop()
        elif tag == "title" and not closing:
            title = m.end()
        elif tag == "title":
            if title is not None and not secs[-1]["own"]:
                secs[-1]["title"], secs[-1]["own"] = plain(body[title : m.start()]) or None, True
            title = None
        elif not closing:
            if not depth:
                start, pid = m.end(), attribute(attrs, "id")
            depth += 1
        elif depth:
            depth -= 1
            if not depth and (text := plain(body[start : m.start()])):
                found.append((pid, text, secs[-1]))
    out = []
    for k, (pid, text, sec) in enumerate(found):
        named = sec
        while named["title"] is None and "around" in named:
            named = named["around"]
        locator = None if pid is None else f"jats:{sec['id']}/{pid}" if sec["id"] else f"jats:{pid}"
        out.append({"ord": k + 1, "locator": locator, "text": text, "sec": sec["id"], "title": named["title"]})
    return out


def latexml(html: str) -> list[dict]:
    """The blocks whose ids are those of paragraphs (S3.SS1.p2), in page order; of a repeated id the first. An unclosed block ends with the page."""
    opened: list[list] = []
    found: list[list] = []
    seen = set()
    for m in _BLOCKS.finditer(html):
        closing, tag = m[1], m[2].lower()
        if m[3].endswith("/"):
            continue
        for one in opened:
            if one[0] == tag:
                one[1] += -1 if closing else 1
                if not one[1]:
                    one[3] = m.start()
        opened = [one for one in opened if one[1]]
        key = None if closing else attribute(m[3], "id")
        if key and re.fullmatch(r"S\d[\w.]*\.p\d+", key, re.I) and key not in seen:
            seen.add(key)
            opened.append(one := [tag, 1, m.end(), len(html), key])
            found.append(one)
    texts = [(key, text) for _, _, a, b, key in found if (text := plain(html[a:b]))]
    return [{"ord": k + 1, "locator": f"html:#{key}", "text": text, "sec": key.split(".p")[0], "title": None} for k, (key, text) in enumerate(texts)]


def passages_by(parse: Callable[[str], list[dict]]) -> Callable[[str], Column]:
    @F.pandas_udf(PASSAGES)
    def batch(docs: pd.Series) -> pd.Series:
        return docs.map(lambda d: [] if d is None else parse(d))

    return batch


PARSERS = {"jats": jats, "html": latexml}
