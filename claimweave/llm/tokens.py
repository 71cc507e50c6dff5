"""Operator 4. Token counts by the whole-token shortcut.

prove() reads the vocabulary once and shows which of its strings encode alone as one token, and that no
vocabulary string runs from a visible character into a word mark. Then a text splits before every run of
blanks into parts that no merge crosses, a part that is a proven string counts one, and only the rest is
merged (by the library, on the part alone). A bounded memory of merged parts serves repeated ones.

Defined results: null counts as the empty text (no tokens, no bytes); strings of special tokens in a text
are ordinary text; whole texts are counted, however long; unpaired surrogates cannot occur in Spark
strings; repeated rows give repeated results; other columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Merged parts that a worker remembers, and the longest part that it does.
MEMORY, LONGEST = 400_000, 64
#: Texts that are counted together.
TEXTS = 256
#: A part: a run of blanks (or marks) with the visible characters after it.
PART = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+$")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def prove(model_file: str) -> set[str]:
    """The strings that encode alone as one token, as they stand in a text; raises if parts could merge across."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    with open(model_file, "rb") as f:
        spec = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    norm = spec.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
        raise ValueError("the shortcut is proven only for models that keep texts as they are")
    normal = [p.piece for p in spec.pieces if p.type == 1]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in normal) or any(p.type == 4 for p in spec.pieces):
        raise ValueError("a vocabulary string crosses the start of a word")
    sp = SentencePieceProcessor(model_file=model_file)
    marked = [p for p in normal if p.startswith(MARK)]
    alone = sp.encode([p[1:].replace(MARK, " ") for p in marked])
    whole = {p.replace(MARK, " ") for p, ids in zip(marked, alone, strict=True) if len(ids) == 1}
    # a mark at the end of a text stands alone and has nothing to merge with
    return whole | ({" ", MARK} if len(sp.encode("a ")) == len(sp.encode("a")) + 1 else set())


class TokenCounter:
    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_file=model_file)
        self.whole = dict.fromkeys(prove(model_file), 1)
        self.known = dict(self.whole)

    def __call__(self, texts: list[str]) -> list[int]:
        """The counts of some texts. Parts that several of them have are merged once and remembered."""
        # the library puts one blank before a text that isn't empty; its own mark is a blank to it
        parts = [PART.findall(" " + t) if t else [] for t in texts]
        known, out, rest = self.known, [], []
        for own in parts:
            found = [known.get(p) or p for p in own]
            rest.append(missing := [p for p in found if p.__class__ is str])
            out.append(sum([n for n in found if n.__class__ is int]) if missing else sum(found))
        times = Counter(chain.from_iterable(rest))
        shared = [p for p, n in times.items() if n > 1 and len(p) <= LONGEST]
        now = dict(zip(shared, map(len, self.sp.encode([p[1:] for p in shared], num_threads=1)), strict=True))
        for i, missing in enumerate(rest):
            if missing:
                out[i] += sum(map(now.get, missing, repeat(0)))
                # no merge crosses the start of a part, so the parts left over are merged together
                out[i] += len(self.sp.encode("".join([p for p in missing if p not in now])[1:], num_threads=1))
        known.update(now)
        if len(known) > MEMORY + len(self.whole):
            self.known = dict(self.whole)
        return out


def token_counts(docs: DataFrame, text_col: str = "text", model_file: str | None = None, limit: int = 4096) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit. model_file must be readable on every executor."""
    model_file = model_file or default_model()

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(model_file)
        for texts in batches:
            own = texts.fillna("").tolist()
            yield pd.Series([n for i in range(0, len(own), TEXTS) for n in counter(own[i : i + TEXTS])], dtype="int64")

    rows = docs.drop("n_bytes", "n_tokens", "over_limit")
    text = F.col(text_col).cast("string")
    return rows.withColumn("n_tokens", count(text)).withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "over_limit": F.col("n_tokens") > limit})
