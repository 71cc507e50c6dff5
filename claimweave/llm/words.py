"""Words of texts as bytes, for the operators that read whole texts in Arrow batches."""

from __future__ import annotations

import pyarrow as pa

#: Letters, digits and bytes above 127 stay (A-Z in lower case); all others part words.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column in UTF-8; a null is empty."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]
