"""Words of whole batches of texts, found on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def byte_class(outside: str) -> np.ndarray:
    """For each byte whether it belongs to words: all do but those of the ASCII characters ``outside``.

    The bytes of other characters are never ASCII, so a word of bytes is a word of characters.
    """
    inside = np.ones(256, bool)
    inside[np.frombuffer(outside.encode("ascii"), np.uint8)] = False
    return inside


#: White space as in the word rule.
WORD_BYTES = byte_class(" \t\n\x0b\f\r")


def split_words(texts: pa.Array, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and where each text's begin among them (one more at the end); null has none."""
    texts = texts.fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    held = inside[raw]
    begins = held.copy()
    begins[1:] &= ~held[:-1]
    heads = at[:-1][at[:-1] < len(raw)]
    begins[heads] = held[heads]
    starts = np.flatnonzero(begins)
    kept = raw[held]
    offsets = np.append(np.cumsum(held, dtype=np.int64)[starts] - 1, len(kept)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept)))
    return found, np.searchsorted(starts, at)


def runs_of_rows(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes of text in all, or of one row."""
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi
