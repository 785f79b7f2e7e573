"""Word shingles as 64-bit hashes, for a batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from millrace.llm.common import mixed, span_hashes, text_bytes, word_spans

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes inside words: all but the space and the controls from tab to carriage return.
_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, *range(0x09, 0x0E)]] = False
_STEP = 0xD6E8FEB86659FD93


def shingle_sets(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after another, and where each text's begin (one more at the end).

    A text of fewer words than ``size`` is one shingle, a text without words has none. The order of hashes is that of
    signed 64-bit numbers.
    """
    raw, offsets = text_bytes(column)
    start, end, doc = word_spans(_LOWER[raw], offsets, _INSIDE)
    words = span_hashes(_LOWER[raw], start, end)
    rows = len(column)
    count = np.bincount(doc, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])
    powers = np.array([pow(_STEP, k + 1, 1 << 64) for k in range(size)], np.uint64)
    full = np.zeros(0, np.uint64)
    owner = np.zeros(0, np.int64)
    if len(words) >= size:
        n = len(words) - size + 1
        full = words[:n] * powers[0]
        for k in range(1, size):
            full = full + words[k : n + k] * powers[k]
        whole = doc[:n] == doc[size - 1 :]
        full, owner = mixed(full[whole]), doc[:n][whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        alone = [sum(int(words[first[d] + k]) * int(powers[k]) for k in range(count[d])) + int(count[d]) * 0x9E3779B9 for d in short]
        full = np.concatenate([full, mixed(np.array([x % (1 << 64) for x in alone], np.uint64))])
        owner = np.concatenate([owner, short])
    full = full.view(np.int64)
    by = np.lexsort((full, owner))
    full, owner = full[by], owner[by]
    if len(full):
        fresh = np.ones(len(full), bool)
        fresh[1:] = (full[1:] != full[:-1]) | (owner[1:] != owner[:-1])
        full, owner = full[fresh], owner[fresh]
    return full, np.searchsorted(owner, np.arange(rows + 1))
