"""Statistics of whole texts, computed for an Arrow batch at a time.

Words are ``[^\\x20\\x09-\\x0D]+``; lines are split at ``\\n``. Counting runs on
the batch's UTF-8 buffer with numpy; only word interning and line comparison
touch Python objects.
"""

from __future__ import annotations

import numpy as np

from fleetcast.llm.common import SPACE, mix, row_sums

#: Fixed by the contract of the quality rules.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True
IS_START = np.ones(256, bool)            # bytes that begin a code point
IS_START[0x80:0xC0] = False


def class_counts(raw: np.ndarray, at: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Bytes of a class in each row."""
    return row_sums(flags[raw].astype(np.int8), at)


def intern_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(word ids, n + 1 word offsets of the rows, distinct words)."""
    buffer, known = raw.tobytes(), {}
    ids, ends = [], [0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        ids.extend([known.setdefault(w, len(known)) for w in buffer[a:b].split()])
        ends.append(len(ids))
    return np.array(ids, np.int64), np.array(ends, np.int64), list(known)


def repeated_words(ids: np.ndarray, at: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Per row, the words that lie in a ``width``-word window found twice or
    more in that row (the first one included). Windows are compared by 64-bit
    hashes of (row, word numbers)."""
    n, rows = len(ids), len(at) - 1
    if n < width:
        return np.zeros(rows, np.int64)
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(at))
    word = mix(ids.astype(np.uint64) + np.uint64(1))
    key = mix(row[:n - width + 1].astype(np.uint64))
    for k in range(width):
        key = (key ^ word[k:n - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    where = np.flatnonzero(row[:n - width + 1] == row[width - 1:])
    key = key[where]
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered, start = np.zeros(n, bool), where[twice]
    for k in range(width):
        covered[start + k] = True
    return row_sums(covered.astype(np.int8), at)


def duplicate_lines(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per row, the lines with a word that equal an earlier line of the row."""
    buffer, out = raw.tobytes(), np.zeros(len(at) - 1, np.int64)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        lines = [x for x in buffer[a:b].split(b"\n") if x and not x.isspace()]
        out[i] = len(lines) - len(set(lines))
    return out


def base_stats(raw: np.ndarray, at: np.ndarray, ids: np.ndarray, word_at: np.ndarray) -> dict[str, np.ndarray]:
    """The contract's base counts for each row of a batch: its bytes and
    offsets (text_bytes) and its words (intern_words)."""
    return {
        "n_words": np.diff(word_at),
        "word_chars": class_counts(raw, at, IS_START & ~SPACE),
        "n_symbols": class_counts(raw, at, IS_SYMBOL),
        "n_dup_lines": duplicate_lines(raw, at),
        "n_repeat_words": repeated_words(ids, word_at),
    }
