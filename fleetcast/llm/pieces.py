"""Tokenizing whole texts piece by piece, with a bounded memory of pieces.

A text is cut only where no token can cross, so the ids of the text are those
of its pieces, one after the other. The pieces of an Arrow batch are cut from
its bytes and made distinct there; only distinct pieces that were not met
before reach the tokenizer, and the ids of all rows are gathered at once.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

from fleetcast.llm.common import text_bytes

#: Pieces that are remembered, and ids of all of them. When the memory is full,
#: the pieces that the latest batch used again stay. Longer ones are never kept.
KEPT, KEPT_IDS, KEPT_LENGTH = 200_000, 2_000_000, 48

#: The pieces of some rows: their bytes, the n + 1 offsets of the pieces in
#: them, and the number of pieces before each row (and in all).
Cut = tuple[np.ndarray, np.ndarray, np.ndarray]


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level
    vocabulary: Latin-1's visible characters stand for themselves, the other
    bytes take the code points from 256 on, in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def before(raw: np.ndarray, k: int = 1) -> np.ndarray:
    """The byte ``k`` places before each; 0 where there is none."""
    out = np.zeros_like(raw)
    out[k:] = raw[:len(raw) - k] if k < len(raw) else 0
    return out


def starts_cut(raw: np.ndarray, at: np.ndarray, start: np.ndarray) -> Cut:
    """Pieces that begin at each row and where ``start`` is true; every byte
    belongs to one."""
    start = start.copy()
    start[at[:-1][at[:-1] < at[1:]]] = True
    first = np.flatnonzero(start)
    return raw, np.append(first, len(raw)), np.searchsorted(first, at)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range, one after the other."""
    end = np.cumsum(length)
    return np.repeat(start - (end - length), length) + np.arange(end[-1] if len(end) else 0)


class Pieces:
    """Ids of the rows of a column. ``cut(raw, offsets)`` gives the pieces of
    some rows; ``learn(pieces)`` gives the ids of some pieces (bytes), one after
    the other, and how many each has."""

    def __init__(self, cut: Callable[[np.ndarray, np.ndarray], Cut],
                 learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kept: int = KEPT):
        self.cut, self.learn, self.kept = cut, learn, kept
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.int32)                 # ids of known pieces, one after the other
        self.at = np.zeros(1, np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and the n + 1 offsets of the rows in them. A
        null has no ids."""
        raw, at = text_bytes(column)
        data, piece_at, first = self.cut(raw, at)
        if len(piece_at) < 2:
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(piece_at) - 1, [
            None, pa.py_buffer(np.ascontiguousarray(piece_at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct, indices, met = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy(), len(self.at) - 1
        number = self._numbers(distinct)
        code = number[indices]
        length = self.at[code + 1] - self.at[code]
        before_piece = np.concatenate(([0], np.cumsum(length)))
        ids = self.flat[ranges(self.at[code], length)]
        if len(self.known) > self.kept or len(self.flat) > KEPT_IDS:
            again = np.flatnonzero((number < met) | (np.bincount(indices, minlength=len(distinct)) > 1))
            again = [i for i in again[:self.kept // 2].tolist() if len(distinct[i]) <= KEPT_LENGTH]
            kept = number[again]
            sizes = self.at[kept + 1] - self.at[kept]
            self.flat = self.flat[ranges(self.at[kept], sizes)]
            self.at = np.concatenate(([0], np.cumsum(sizes)))
            self.known = {distinct[i]: j for j, i in enumerate(again)}
        return ids, before_piece[first]

    def _numbers(self, distinct: list[bytes]) -> np.ndarray:
        """The place of each piece in ``at``; new ones are learnt."""
        known = self.known
        number = [known.get(p, -1) for p in distinct]
        new = [i for i, k in enumerate(number) if k < 0]
        if new:
            ids, sizes = self.learn([distinct[i] for i in new])
            n = len(self.at) - 1
            for j, i in enumerate(new):
                number[i] = n + j
                if len(distinct[i]) <= KEPT_LENGTH:
                    known[distinct[i]] = n + j
            self.flat = np.concatenate((self.flat, ids))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(sizes)))
        return np.array(number, np.int64)


def flatten(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many there are in each row."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum())), sizes


def latin_letters(s: str) -> bool:
    """Only letters of Latin-1: one word for every splitting pattern, the same
    after NFC, and lower-cased alike everywhere."""
    return s.isalpha() and max(s) <= "\xff"
