"""Words of whole texts as 64-bit hashes, by array operations over the bytes of an Arrow column.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D. Its hash is a polynomial over its bytes,
taken for all words at once as differences of one running sum, then mixed with its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes hashed in one go; longer words are hashed alone.
SPAN = 1 << 20
#: Bytes of text that one step works on, unless one text is longer.
STEP = 1 << 20
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (xor-shift and multiply)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if _powers is None:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(SPAN, base, U64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers = (both[0], both[1])
    return _powers


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each of the spans [starts, ends), which don't overlap and ascend."""
    up, down = powers()
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = int(np.searchsorted(ends, lo + SPAN, "right"))
        if j <= i:
            out[i] = int.from_bytes(hashlib.blake2b(data[lo : ends[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        run = np.zeros(ends[j - 1] - lo + 1, U64)
        np.cumsum((data[lo : ends[j - 1]].astype(U64) + U64(1)) * up[: len(run) - 1], out=run[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((run[e] - run[s]) * down[s] + (e - s).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        i = j
    return out


@dataclass
class Texts:
    """Some consecutive texts of a batch. data: their bytes; at[i]: where text i begins; first: the
    number of the first in the batch; starts, ends: of the words; words[i]: the first word of text i."""

    data: np.ndarray
    at: np.ndarray
    first: int
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def texts(column: pa.Array, lower: bool = False, step: int | None = None) -> Iterator[Texts]:
    """The texts of a column in steps of about `step` bytes."""
    step = step or STEP
    data, at = column_bytes(column)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + step, "right")) - 1)
        part, begins = data[at[i] : at[j]], at[i : j + 1] - at[i]
        part = LOWER[part] if lower else part
        inside = np.zeros(len(part) + 2, bool)
        inside[1:-1] = IS_WORD[part]
        first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        full = begins[:-1][begins[1:] > begins[:-1]]  # where texts that aren't empty begin
        first[full] = inside[1:-1][full]
        last[full[1:] - 1] = inside[1:-1][full[1:] - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        yield Texts(part, begins, i, starts, ends, np.searchsorted(starts, begins))
        i = j
