"""Vectorised tokenising and hashing of Arrow text columns.

Everything works on the UTF-8 bytes of a run of documents at once: a table of
256 flags says which bytes belong to words, so tokens of a whole run come from
a few numpy passes instead of a Python loop per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SPACE = bytes([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()

NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[list(SPACE)] = False

ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

RUN_BYTES, LONG_WORD = 1 << 18, 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_STEP2 = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = (np.full(size, x, dtype=np.uint64) for x in (base, inverse))
        up[0] = down[0] = 1
        if len(_powers) > 8:
            _powers.clear()
        have = _powers[int(base)] = np.cumprod(up), np.cumprod(down)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Words:
    """Words of consecutive documents: byte bounds, and the first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: bool):
        self.data = LOWER[data] if fold else data
        self.offsets = offsets
        size = len(data)
        inside = table[self.data]
        open_, close = inside.copy(), inside.copy()
        filled = offsets[:-1][offsets[1:] > offsets[:-1]]
        if size:
            before = np.zeros(size, dtype=bool)
            before[1:] = inside[:-1]
            before[filled] = False
            open_ &= ~before
            after = np.zeros(size, dtype=bool)
            after[:-1] = inside[1:]
            after[filled[filled > 0] - 1] = False
            close &= ~after
        self.starts = np.flatnonzero(open_)
        self.ends = np.flatnonzero(close) + 1
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, key: int = 0) -> np.ndarray:
        """A hash of each word: of a polynomial of its bytes with a base that key varies, or XXH3 for long words.

        With a key that texts cannot know, equal hashes cannot be contrived.
        """
        up, down = _pow(_BASE ^ np.uint64(key << 1), len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
        size = self.ends - self.starts
        h = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + size.astype(np.uint64))
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.word(i), key)
        return h

    def rolling(self, hashes: np.ndarray, width: int, second: bool = False, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every run of width words inside one document."""
        total = len(hashes)
        if total < width:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        base = (_STEP2 if second else _STEP) ^ np.uint64(key << 1)
        up, down = _pow(base, total + 1)
        sums = np.zeros(total + 1, dtype=np.uint64)
        np.cumsum(hashes * up[:total], out=sums[1:])
        h = mix((sums[width:] - sums[:-width]) * down[: total - width + 1])
        keep = np.ones(total - width + 1, dtype=bool)
        for back in range(1, width):  # a run must not begin in the last width - 1 words of a document
            at = self.first[1:] - back
            keep[at[(at >= 0) & (at < len(keep)) & (at >= self.first[:-1])]] = False
        starts = np.flatnonzero(keep)
        return starts, h[starts]

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def run(self, lo: int, hi: int) -> list[bytes]:
        return [self.word(i) for i in range(lo, hi)]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document bounds of a text column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(at):
        return np.empty(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def runs(texts: pa.Array, limit: int = RUN_BYTES):
    """(first document, end document, bytes, bounds): whole documents, about limit bytes at a time."""
    data, at = buffers(texts)
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(texts: pa.Array, table: np.ndarray, fold: bool):
    for lo, hi, data, at in runs(texts):
        yield lo, hi, Words(data, at, table, fold)
