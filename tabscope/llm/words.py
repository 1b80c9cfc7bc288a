"""Words and word n-grams of Arrow text columns as 64-bit fingerprints (numpy, no per-word Python).

A word is a run of bytes other than space and \\x09-\\x0D. Word fingerprints are polynomial hashes over
per-byte random values, n-gram fingerprints are polynomial hashes over word fingerprints, both modulo 2^64
with odd multipliers, so that every run of words costs two prefix-sum look-ups. All arithmetic wraps.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

# Bytes up to which a word's polynomial is its fingerprint. Beyond, well-known words of 1024 bytes and more (Thue-Morse)
# collide for any multiplier modulo 2^64, so that longer words are hashed by BLAKE2. N-grams have far fewer words.
LONG = 64
CHUNK_BYTES = 4 << 20  # text hashed at a time; bounds the temporary arrays, not what is hashed


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply), a bijection."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base | 1), np.uint64(pow(base | 1, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = self._table(self.base, size)
            self.down = self._table(self.inverse, size)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: np.uint64, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair, position independent."""
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, *range(0x09, 0x0E)]] = False
_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE_VALUES.copy()
_BYTE_LOWER[65:91] = _BYTE_VALUES[97:123]
_BYTES = Powers(0x5851F42D4C957F2D)
_WORDS = (Powers(0x2545F4914F6CDD1D), Powers(0xD1342543DE82EF95))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has length 0."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


class Words:
    """Words of some texts: fingerprints, byte ranges in ``data`` and, by text, the range of its words."""

    def __init__(self, column: pa.Array | tuple[np.ndarray, np.ndarray], lower: bool = False, inside: np.ndarray = _INSIDE,
                 table: np.ndarray | None = None):
        """column: texts, or their (bytes, offsets); inside: which bytes make words; table: the value of each byte."""
        self.data, offsets = column if isinstance(column, tuple) else text_bytes(column)
        within = inside[self.data]
        first = within.copy()
        first[1:] &= ~within[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(self.data)]
        first[cuts] = within[cuts]
        self.starts = np.flatnonzero(first)
        last = within.copy()
        last[:-1] &= ~within[1:]
        tails = offsets[1:][offsets[1:] > 0] - 1
        last[tails] = within[tails]
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.table = table if table is not None else _BYTE_LOWER if lower else _BYTE_VALUES
        self.hashes = self.spans(self.ends)
        for i in np.flatnonzero(self.ends - self.starts > LONG):  # few; see LONG
            self.hashes[i] = self._long(self.starts[i], self.ends[i])

    def _long(self, start: int, end: int) -> np.uint64:
        """Fingerprint of one word's bytes, as ``table`` maps them, that no choice of bytes collides on purpose."""
        out = blake2b(digest_size=8)
        for at in range(start, end, CHUNK_BYTES):
            out.update(self.table[self.data[at:min(end, at + CHUNK_BYTES)]].tobytes())
        return np.uint64(int.from_bytes(out.digest(), "little"))

    def spans(self, ends: np.ndarray) -> np.ndarray:
        """Fingerprint of the bytes from each word's start to the given ends (not past the word's own)."""
        out = np.empty(len(self.starts), np.uint64)
        done = 0
        while done < len(self.starts):  # whole words, about CHUNK_BYTES at a time
            base = self.starts[done]
            upto = max(done + 1, int(np.searchsorted(self.ends, base + CHUNK_BYTES)))
            piece = self.table[self.data[base:self.ends[upto - 1]]]
            out[done:upto] = run_hashes(piece, self.starts[done:upto] - base, ends[done:upto] - base, _BYTES)
            done = upto
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def grams(self, size: int, seed: int = 0) -> np.ndarray:
        """Fingerprint of the ``size`` words from each word on; meaningless where a text has fewer left (see valid)."""
        n = len(self.hashes)
        at = np.arange(n)
        return run_hashes(self.hashes, at, np.minimum(at + size, n), _WORDS[seed])

    def runs(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Fingerprints of the words [first, last) for each pair."""
        return run_hashes(self.hashes, first, last, _WORDS[0])

    def left(self) -> np.ndarray:
        """For each word the number of words of its text from it on."""
        return np.repeat(self.bounds[1:], self.counts()) - np.arange(len(self.hashes))


def pieces(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text (one longer text makes a run of its own)."""
    column = batch.column(batch.schema.get_field_index(text))
    if len(column) == 0:
        return
    _, offsets = text_bytes(column)
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def pairs_index(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of an (n, 2) array, sorted, and each row's index among them."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (pairs[order][1:] != pairs[order][:-1]).any(1)
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(new) - 1
    return pairs[order][new], index
