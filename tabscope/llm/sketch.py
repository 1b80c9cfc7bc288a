"""Sketch cells gathered by partition and merged by range: saturating count-min rows and Bloom bits.

A key has one cell in each of two rows. A task reports the cells it saw once and those it saw more often, sorted and
delta-compressed by range of cells; each range is merged in one task into a bitmap of the cells reached ``level``
times. The bitmaps have a fixed number of bits, so what is collected and broadcast is bounded by ``2 ** bits / 4``
bytes, whatever the input.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import lean
from .words import mix64

SHARDS = 64
ROWS = 2
SCHEMA = "shard int, sketch_row int, once binary, more binary"


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    if row:
        keys = mix64(keys ^ np.uint64(0x9E3779B97F4A7C15))
    return keys >> np.uint64(64 - bits)


def bits_for(keys: float, least: int = 20, most: int = 30) -> int:
    """Row width (a power of two, as bits) of about eight cells a key, within bounds."""
    return int(min(most, max(least, np.ceil(np.log2(max(8 * keys, 1))))))


def _pack(values: np.ndarray) -> bytes:
    return zlib.compress(np.diff(values, prepend=np.uint64(0)).astype(np.uint32).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint32), dtype=np.int64)


def report(keys: np.ndarray, bits: int) -> pa.RecordBatch:
    """The cells of a task's keys (one entry a place; equal keys count each) as rows of SCHEMA."""
    shift = np.uint64(bits - 6)
    out = {"shard": [], "sketch_row": [], "once": [], "more": []}
    for row in range(ROWS):
        found, counts = np.unique(cells(keys, row, bits), return_counts=True)
        edges = np.searchsorted(found >> shift, np.arange(SHARDS + 1))
        for shard in range(SHARDS):
            part, n = found[edges[shard]:edges[shard + 1]] - np.uint64(shard << int(shift)), counts[edges[shard]:edges[shard + 1]]
            if len(part):
                out["shard"].append(shard)
                out["sketch_row"].append(row)
                out["once"].append(_pack(part[n == 1]))
                out["more"].append(_pack(part[n > 1]))
    return pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int32()), pa.array(out["sketch_row"], pa.int32()),
                                       pa.array(out["once"], pa.binary()), pa.array(out["more"], pa.binary())],
                                      ["shard", "sketch_row", "once", "more"])


def merged(reports: DataFrame, bits: int, level: int) -> list[np.ndarray]:
    """The two rows' bitmaps of cells counted at least ``level`` (1 or 2) times over all reports."""
    size = 1 << (bits - 6)

    @lean
    def merge(batches):
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for shard, row, once, more in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, row) not in held:
                    held[shard, row] = np.zeros(size, bool), np.zeros(size, bool)
                seen, again = held[shard, row]
                one, two = _unpack(once), _unpack(more)
                again[one] |= seen[one]
                again[two] = True
                seen[one] = True
                seen[two] = True
        for (shard, row), pair in held.items():
            bitmap = np.packbits(pair[level - 1], bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([row], pa.int32()), pa.array([bitmap], pa.binary())],
                                             ["shard", "sketch_row", "bitmap"])

    rows = reports.repartitionById(SHARDS, F.col("shard")).mapInArrow(merge, "shard int, sketch_row int, bitmap binary")
    out = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(ROWS)]
    for shard, row, bitmap in rows.toLocalIterator():
        out[row][shard * (size // 8):(shard + 1) * (size // 8)] = np.frombuffer(bytes(bitmap), np.uint8)
    return out


def reached(bitmaps: list[np.ndarray], keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether each key's cells are set in all rows: never False for a key counted ``level`` times."""
    ok = np.ones(len(keys), bool)
    for row, bitmap in enumerate(bitmaps):
        at = cells(keys, row, bits)
        ok &= (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok


