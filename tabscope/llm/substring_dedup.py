"""Substring deduplication with a count-min prefilter.

A window is ``window`` consecutive words. Its sketch key is its minimiser, the smallest fingerprint among its runs of
``window // 2 + 1`` words: equal windows share it at different places, so the number of places of a key is never below
the number of places of a window, and about one place in ten words is counted. Every task reports a count-min sketch
of its places; the merged sketch overestimates, so windows whose key is estimated below two occur once. A second pass
groups only the others exactly, by 96-bit fingerprints. Within a task equal windows are joined first: a window that
repeats there is known to repeat and sends one entry, so a hot window costs one entry a task.

The sketch grows with the text up to ``2 ** 30`` cells a row; beyond, more windows pass to the exact grouping, none is
lost.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .memory import lean
from .store import bucket_count, plain, text_volume
from .words import Words, pairs_index, pieces

WINDOW = 35
BUCKET_BYTES = 24 << 20  # text whose windows one exact-grouping task sees on average
FLUSH = 1 << 21  # entries a task gathers before it sends them
EXCHANGE = "bucket int, hashes binary, tails binary, singles int, keys binary, counts binary, positions binary"
_NAMES = ["bucket", "hashes", "tails", "singles", "keys", "counts", "positions"]


def slide(values: np.ndarray, size: int, pick) -> np.ndarray:
    """pick over values[i:i + size] for each i (shorter at the end), by doubling."""
    out, have = values.copy(), 1
    while have < size:
        step = min(have, size - have)
        out[:-step] = pick(out[:-step], out[step:])
        have += step
    return out


class Places:
    """Windows of a piece of text: sketch keys and the places that count for them."""

    def __init__(self, words: Words, window: int):
        run = window // 2 + 1
        span = window - run + 1
        left = words.left()
        self.valid = left >= window
        grams = words.grams(run) | np.uint64(1)
        grams[left < run] = ~np.uint64(0)
        self.keys = slide(grams, span, np.minimum) if len(grams) else grams
        lows = np.where(self.valid, self.keys, np.uint64(0))
        # a place counts if it is the minimum of any window over it
        best = slide(np.concatenate([np.zeros(span - 1, np.uint64), lows]), span, np.maximum)[:len(lows)]
        self.counted = grams[(best == grams) & (left >= run)]


def sketch_windows(rows: DataFrame, window: int, bits: int) -> list[np.ndarray]:
    """Bitmaps of sketch cells counted at least twice over all texts."""

    @lean
    def run(batches):
        held, n = [], 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = Places(Words(piece.column(2)), window).counted
                held.append(found)
                n += len(found)
                if n >= FLUSH:
                    yield sketch.report(np.concatenate(held), bits)
                    held, n = [], 0
        if n:
            yield sketch.report(np.concatenate(held), bits)

    return sketch.merged(rows.mapInArrow(run, sketch.SCHEMA), bits, 2)


def exchange(keys: np.ndarray, doc: np.ndarray, position: np.ndarray, hashes: np.ndarray, tails: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of EXCHANGE for a task's candidate windows. keys: (docs, 2); the others by window.

    Of the entries of a row the first ``singles`` are windows seen once here, with their places (by document); the rest
    were seen more often. Places of the latter are known repeats and travel without hashes, dealt by document.
    """
    order = np.lexsort((tails, hashes))
    doc, position, hashes, tails = doc[order], position[order], hashes[order], tails[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (tails[1:] != tails[:-1])
    group = np.cumsum(new) - 1
    size = np.bincount(group, minlength=1)
    alone = size[group] == 1
    out = {name: [] for name in _NAMES}

    def add(bucket, h, t, singles, d, p):
        held, counts = np.unique(d, return_counts=True) if len(d) else (d, d)
        out["bucket"].append(bucket)
        out["hashes"].append(h.tobytes())
        out["tails"].append(t.tobytes())
        out["singles"].append(singles)
        out["keys"].append(keys[held].tobytes())
        out["counts"].append(counts.astype(np.uint32).tobytes())
        out["positions"].append(p.astype(np.uint32).tobytes())

    target = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    several = new & ~alone
    one = np.flatnonzero(alone)
    one = one[np.lexsort((position[one], doc[one], target[one]))]
    many = np.flatnonzero(several)  # sorted by hash, so by bucket
    ones, manys = (np.searchsorted(target[x], np.arange(buckets + 1)) for x in (one, many))
    for bucket in np.flatnonzero(np.diff(ones) + np.diff(manys)):
        a, b = one[ones[bucket]:ones[bucket + 1]], many[manys[bucket]:manys[bucket + 1]]
        both = np.concatenate([a, b])
        add(int(bucket), hashes[both], tails[both], len(a), doc[a], position[a])
    known = np.flatnonzero(~alone)
    known = known[np.lexsort((position[known], doc[known]))]
    none = np.zeros(0, np.uint64)
    for part in np.array_split(known, max(1, len(known) // 50_000)) if len(known) else []:
        add(int(keys[doc[part[0]], 0] % buckets), none, none.astype(np.uint32), 0, doc[part], position[part])
    return pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *(pa.array(out[n], pa.binary()) for n in _NAMES[1:3]),
                                       pa.array(out["singles"], pa.int32()), *(pa.array(out[n], pa.binary()) for n in _NAMES[4:])], _NAMES)


def candidates(rows: DataFrame, window: int, bits: int, bitmaps, buckets: int) -> DataFrame:
    """Exchange rows of all windows that the sketch estimates repeated."""

    @lean
    def run(batches):
        maps, held, n = bitmaps.value, [], 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = Words(piece.column(2))
                places = Places(words, window)
                at = np.flatnonzero(places.valid)
                at = at[sketch.reached(maps, places.keys[at], bits)]
                if not len(at):
                    continue
                doc = np.searchsorted(words.bounds, at, side="right") - 1
                keys = np.stack([np.asarray(piece.column(i)) for i in (0, 1)], 1)
                held.append((keys, doc, at - words.bounds[doc], words.grams(window)[at], (words.grams(window, 1)[at] >> np.uint64(32)).astype(np.uint32)))
                n += len(at)
                if n >= FLUSH:
                    yield joined(held)
                    held, n = [], 0
        if held:
            yield joined(held)

    def joined(held):
        first = np.cumsum([0, *(len(h[0]) for h in held)])
        doc = np.concatenate([h[1] + first[i] for i, h in enumerate(held)])
        return exchange(np.concatenate([h[0] for h in held]), doc, *(np.concatenate([h[i] for h in held]) for i in (2, 3, 4)), buckets)

    return rows.mapInArrow(run, EXCHANGE)


MARKS = "bucket int, keys binary, counts binary, positions binary"


def _marks(keys: np.ndarray, doc: np.ndarray, positions: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of MARKS, dealt by document: keys (docs, 2), the documents' numbers of positions, positions."""
    target = (keys[:, 0].view(np.uint64) % np.uint64(buckets)).astype(np.int64)[doc]
    order = np.lexsort((positions, doc, target))
    target, doc, positions = target[order], doc[order], positions[order]
    edges = np.searchsorted(target, np.arange(buckets + 1))
    out: list[list] = [[], [], [], []]
    for bucket in np.flatnonzero(np.diff(edges)):
        part = slice(edges[bucket], edges[bucket + 1])
        held, counts = np.unique(doc[part], return_counts=True)
        for column, value in zip(out, (int(bucket), keys[held].tobytes(), counts.astype(np.uint32).tobytes(), positions[part].tobytes())):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["bucket", "keys", "counts", "positions"])


def _read(keys: bytes, counts: bytes, positions: bytes):
    return np.frombuffer(keys, np.int64).reshape(-1, 2), np.frombuffer(counts, np.uint32), np.frombuffer(positions, np.uint32)


def repeats(sent: DataFrame, buckets: int) -> DataFrame:
    """key1, key2, positions (packed): starts of windows whose sequence starts elsewhere too, one row by document."""

    @lean
    def group(batches):
        held = []
        for batch in batches:
            for _, h, t, singles, *places in zip(*(col.to_pylist() for col in batch.columns)):
                held.append((np.frombuffer(h, np.uint64), np.frombuffer(t, np.uint32), singles, *_read(*places)))
        if not held:
            return
        hashes, tails = np.concatenate([r[0] for r in held]), np.concatenate([r[1] for r in held])
        weight = np.concatenate([np.repeat((1, 2), (r[2], len(r[0]) - r[2])) for r in held])
        order = np.lexsort((tails, hashes))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (tails[order][1:] != tails[order][:-1])
        window = np.empty(len(order), np.int64)
        window[order] = np.cumsum(new) - 1
        again = np.bincount(window, weights=weight, minlength=1)[window] >= 2
        at, docs, keys, doc, positions = 0, 0, [], [], []
        for h, _, singles, key, count, place in held:
            hit = again[at:at + singles] if len(h) else np.ones(len(place), bool)  # rows without hashes: known repeats
            at += len(h)
            doc.append(np.repeat(np.arange(len(key)) + docs, count)[hit])
            positions.append(place[hit])
            keys.append(key)
            docs += len(key)
        doc = np.concatenate(doc)
        if len(doc):
            yield _marks(np.concatenate(keys), doc, np.concatenate(positions), buckets)

    @lean
    def gather(batches):
        rows = [_read(*row[1:]) for batch in batches for row in zip(*(col.to_pylist() for col in batch.columns))]
        if not rows:
            return
        keys = np.concatenate([r[0] for r in rows])
        keys, index = pairs_index(keys)
        doc = np.repeat(index, np.concatenate([r[1] for r in rows]))
        positions = np.concatenate([r[2] for r in rows])
        order = np.lexsort((positions, doc))
        doc, positions = doc[order], positions[order]
        new = np.ones(len(doc), bool)  # documents of one key (repeated rows) have the same marks
        new[1:] = (doc[1:] != doc[:-1]) | (positions[1:] != positions[:-1])
        doc, positions = doc[new], positions[new]
        ends = np.searchsorted(doc, np.arange(len(keys) + 1))
        for i in range(0, len(keys), 1000):
            last = min(len(keys), i + 1000)
            packed = [positions[ends[j]:ends[j + 1]].tobytes() for j in range(i, last)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[i:last, 0]), pa.array(keys[i:last, 1]), pa.array(packed, pa.binary())], ["key1", "key2", "positions"])

    marks = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(group, MARKS)
    return marks.repartitionById(buckets, F.col("bucket")).mapInArrow(gather, "key1 long, key2 long, positions binary")


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text.

    Each word covered by a window that starts anywhere else (in the same document too) is removed; all copies go.
    kept_text is what is left, joined by single spaces. Texts of fewer than ``window`` words lose nothing, null and
    empty texts have no words. Rows that repeat id and text are separate documents (so all their windows repeat); ids
    may be null or repeat. Other columns are not read. An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = df.select(F.xxhash64(plain(doc_id), plain(text)).alias("key1"), F.xxhash64(plain(text), F.lit(window)).alias("key2"),
                     F.coalesce(plain(text), F.lit("")).alias("text"), plain(doc_id).alias("doc_id"))
    keyed = rows.select("key1", "key2", "text")
    volume = text_volume(rows, "text")
    bits = sketch.bits_for(volume / 6 * 2 / (window - window // 2 + 1))
    bitmaps = spark.sparkContext.broadcast(sketch_windows(keyed, window, bits))
    buckets = bucket_count(volume, BUCKET_BYTES)
    marks = repeats(candidates(keyed, window, bits, bitmaps, buckets), buckets)
    marked = rows.join(marks, ["key1", "key2"], "left").select("doc_id", "text", "positions")

    @lean
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                n_words, n_removed, kept = [], [], []
                for text_, found in zip(piece.column(1), piece.column(2)):
                    words = text_.as_py().encode().split()
                    removed = 0
                    if found.is_valid:
                        steps = np.zeros(len(words) + 1, np.int64)
                        starts = np.frombuffer(found.as_py(), np.uint32)
                        steps[starts] += 1
                        steps[starts + np.uint32(window)] -= 1
                        keep = np.cumsum(steps[:-1]) == 0
                        removed = len(words) - int(keep.sum())
                        kept.append(b" ".join(compress(words, keep)).decode())
                    else:
                        kept.append(b" ".join(words).decode())
                    n_words.append(len(words))
                    n_removed.append(removed)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                                                 ["doc_id", "n_words", "n_removed", "kept_text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_text string")
