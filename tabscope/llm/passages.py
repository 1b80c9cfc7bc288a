"""Passages of texts and dense features of each, computed on bytes and word fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import Words

LENGTH = 64  # words of a passage
NAMES = ["bias", "word_length", "word_spread", "short", "long", "upper", "digit", "comma", "stop", "symbol", "bar", "mark",
         "line", "non_ascii", "same_as_last", "distinct", "seen_before", "capital_start", "glued", "filled"]


def _classes() -> np.ndarray:
    """For each byte: is it upper case, digit, comma, full stop, symbol, bar, exclamation or question mark, line break, non-ASCII."""
    table = np.zeros((256, 9), np.float32)
    table[65:91, 0] = 1
    table[48:58, 1] = 1
    for column, text in ((2, ",;:"), (3, "."), (4, "%&$#*@^~=+<>{}[]\\/_"), (5, "|"), (6, "!?"), (7, "\n")):
        table[[ord(c) for c in text], column] = 1
    table[128:, 8] = 1
    return table


_CLASS = _classes()


def passage_features(column: pa.Array, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(features by passage, number of passages by text). A text without words has one passage of its own."""
    words = Words(column)
    counts = words.counts()
    passages = np.maximum(1, -(-counts // length))
    total = int(passages.sum())
    features = np.zeros((total, len(NAMES)), np.float32)
    features[:, 0] = 1
    n = len(words.hashes)
    if not n:
        return features, passages
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - words.bounds[text]
    first_passage = np.cumsum(passages) - passages
    passage = first_passage[text] + place // length
    size = np.maximum(1, np.bincount(passage, minlength=total))

    def mean(values):
        return np.bincount(passage, weights=values, minlength=total) / size

    lengths = (words.ends - words.starts).astype(np.float64)
    features[:, 1] = np.log1p(mean(lengths))
    features[:, 2] = np.log1p(np.sqrt(np.maximum(0, mean(lengths ** 2) - mean(lengths) ** 2)))
    features[:, 3] = mean(lengths <= 3)
    features[:, 4] = mean(lengths >= 14)
    # character classes by passage: from its first word to the next passage's first word, or the end of the text
    head = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    begin = words.starts[head]
    stop = np.r_[begin[1:], words.ends[-1]]
    rows = passage[head]
    span = np.maximum(1, stop - begin)
    for column_ in range(9):
        sums = np.concatenate([[0], np.cumsum(_CLASS[words.data, column_], dtype=np.float64)])
        features[rows, 5 + column_] = (sums[stop] - sums[begin]) / span
    h = words.hashes
    same = np.zeros(n)
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    features[:, 14] = mean(same)
    # words that are new in their passage, and runs of three words seen before in the text
    order = np.lexsort((h, passage))
    new = np.ones(n)
    new[1:] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    features[:, 15] = np.bincount(passage[order], weights=new, minlength=total) / size
    grams = words.grams(3)
    order = np.lexsort((np.arange(n), grams, text))
    again = np.zeros(n)
    again[order[1:]] = (grams[order][1:] == grams[order][:-1]) & (text[order][1:] == text[order][:-1])
    features[:, 16] = mean(again)
    initial = words.data[words.starts]
    features[:, 17] = mean((initial >= 65) & (initial <= 90))
    final = words.data[words.ends - 1]
    features[:, 18] = mean(~(((final | 32) >= 97) & ((final | 32) <= 122) | (final >= 128)))
    features[:, 19] = np.log1p(np.bincount(passage, minlength=total)) / np.log1p(length)
    return features, passages
