"""BPE encoding and decoding with a contiguous rank array.

A word's symbols and the merge ranks of its neighbouring pairs lie in two short arrays. The smallest rank is found by
a scan, its boundary deleted and the ranks to its left and right looked up anew, until no pair can merge. Words of more
than ``SHORT`` symbols, for which repeated scans would cost the square of the length, keep the ranks in a heap over
linked symbols; both orders are lowest rank first, leftmost on ties, so the results agree. Normalisation is the
tokenizer file's own; pre-tokens are found by its pattern.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .memory import lean
from .store import plain

MODEL = "word_bpe_49k.json"
SHORT = 64
REMEMBERED = 200_000  # words whose ids a Python worker keeps
NONE = 1 << 30
# Characters whose classes are the same in both regular expression libraries (the tests compare all code points);
# texts with any other are split by the tokenizer file's own pre-tokenizer.
OTHER = regex.compile("[^\\x00-\\u0557\\u1e00-\\u2064\\u20a0-\\u20bf\\u3041-\\u3096\\u4e00-\\u9fa5\\uac00-\\ud7a3]")
# The split and lower case of texts of ASCII alone, for which composition (NFC) changes nothing; white space is never part of a word.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = ["NFC", "Replace", "Lowercase"]
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r 0-9a-z]+").findall


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class WordBpe:
    """Encoder and decoder of a tokenizers file with a BPE model, byte-level symbols and an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or spec["decoder"]:
            raise ValueError("not a word-end BPE tokenizer of the supported form")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        library = Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.plain_split = split["pattern"]["Regex"] == SPLIT and [n["type"] for n in spec["normalizer"]["normalizers"]] == NORMAL
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + end] for s in symbols]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        named = {i: s for s, i in chain(vocab.items(), self.added.items())}
        self.strings = [named.get(i) for i in range(max(named) + 1)]
        self.known = KnownWords(self)

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text."""
        if self.plain_split and text.isascii():
            return ASCII_WORDS(text.lower())
        text = self.normalise(text)
        if OTHER.search(text):
            return [text[a:b] for _, (a, b) in self.split(text)]
        return self.find(text)

    def symbols(self, word: str) -> list[int]:
        raw = word.encode()
        return [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]

    def scan(self, parts: list[int]) -> list[int]:
        """Merge by scanning the contiguous ranks for their minimum."""
        none = (NONE, 0)
        merges = self.merges
        ranks = [merges.get(p, none)[0] for p in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            at = ranks.index(low)
            parts[at] = merges[parts[at], parts[at + 1]][1]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = merges.get((parts[at - 1], parts[at]), none)[0]
            if at < len(ranks):
                ranks[at] = merges.get((parts[at], parts[at + 1]), none)[0]
        return parts

    def heap(self, parts: list[int]) -> list[int]:
        """The same merges for long words: pairs in a heap by (rank, place), symbols linked."""
        n, merges = len(parts), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(at: int) -> None:
            if at >= 0 and after[at] < n and (found := merges.get((parts[at], parts[after[at]]))):
                heapq.heappush(queue, (found[0], at, parts[at], parts[after[at]], found[1]))

        queue: list[tuple] = []
        for at in range(n - 1):
            pair(at)
        while queue:
            _, at, left, right, new = heapq.heappop(queue)
            to = after[at]
            if parts[at] != left or to >= n or parts[to] != right:
                continue  # one of the two has merged otherwise meanwhile
            parts[at], parts[to] = new, -1
            after[at] = after[to]
            if after[at] < n:
                before[after[at]] = at
            pair(before[at])
            pair(at)
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> list[int]:
        parts = self.symbols(word)
        return self.scan(parts) if len(parts) <= SHORT else self.heap(parts)

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as 32-bit integers; strings of added tokens inside it are those tokens, as in the library's default."""
        out: list[bytes] = []
        for piece in self.cut(text or ""):
            if piece in self.added:
                out.append(np.int32(self.added[piece]).tobytes())
            elif piece:
                out.append(b"".join(map(self.known.__getitem__, self.words(piece))))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces (the file has no decoder); unknown ids are skipped."""
        try:
            return " ".join(map(self.strings.__getitem__, ids))
        except (IndexError, TypeError):
            return " ".join(self.strings[i] for i in ids if 0 <= i < len(self.strings) and self.strings[i] is not None)


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    """The model of a file, read once by each Python worker; its tasks share the words they meet."""
    return WordBpe(path)


class KnownWords(dict):
    """Packed ids of words met before, at most REMEMBERED of them."""

    def __init__(self, model: WordBpe):
        self.model = model

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.model.word(word), np.int32).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= SHORT:
            self[word] = ids
        return ids


def encode(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """The input's rows and columns with the text's token ids (array of int) and, if named, their decoded string.

    Null and empty texts have no ids and decode to the empty string; whole texts are encoded, however long. Rows are
    independent, so repeated rows and null ids stay. A column of the input with an output's name is replaced.
    """
    outputs = [ids] + ([decoded] if decoded else [])
    keep = [c for c in df.columns if c not in outputs]
    if text not in keep:
        raise ValueError("an output can't replace the text")
    rows = df.select(*[plain(c) for c in keep])
    more = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    schema = T.StructType([*rows.schema.fields, *more])
    place = keep.index(text)

    @lean
    def run(batches):
        model = loaded(path or model_path())
        for batch in batches:
            for at in range(0, batch.num_rows, 200):  # bounds the ids held as Python numbers
                part = batch.slice(at, 200)
                found = [model.packed(t) for t in part.column(place).to_pylist()]
                ends = np.cumsum([0, *(len(f) // 4 for f in found)]).astype(np.int32)
                flat = np.frombuffer(b"".join(found), np.int32)
                more = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded:
                    more.append(pa.array([model.decode(np.frombuffer(f, np.int32).tolist()) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*keep, *outputs])

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, decoded: str = "decoded") -> DataFrame:
    """The input's rows and columns with the string of an array of token ids; null ids decode to the empty string."""
    keep = [c for c in df.columns if c != decoded]
    rows = df.select(*[plain(c) for c in keep])
    place = keep.index(ids)

    @lean
    def run(batches):
        model = loaded(path or model_path())
        for batch in batches:
            texts = [model.decode(i or []) for i in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*keep, decoded])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(decoded, T.StringType())]))
