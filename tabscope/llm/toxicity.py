"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of the whole text: densities of a given lexicon and of two learnt tiers (words and word beginnings far more
frequent in toxic documents of the training sample), the densest stretch, proximity to the second person, capitals,
punctuation and obfuscation rates. Documents are reduced to features on the executors (numpy over Arrow batches), trees
and calibration are Spark ML models. Everything fitted uses at most ``SAMPLE`` labelled documents, in three folds:
a training row's lexicon features come from the other folds, trees learn on two folds, calibration on the third.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import lean
from .quality import fold, labelled, sample_rows
from .store import fresh, plain, saved
from .words import _BYTE_LOWER, Words, mix64, pieces, text_bytes

SAMPLE = 8000  # labelled documents that lexicon, trees and calibration are fitted on
LEXICON = 20_000  # learnt entries at most
LEAST, STRONG, WEAK = 4, 40.0, 10.0  # toxic documents an entry needs; how many times likelier than in others
PREFIXES = (4, 5, 6, 7, 8)
STRETCH = 24
PIECE_BYTES = 1 << 20  # text whose words are looked up at a time, some twenty numbers a word
INSULTS = ("idiot moron stupid dumb loser trash scum clown pathetic worthless disgusting fool jerk garbage vermin filthy "
           "imbecile coward liar freak").split()
SECOND = "you your yours yourself du dich dein deine toi vous votre usted ustedes".split()
FEATURES = ["given", "strong", "weak", "strong_hits", "stretch", "addressed", "obfuscated_hits", "obfuscated", "capitals",
            "exclaims", "punctuation", "length"]

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LEET = dict(zip("013457@$!|", "oieastasii"))
_JOIN = np.zeros(256, bool)  # characters written between letters to hide a word
_JOIN[[ord(c) for c in ".*-_'~"]] = True
_HIDDEN = _LETTER.copy()
_HIDDEN_VALUES = _BYTE_LOWER.copy()
for _sign, _letter in _LEET.items():
    _HIDDEN[ord(_sign)] = True
    _HIDDEN_VALUES[ord(_sign)] = _BYTE_LOWER[ord(_letter)]
_WHOLE = np.uint64(0xA0761D6478BD642F)


def fingerprints(strings: list[str]) -> np.ndarray:
    return np.unique(Words(pa.array([s.lower() for s in strings])).hashes)


def _in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def entries(words: Words) -> list[np.ndarray]:
    """Lexicon entries of each word: the whole word and its beginnings of 4 to 8 bytes (0 where the word is shorter)."""
    length = words.ends - words.starts
    out = [mix64(words.hashes ^ _WHOLE)]
    for n in PREFIXES:
        part = words.spans(np.minimum(words.ends, words.starts + n))
        out.append(np.where(length > n, part, np.uint64(0)))
    return out


class Lexicon:
    """Learnt entries in two tiers (sorted fingerprints)."""

    def __init__(self, strong: np.ndarray, weak: np.ndarray):
        self.strong, self.weak = np.sort(strong), np.sort(weak)


def document_features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES by text; all zeros for a text without letters but its rates."""
    data, offsets = text_bytes(column)
    docs = len(offsets) - 1
    words = Words((data, offsets), lower=True, inside=_LETTER)
    counts = words.counts()
    doc = np.repeat(np.arange(docs), counts)
    size = np.maximum(1, counts)

    def total(values):
        return np.bincount(doc, weights=values, minlength=docs)

    given = _in(words.hashes, GIVEN)
    strong, weak = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    for found in entries(words):
        strong |= _in(found, lexicon.strong)
        weak |= _in(found, lexicon.weak)
    hits = given | strong
    sums = np.concatenate([[0], np.cumsum(hits)])
    at = np.arange(len(doc))
    ahead = sums[np.minimum(at + STRETCH, words.bounds[1:][doc])] - sums[at] if len(doc) else sums[:0]
    stretch = np.zeros(docs)
    np.maximum.at(stretch, doc, ahead)
    second = np.concatenate([[0], np.cumsum(_in(words.hashes, ADDRESS))])
    near = (second[np.minimum(at + 4, words.bounds[1:][doc])] - second[np.maximum(at - 3, words.bounds[:-1][doc])] > 0) if len(doc) else hits
    # words written with signs for letters: drop joining signs, read the others as letters
    keep = ~_JOIN[data]
    shift = np.concatenate([[0], np.cumsum(keep)])
    hidden = Words((data[keep], shift[offsets]), inside=_HIDDEN, table=_HIDDEN_VALUES)
    hidden_doc = np.repeat(np.arange(docs), hidden.counts())
    masked = np.bincount(hidden_doc, weights=_in(hidden.hashes, GIVEN) | _in(mix64(hidden.hashes ^ _WHOLE), lexicon.strong), minlength=docs)

    def share(mask, by):
        marks = np.concatenate([[0], np.cumsum(mask)])
        return (marks[offsets[1:]] - marks[offsets[:-1]]) / np.maximum(1, by)

    length = np.diff(offsets)
    letter = _LETTER[data]
    mixed = np.zeros(len(data), bool)
    sign = ~letter & (data > 32)
    if len(data) > 2:
        mixed[1:-1] = letter[:-2] & sign[1:-1] & letter[2:]
    whole_hits = total(given) + total(strong & ~given)
    return np.stack([total(given) / size, total(strong) / size, total(weak) / size, np.log1p(whole_hits), stretch / STRETCH,
                     total(hits & near) / size, np.log1p(np.maximum(0, masked - total(given) - total(strong))), share(mixed, counts),
                     share((data >= 65) & (data <= 90), length), share((data == 33) | (data == 63), counts), share(sign, length), np.log1p(counts)], 1)


GIVEN, ADDRESS = fingerprints(INSULTS), fingerprints(SECOND)


def _sample_frame(sample: DataFrame, function, schema: str) -> DataFrame:
    @lean
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                yield from function(piece)

    return sample.select("doc_id", "label", "text", "part").mapInArrow(run, schema)


def entry_counts(sample: DataFrame, parts: list[int]) -> pd.DataFrame:
    """entry, toxic and clean documents of each part: entries of at least LEAST toxic documents, likeliest first."""

    def count(piece):
        words = Words(piece.column(2), lower=True, inside=_LETTER)
        doc = np.repeat(np.arange(piece.num_rows), words.counts())
        kind = (2 * np.searchsorted(parts, piece.column(3).to_numpy()) + piece.column(1).to_numpy().astype(int))[doc]
        found, docs, kinds = (np.concatenate(x) for x in zip(*((e, doc, kind) for e in entries(words))))
        order = np.lexsort((found, docs))
        found, docs, kinds = found[order], docs[order], kinds[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (docs[1:] != docs[:-1])
        new &= found != 0
        values, inverse = np.unique(found[new], return_inverse=True)
        table = [np.bincount(inverse, weights=kinds[new] == k, minlength=len(values)).astype(np.int64) for k in range(2 * len(parts))]
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), *map(pa.array, table)], ["entry", *names])

    names = [f"{'toxic' if k % 2 else 'clean'}_{k // 2}" for k in range(2 * len(parts))]
    toxic = sum((F.col(n) for n in names if n.startswith("toxic")), F.lit(0))
    clean = sum((F.col(n) for n in names if n.startswith("clean")), F.lit(0))
    rows = _sample_frame(sample, count, "entry long, " + ", ".join(f"{n} long" for n in names))
    sums = rows.groupBy("entry").agg(*[F.sum(n).alias(n) for n in names])
    return (sums.where((toxic >= LEAST) & (toxic > clean)).orderBy((toxic / (clean + 1)).desc(), "entry").limit(LEXICON).toPandas())


def choose(table: pd.DataFrame, docs: dict, parts: list[int], use: list[int]) -> Lexicon:
    """The lexicon learnt from the parts ``use``; docs: (part, label) -> documents."""
    at = [parts.index(p) for p in use]
    toxic = sum((table[f"toxic_{i}"] for i in at), 0 * table["entry"])
    clean = sum((table[f"clean_{i}"] for i in at), 0 * table["entry"])
    n = {label: sum(docs.get((p, label), 0) for p in use) for label in (0, 1)}
    lift = ((toxic + 0.5) / (n[1] + 1)) / ((clean + 0.5) / (n[0] + 1))
    entry = table["entry"].to_numpy(np.int64).view(np.uint64)
    return Lexicon(entry[((toxic >= LEAST) & (lift >= STRONG)).to_numpy(bool)], entry[((toxic >= LEAST) & (lift >= WEAK)).to_numpy(bool)])


def featured(rows: DataFrame, lexicons: dict, text: str = "text", part: str | None = None) -> DataFrame:
    """The frame's columns but the text, with FEATURES; lexicons by value of ``part`` (None: the same for all)."""
    keep = [c for c in rows.columns if c != text]
    held = rows.sparkSession.sparkContext.broadcast(lexicons)
    names = [*keep, text]
    at = keep.index(part) if part else None

    @lean
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text, PIECE_BYTES):
                x = np.zeros((piece.num_rows, len(FEATURES)))
                column = piece.column(len(keep))
                if at is None:
                    x = document_features(column, held.value[None])
                else:
                    parts = piece.column(at).to_numpy()
                    for p in np.unique(parts):
                        some = np.flatnonzero(parts == p)
                        x[some] = document_features(column.take(pa.array(some)), held.value[int(p)])
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *(pa.array(c, pa.float64()) for c in x.T)], [*keep, *FEATURES])

    rows = rows.select(*[plain(c) for c in names])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}{', ' if kinds else ''}{', '.join(f'{f} double' for f in FEATURES)}")


class ToxicityModel:
    """Lexicon, trees and calibration; a constant where the sample holds one label only."""

    def __init__(self, lexicon=None, trees=None, isotonic=None, constant: float = 0.5):
        self.lexicon, self.trees, self.isotonic, self.constant = lexicon, trees, isotonic, constant

    @staticmethod
    def vectors(df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)

    def score(self, df: DataFrame, doc_id: str, text: str, **more: Column) -> DataFrame:
        """doc_id, columns ``more`` and score of each row."""
        rows = df.select(plain(doc_id).alias("doc_id"), F.coalesce(plain(text), F.lit("")).alias("text"), *[c.alias(n) for n, c in more.items()])
        names = ["doc_id", *more]
        if self.trees is None:
            return rows.select(*names, F.lit(float(self.constant)).alias("score"))
        margins = margin(self.trees, self.vectors(featured(rows, {None: self.lexicon}))).select(*names, "margin")
        return self.isotonic.transform(margins).select(*names, F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def margin(trees, df: DataFrame) -> DataFrame:
    return trees.transform(df).withColumn("margin", vector_to_array("probability")[1])


def train(df: DataFrame, marks: DataFrame, limit: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", folds: int = 4) -> ToxicityModel:
    """Fit on at most ``limit`` rows of ``marks`` (doc_id, label), which holds training rows only."""
    sample = saved(sample_rows(df, marks, limit, doc_id, text).withColumn("part", fold(F.col("doc_id"), folds)))
    docs = {(r["part"], int(r["label"])): r["count"] for r in sample.groupBy("part", "label").count().collect()}
    parts = sorted({p for p, _ in docs})
    kinds = {label for _, label in docs}
    if len(kinds) < 2:
        return ToxicityModel(constant=float(kinds.pop()) if kinds else 0.5)
    table = entry_counts(sample, parts)
    lexicons = {p: choose(table, docs, parts, [q for q in parts if q != p] or parts) for p in parts}
    rows = saved(ToxicityModel.vectors(featured(sample.select("doc_id", "label", "part", "text"), lexicons, part="part")))
    last = parts[-1]
    fit_on, check_on = rows.where(F.col("part") != last), rows.where(F.col("part") == last)
    if fit_on.select("label").distinct().count() < 2 or check_on.select("label").distinct().count() < 2:
        fit_on = check_on = rows
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.3, seed=7).fit(fit_on.coalesce(1))
    isotonic = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(margin(trees, check_on).select("margin", "label"))
    return ToxicityModel(choose(table, docs, parts, parts), trees, isotonic)


def score_toxicity(df: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = 4, held: int = 2,
                   doc_id: str = "doc_id", text: str = "text", limit: int = SAMPLE, threshold: float = 0.3, **more: Column) -> DataFrame:
    """One row per input row: doc_id, columns ``more``, held_out, score, predicted; learnt from labels outside the held-out fold.

    Null and empty texts have zero features and get their score; repeated rows are scored alike; null ids are scored,
    never learnt from. Null, other than 0/1 and contradicting labels are left out. With labels of one kind only the
    score is that label, without any 0.5. An empty table gives an empty result.
    """
    marks = labelled(labels, column).where(fold(F.col("doc_id"), folds) != held)
    return (train(df, marks, limit, doc_id, text, folds).score(df, doc_id, text, **more)
            .select("doc_id", *more, (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def drop_toxic(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The input's rows (all columns) whose text is not predicted toxic; each row is judged by its own text, whatever its id."""
    here, key = fresh(df, "_digest"), fresh(df, "_id")
    digest = F.unhex(F.sha2(F.coalesce(plain(text), F.lit("")), 256))
    toxic = (score_toxicity(df, labels, doc_id=doc_id, text=text, **options, digest=digest).where("predicted = 1")
             .select(F.col("doc_id").alias(key), F.col("digest").alias(here + "_toxic")).distinct())
    out = df.withColumn(here, digest).join(toxic, plain(doc_id).eqNullSafe(F.col(key)) & (F.col(here) == F.col(here + "_toxic")), "left_anti")
    return out.select(*[plain(c) for c in df.columns])
