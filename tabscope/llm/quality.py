"""Quality by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage of the whole text is encoded; a gated
attention (tanh branch times sigmoid branch) learnt from the document labels weighs the passages, and the weighted
passage representation is scored. Training uses a bounded sample of labelled documents (``SAMPLE``, by hash order of
the id) on the driver; scoring is one pass over all texts with the small weight matrices broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .passages import NAMES, passage_features
from .store import plain
from .words import pieces

SAMPLE = 6000  # labelled documents the model is fitted on
WIDTH, GATE = 16, 8
STEPS, RATE, DECAY = 400, 0.02, 1e-4


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """score(bag) = sigmoid(c . z + d), z = sum of a_k h_k, h = tanh(x W), a = softmax of u . (tanh(h V) * sigmoid(h G))."""

    def __init__(self, inputs: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.p = {"W": rng.normal(0, 0.3, (inputs, WIDTH)), "V": rng.normal(0, 0.3, (WIDTH, GATE)), "G": rng.normal(0, 0.3, (WIDTH, GATE)),
                  "u": np.zeros(GATE), "c": rng.normal(0, 0.3, WIDTH), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        p = self.p
        first = np.cumsum(counts) - counts
        bag = np.repeat(np.arange(len(counts)), counts)
        x = (x - self.mean) / self.scale
        x[:, 0] = 1
        h = np.tanh(x @ p["W"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["G"])
        e = (t * g) @ p["u"]
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag, "first": first, "score": _sigmoid(z @ p["c"] + p["d"])}

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward(x.astype(np.float64), counts)["score"]

    def gradients(self, f: dict, y: np.ndarray) -> dict:
        p, bag = self.p, f["bag"]
        out = (f["score"] - y) / len(y)
        dz = out[:, None] * p["c"]
        dh = f["a"][:, None] * dz[bag]
        da = (dz[bag] * f["h"]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["first"])[bag])
        dt, dg = de[:, None] * p["u"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["u"] * f["t"] * f["g"] * (1 - f["g"])
        dh += dt @ p["V"].T + dg @ p["G"].T
        return {"W": f["x"].T @ (dh * (1 - f["h"] ** 2)), "V": f["h"].T @ dt, "G": f["h"].T @ dg,
                "u": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ out, "d": np.array([out.sum()])}

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> GatedAttention:
        """Full-batch Adam on the log loss; deterministic for the same sample."""
        x = x.astype(np.float64)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for step in range(1, STEPS + 1):
            grads = self.gradients(self.forward(x, counts), y)
            for k, g in grads.items():
                g = g + DECAY * self.p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


class Constant:
    """Stands in where the sample holds one label only, or none (0.5)."""

    def __init__(self, value: float):
        self.value = value

    def score(self, x, counts):
        return np.full(len(counts), self.value)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in the fold of the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def labelled(labels: DataFrame, column: str, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, label: one row per labelled id; ids without id or label or with contradicting labels are left out."""
    return (labels.select(plain(doc_id).alias("doc_id"), plain(column).cast("double").alias("label")).where("doc_id is not null and label in (0, 1)")
            .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other"))


SAMPLE_BYTES = 1 << 20  # longer texts are scored, not learnt from


def sample_rows(df: DataFrame, marks: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, label, text of at most ``limit`` labelled documents, the first by hash of the id.

    Labels without a document don't count. Of the rows that share an id, however many, the one of the smallest text
    digest is taken, so the sample has at most ``limit`` rows of at most SAMPLE_BYTES each.
    """
    short = df.select(plain(doc_id).alias("doc_id"), F.coalesce(plain(text), F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    chosen = (marks.join(short.select("doc_id").distinct(), "doc_id", "left_semi")
              .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(limit))
    rows = short.join(F.broadcast(chosen), "doc_id").withColumn("digest", F.sha2("text", 256))
    first = Window.partitionBy("doc_id").orderBy("digest")
    return rows.withColumn("place", F.row_number().over(first)).where("place = 1").select("doc_id", "text", "label")


def train(df: DataFrame, marks: DataFrame, limit: int = SAMPLE, doc_id: str = "doc_id", text: str = "text"):
    """Fit on the sample; ``marks`` (doc_id, label) holds training rows only."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                x, counts = passage_features(piece.column(2))
                packed = [part.tobytes() for part in np.split(x, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), piece.column(1), pa.array(packed, pa.binary())], ["doc_id", "label", "x"])

    rows = (sample_rows(df, marks, limit, doc_id, text).select("doc_id", "label", "text")
            .mapInArrow(run, "doc_id long, label double, x binary").toPandas().sort_values(["doc_id", "x"]))
    y = rows["label"].to_numpy(float)
    if len(set(y)) < 2:
        return Constant(float(y[0]) if len(y) else 0.5)
    bags = [np.frombuffer(x, np.float32).reshape(-1, len(NAMES)) for x in rows["x"]]
    return GatedAttention(len(NAMES)).fit(np.concatenate(bags), np.array([len(b) for b in bags]), y)


def score(df: DataFrame, model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, score, predicted. The whole text is scored, null as empty; nothing else is read."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                scores = held.value.score(*passage_features(piece.column(1)))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = df.select(plain(doc_id).alias("doc_id"), F.coalesce(plain(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_quality(df: DataFrame, labels: DataFrame, column: str = "quality", folds: int = 5, held: int = 0,
                  doc_id: str = "doc_id", text: str = "text", limit: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted; learnt from labels outside the held-out fold.

    Null and empty texts are one passage without words and get its score; repeated rows are scored alike; null ids
    are scored, never learnt from. Null, other than 0/1 and contradicting labels are left out. With labels of one kind
    only the score is that label, without any 0.5. An empty table gives an empty result.
    """
    marks = labelled(labels, column).where(fold(F.col("doc_id"), folds) != held)
    return (score(df, train(df, marks, limit, doc_id, text), doc_id, text)
            .select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted"))
