"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are rotated by three rounds of random signs and fast Hadamard transforms (a pseudo-random rotation) and
assigned to the nearest signed axis, one bucket by table. A query probes, in each table, the axes of its largest
coordinates. Vectors meet queries in their buckets only: both are shuffled by (table, bucket); each bucket's candidates
are scored and the best kept by query, so that no candidate pair is shuffled. Equal vectors are one entry with their
smallest ids, large buckets are split by salt with the bucket's queries sent to each part. Scores in the buckets are
single precision: whatever their error leaves in doubt is kept, and the kept are scored again on the original vectors
in double precision. Queries that find fewer than k are scored against all vectors of their length, in parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import plain, saved

TABLES, PROBES = 28, 4
PART = 20_000  # entries of a bucket that are scored together, on average


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two), unnormalised."""
    n = x.shape[1]
    step = 1
    while step < n:
        x = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        step *= 2
    return x


def rotate(unit: np.ndarray, table: int, seed: int = 11) -> np.ndarray:
    """The pseudo-rotation of a table: signs and Hadamard transform, three times; rows padded to a power of two."""
    n = 1 << max(0, int(unit.shape[1] - 1).bit_length())
    rng = np.random.default_rng([seed, table, n])
    x = np.zeros((len(unit), n))
    x[:, :unit.shape[1]] = unit
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], n)) / np.sqrt(n)
    return x


def axes(rotated: np.ndarray, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first: 2 * axis + (coordinate > 0)."""
    probes = min(probes, rotated.shape[1])
    near = np.argsort(-np.abs(rotated), axis=1, kind="stable")[:, :probes]
    return 2 * near + (np.take_along_axis(rotated, near, 1) > 0)


def distinct_vectors(df: DataFrame, vec_id: str, embedding: str, spare_ids: int) -> DataFrame:
    """entry, dim, vector, ids: one row per distinct usable vector with its ``spare_ids`` smallest ids."""
    vector = F.transform(plain(embedding), lambda v: v.cast("double"))
    usable = df.select(plain(vec_id).cast("long").alias("id"), vector.alias("vector")).where(
        "id is not null and vector is not null and size(vector) > 0 and forall(vector, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))"
        " and exists(vector, v -> v <> 0)")
    # hot vectors: the smallest ids of each salt first, then of those
    order = Window.partitionBy("vector", "salt").orderBy("id")
    first = usable.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("n", F.row_number().over(order)).where(F.col("n") <= spare_ids)
    return (first.groupBy("vector").agg(F.slice(F.array_sort(F.collect_list("id")), 1, spare_ids).alias("ids"))
            .withColumn("entry", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_dim(batch: pa.RecordBatch, dims: np.ndarray):
    for dim in np.unique(dims):
        yield int(dim), batch.take(pa.array(np.flatnonzero(dims == dim)))


def bucketed(rows: DataFrame, tables: int, probes: int) -> DataFrame:
    """key (dim, table, bucket as one text), entry, unit (packed floats): one row by table and probed axis; without
    tables one row, all of a length under one key."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                for dim, part in _by_dim(batch.slice(at, 2000), batch.slice(at, 2000).column(2).to_numpy()):
                    vectors = _matrix(part.column(1), dim)
                    norm = np.linalg.norm(vectors / np.abs(vectors).max(1, keepdims=True), axis=1, keepdims=True) * np.abs(vectors).max(1, keepdims=True)
                    unit = vectors / norm
                    packed = pa.array([v.tobytes() for v in unit.astype(np.float32)], pa.binary())
                    if not tables:
                        yield pa.RecordBatch.from_arrays([pa.array([f"{dim}"] * part.num_rows), part.column(0), packed], ["key", "entry", "unit"])
                    for table in range(tables):
                        for near in axes(rotate(unit, table), probes).T:
                            keys = pa.array([f"{dim}/{table}/{b}" for b in near])
                            yield pa.RecordBatch.from_arrays([keys, part.column(0), packed], ["key", "entry", "unit"])

    return rows.select("entry", "vector", "dim").mapInArrow(run, "key string, entry long, unit binary")


def best_in_buckets(batches, keep: int):
    """query, entry, near, doubt: by run of equal (key, part) of sorted rows, each query's ``keep`` best entries by
    approximate score and all others that the error of two such scores (doubt) may put among them."""

    def best(queries, entries):
        q = np.stack([np.frombuffer(u, np.float32) for _, u in queries])
        owner = np.array([e for e, _ in queries])
        ids = np.array([e for e, _ in entries])
        score = q @ np.stack([np.frombuffer(u, np.float32) for _, u in entries]).T
        n = min(keep, len(ids))
        doubt = 2 * (q.shape[1] + 4) * 2.0 ** -24
        cut = np.partition(score, len(ids) - n, axis=1)[:, len(ids) - n].astype(np.float64) - doubt
        asked, held = np.nonzero(score >= cut[:, None])
        return pa.RecordBatch.from_arrays([pa.array(owner[asked]), pa.array(ids[held]), pa.array(score[asked, held].astype(np.float64)),
                                           pa.array(np.full(len(held), doubt))], ["query", "entry", "near", "doubt"])

    now, queries, entries = None, [], []
    for batch in batches:
        for key, part, asks, entry, unit in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, part) != now:
                if queries and entries:
                    yield best(queries, entries)
                now, queries, entries = (key, part), [], []
            if asks:
                queries.append((entry, unit))
            else:
                entries.append((entry, unit))
                if len(entries) >= 4 * PART:  # any larger run in pieces
                    if queries:
                        yield best(queries, entries)
                    entries = []
    if queries and entries:
        yield best(queries, entries)


def candidates(entries: DataFrame, queries: DataFrame, tables: int, probes: int, keep: int) -> DataFrame:
    """query, entry: all entries met that may be among the query's ``keep`` best."""
    index = saved(bucketed(entries, tables, 1))
    parts = index.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    placed = index.join(parts, "key").select("key", F.pmod(F.xxhash64("entry"), F.col("parts")).alias("part"), F.lit(False).alias("asks"), "entry", "unit")
    asked = (bucketed(queries, tables, probes).join(parts, "key")
             .select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "entry", "unit"))
    met = (placed.unionByName(asked).repartition("key", "part").sortWithinPartitions("key", "part", F.col("asks").desc(), "entry")
           .mapInArrow(lambda batches: best_in_buckets(batches, keep), "query long, entry long, near double, doubt double"))
    best = Window.partitionBy("query").orderBy(F.col("near").desc(), "entry")
    cut = F.max(F.when(F.col("n") == keep, F.col("near") - F.col("doubt"))).over(Window.partitionBy("query"))
    return (met.groupBy("query", "entry").agg(F.max("near").alias("near"), F.max("doubt").alias("doubt")).withColumn("n", F.row_number().over(best))
            .withColumn("cut", cut).where("cut is null or near >= cut").select("query", "entry"))


def ranked(asks: DataFrame, found: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best found, from exact scores on the original vectors."""
    pairs = (found.join(entries.select(F.col("entry").alias("query"), F.col("vector").alias("a")), "query")
             .join(entries.select("entry", F.col("vector").alias("b"), "ids"), "entry"))

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    # the square roots are taken apart so that neither overflow nor underflow of a product spoils the score
    scored = pairs.select(F.col("query").alias("entry"), "ids", (dot(F.col("a"), F.col("b")) / (F.sqrt(dot(F.col("a"), F.col("a"))) * F.sqrt(dot(F.col("b"), F.col("b"))))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (asks.join(scored, "entry").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def nearest(df: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5,
            tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """The k nearest found of each query row: query_id, rank, vec_id, score (cosine in double precision).

    ``is_query`` is a condition on the column ``id``. All rows are indexed; a query's own row is no candidate, rows
    with an equal vector are. Nearest first, ties to the smaller id; fewer than k rows only if there are fewer candidates. Null or
    empty vectors, zero vectors and vectors with null or non-finite components take no part, nor do null ids; a repeated
    (id, vector) row counts once. Vectors meet only vectors of their own length. Other columns are not read. An
    empty table gives an empty result.
    """
    entries = saved(distinct_vectors(df, vec_id, embedding, k + 1))
    asks = (df.select(plain(vec_id).cast("long").alias("id"), F.transform(plain(embedding), lambda v: v.cast("double")).alias("vector"))
            .where(is_query).distinct().join(entries.select("vector", "entry"), "vector").select(F.col("id").alias("query_id"), "entry"))
    asks = saved(asks)
    def search(some, among, tables):
        queries = among.join(some.select("entry").distinct(), "entry", "left_semi")
        return ranked(some, candidates(among, queries, tables, probes, k + 1), among, k)

    first = saved(search(asks, entries, tables))
    full = first.where(F.col("rank") == k).select("query_id")
    short = saved(asks.join(full, "query_id", "left_anti"))
    if short.isEmpty():
        return first
    lengths = entries.join(short.select("entry"), "entry", "left_semi").select("dim").distinct()
    return first.join(full, "query_id", "left_semi").unionByName(search(short, entries.join(lengths, "dim", "left_semi"), 0))
