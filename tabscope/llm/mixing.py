"""Mixing sources to target weights by hash thresholds, without sorting rows.

Every document gets a fixed hash of its id, text and number among equal rows. Sizes are summed by source and the leading 12 bits of the hash; the
running sums of a source's buckets show in which bucket its budget ends, and only that boundary bucket is summed again
by the next 12 bits, until a single hash value is left. Documents below the threshold are taken once more than the
others; a filter on the hash applies it. Thresholds of growing budgets are nested, so a larger mix contains a smaller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import WORD, plain, positions, saved

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BITS, LEVELS = 12, 5


def row_hash(doc_id: Column, digest: Column, rank: Column) -> Column:
    """60 bits of the MD5 of a row's id as text (null: empty), its text's MD5 and its number among equal rows."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), digest, rank.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def text_md5(text: str) -> Column:
    return F.md5(F.coalesce(plain(text), F.lit("")))


KEY = ["of_id", "of_source", "of_digest"]


def _keys(doc_id: Column, source: Column, digest: Column) -> list[Column]:
    return [c.alias(k) for c, k in zip((doc_id, source.cast("string"), digest), KEY)]


def _equal(repeated: DataFrame) -> Column:
    """The rows of a key table, null keys equal, against one with the same keys named again_*."""
    same = [F.col(k).eqNullSafe(F.col(f"again_{k}")) for k in KEY]
    return same[0] & same[1] & same[2]


def numbered(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """rows (KEY columns and others) with ``hash``; rows equal in id, source and text get numbers of their own.

    repeated: the keys (again_*) that more than one row holds, None if there are none. Their rows are numbered over range
    partitions, so that an id, or one whole row, may hold any share of the table and still spread over all hash values.
    """
    hash_ = lambda rank: row_hash(F.col("of_id"), F.col("of_digest"), rank).alias("hash")
    if repeated is None:
        return rows.select("*", hash_(F.lit(0)))
    alone = rows.join(repeated, _equal(repeated), "left_anti").select("*", hash_(F.lit(0)))
    again = saved(rows.join(repeated, _equal(repeated), "left_semi").withColumn("of_key", F.to_json(F.struct(*KEY))))
    return alone.unionByName(positions(again, "of_key", []).select(*rows.columns, hash_(F.col("pos"))))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> with target: ``share`` of all sizes dealt by weight, at most ``most`` times the source.

    Weights repeat over the sources in code point order, null last. What a capped source can't take goes to the
    others by weight; with sources sorted by cap / weight, a source is capped if the budget covers it and all before
    it at its own level. Works on one row per source.
    """
    ranked = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(most)
    level = Window.orderBy("level", "place")
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (ranked.withColumn("weight", weight).withColumn("cap", cap).withColumn("level", F.col("cap") / F.col("weight"))
            .withColumn("budget", F.sum("source_size").over(everything) * float(share))
            .withColumn("full", F.col("level") * F.sum("weight").over(after) + F.coalesce(F.sum("cap").over(before), F.lit(0.0))
                        <= F.col("budget"))
            .withColumn("rest", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything))
            .withColumn("open", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything))
            .select("source", "source_size", F.when(F.col("full"), F.col("cap"))
                    .otherwise(F.col("rest") / F.col("open") * F.col("weight")).alias("target")))


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (source, size, hash), plan (source, budget) -> source, threshold: hashes below it hold the budget.

    Of the hash values the nearest prefix of the source's hash order is taken: a value is in if the middle of its size
    lies within the budget.
    """
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    # edge: the hash prefix chosen so far, at: size below it
    edges = plan.select("source", "budget", F.lit(0).cast("long").alias("edge"), F.lit(0).cast("long").alias("at"))
    for depth in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - depth)
        prefix = F.shiftright(F.col("hash"), shift)
        sums = (rows.join(edges.withColumnRenamed("source", "of"),
                          F.col("source").eqNullSafe(F.col("of")) & (F.shiftright(F.col("hash"), shift + BITS) == F.col("edge")))
                .groupBy("source", "budget", "at", prefix.alias("bucket")).agg(F.sum("size").alias("n")))
        upto = sums.withColumn("upto", F.col("at") + F.sum("n").over(running))
        # the first bucket whose sum passes the budget; past the last bucket all are in
        edges = saved(upto.groupBy("source", "budget")
                      .agg(F.min(F.when(F.col("upto") > F.col("budget"), F.struct("bucket", F.col("upto") - F.col("n"), "n"))).alias("hit"),
                           F.max("bucket").alias("last"), F.max("upto").alias("all"))
                      .select("source", "budget", F.coalesce("hit.bucket", F.col("last") + 1).alias("edge"),
                              F.coalesce("hit.col2", F.col("all")).alias("at"), F.col("hit.n").alias("n")))
        if depth < LEVELS:
            done = edges.where("n is null").select("source", F.shiftleft("edge", shift).alias("threshold"))
            found = done if depth == 1 else found.unionByName(done)
            edges = edges.where("n is not null").select("source", "budget", "edge", "at")
    inside = F.col("n").isNull() | (F.col("at") + F.col("n") / 2 <= F.col("budget"))
    return found.unionByName(edges.select("source", (F.when(F.col("n").isNull(), F.col("edge"))
                                                     .otherwise(F.col("edge") + inside.cast("long"))).alias("threshold")))


def _planned(df: DataFrame, doc_id: str, text: str, source: str, weights, share: float, most: int) -> tuple:
    """(rows with hash and size, repeated keys or None, plan by source: of, source_size, target, base, threshold)."""
    rows = saved(df.select(*_keys(plain(doc_id), plain(source), text_md5(text)),
                           F.coalesce(F.regexp_count(plain(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    repeated = saved(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(k).alias(f"again_{k}") for k in KEY]))
    repeated = None if repeated.isEmpty() else repeated
    rows = numbered(rows, repeated).withColumnRenamed("of_source", "source")
    rows = rows if repeated is None else saved(rows)
    plan = saved(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
                 .withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
                 .withColumn("budget", F.col("target") - F.col("base") * F.col("source_size")))
    limits = thresholds(rows, plan.where((F.col("budget") > 0) & (F.col("base") < most)))
    plan = plan.join(limits.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    return rows, repeated, saved(plan.withColumnRenamed("source", "of"))


COPIES = "base + IF(hash < coalesce(threshold, 0), 1, 0)"


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken.

    ``copies`` says how often the mix takes the document (0 to ``most``), ``taken`` = copies * size. Null and empty
    texts have size 0 and follow their hash like the others; a null source is a source; rows that repeat an id, or an id
    and a text, have hashes of their own, so a source comes within half a document of its target whatever its ids are;
    which of equal rows is taken once more is not said. A source without words has target 0 and copies 0. Other columns
    are not read. An empty table gives an empty result.
    """
    rows, _, plan = _planned(df, doc_id, text, source, weights, share, most)
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    return joined.select(F.col("of_id").alias("doc_id"), "source", "size", "source_size", "target", F.expr(COPIES).alias("copies"),
                         (F.expr(COPIES) * F.col("size")).alias("taken"))


def mixed_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
               weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: each input row as often as the mix takes it, with all its columns; see ``mix``.

    Null and empty texts, null ids and sources, ties and repeated rows, extra columns and empty tables are treated as there.
    """
    _, repeated, plan = _planned(df, doc_id, text, source, weights, share, most)
    whole = df.select(*_keys(plain(doc_id), plain(source), text_md5(text)), F.struct(*[plain(c) for c in df.columns]).alias("whole"))
    joined = numbered(whole, repeated).join(plan, F.col("of_source").eqNullSafe(F.col("of"))).withColumn("copies", F.expr(COPIES)).where("copies > 0")
    taken = joined.select("whole", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))).alias("copy"))
    return taken.select(*[F.col("whole").getField(c).alias(c) for c in df.columns])
