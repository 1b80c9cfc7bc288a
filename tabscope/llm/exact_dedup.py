"""Exact deduplication with a heavy-hitter split.

Only digests are shuffled, never texts. Misra-Gries summaries of every partition are summed into a list of at most
``counters`` candidate digests; their exact counts (second pass) leave the verified winners, which are broadcast and
resolved on the map side. All other digests, each rarer than ``2 / counters`` of the rows, meet in one ordinary
shuffle. Hot digests therefore never gather in one task, however many rows they hold.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .memory import lean
from .store import SPACE, fresh, keep_ids, plain, saved

COUNTERS = 4096


def text_digest(text: str):
    """SHA-256 (32 bytes) of a text with each run of white space replaced by one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(plain(text), F.lit("")), SPACE, " "), 256))


def misra_gries(counts: Counter, counters: int) -> Counter:
    """Reduce a summary to at most ``counters`` entries; each count falls by the (counters + 1)-th largest."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def frequent(digests: DataFrame, counters: int = COUNTERS) -> tuple[DataFrame, int]:
    """Candidates (digest) among which is every digest held by at least 2 / counters of the rows, and the row count.

    A summary with k counters undercounts by less than its rows / (k + 1), and sums of summaries keep that bound, so
    a digest of frequency f has a summed count above f - n / (k + 1). Counts sum to n at most, hence at most
    ``counters`` digests can reach n / counters.
    """

    @lean
    def summarise(batches):
        summary: Counter = Counter()
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            summary.update(batch.column(0).to_pylist())
            if len(summary) > 4 * counters:
                summary = misra_gries(summary, counters)
        summary = misra_gries(summary, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *summary], pa.binary()), pa.array([rows, *summary.values()], pa.int64())], ["digest", "n"])

    sums = saved(digests.select("digest").mapInArrow(summarise, "digest binary, n long")
                 .groupBy("digest").agg(F.sum("n").alias("n")))
    total = sums.where("digest is null").agg(F.sum("n")).first()[0] or 0
    return sums.where(F.col("digest").isNotNull() & (F.col("n") >= max(1, total / counters))).select("digest"), total


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts form a group; the row with the smallest id stays. Exactly one row of a group is kept, also where rows
    repeat an id; a null id is larger than any other (keep_id is null if all ids of the group are). Empty and null
    texts form one group. An empty table
    gives an empty result; other columns of the input are not read, whatever their names.
    """
    rows = saved(df.select(plain(doc_id).alias("doc_id"), text_digest(text).alias("digest"),
                           F.monotonically_increasing_id().alias("row")))
    candidates, total = frequent(rows, counters)
    first = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")
    facts = {"first": F.min(first), "group_size": F.count(F.lit(1))}
    winners = saved(rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(*[f.alias(n) for n, f in facts.items()])
                    .where(F.col("group_size") >= max(2, 2 * total / counters)))
    hot = rows.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    rest = (rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
            .select("*", *[f.over(same).alias(n) for n, f in facts.items()]))
    both = hot.select(*rest.columns).unionByName(rest)
    return both.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
                       (F.col("row") == F.col("first.row")).alias("kept"),
                       F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The input's rows without copies: of each group of equal texts the row with the smallest id, all columns kept.

    Of rows that repeat both text and id one stays.
    """
    here = fresh(df, "_digest")
    key, value = fresh(df, "_id"), here + "_kept"
    kept = saved(exact_groups(df, doc_id, text, counters).where("kept").select(F.col("doc_id").alias(key), F.unhex("text_sha256").alias(value)))
    out = df.withColumn(here, text_digest(text)).join(kept, plain(doc_id).eqNullSafe(F.col(key)) & (F.col(here) == F.col(value)), "left_semi")
    repeats = saved(df.groupBy(plain(doc_id).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    if not repeats.isEmpty():  # ids that repeat: only their rows are deduplicated as rows
        more = keep_ids(out, doc_id, repeats, "left_semi").dropDuplicates([doc_id, here])
        out = keep_ids(out, doc_id, repeats, "left_anti").unionByName(more)
    return out.select(*[plain(c) for c in df.columns])
