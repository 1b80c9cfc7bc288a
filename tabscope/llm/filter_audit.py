"""Filter interaction audit as an incremental stream with retractions.

All files of a document table pass as available-now micro-batches. Each text is known by its digest; the state keeps,
by digest, the smallest id seen so far and the filter masks of the rows that hold it. A row whose id is larger than its
text's smallest counts as a copy at once. When a smaller id arrives in a later batch, the rows counted as originals so
far are retracted from their parts' counters and counted again as copies. What the counters add up to after the last
batch does not depend on the order of the files.

State and counters are tables in the shared folder, one directory per batch. A batch reads the state of the batches
before it and overwrites its own directories, so that a batch repeated after a failure counts once; the offsets are in
the stream's checkpoint. Nothing but the counters (32 masks times labels by part) is read for the report. Sums by digest
and id run before each shuffle, and joins are left to adaptive execution, which splits a hot digest or id.
"""

from __future__ import annotations

import uuid
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.session import ensure_checkpoint_dir

from .store import fixed, plain, saved, words_of

FILTERS = "ABCDE"
COPY = 16  # bit of filter E in a mask; A, B, C and D are bits 0 to 3
BATCHES = 4  # micro-batches that a table is read in, about
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WHO = ["absent", "id"]  # the order of ids: a null id is larger than any other
CELL = ["part", "mask", "good", "toxic"]


def text_mask(text: Column, words: Column) -> Column:
    """Filters A to D that a text (not null) fails, as bits."""
    fails = [F.size(words) < LEAST_WORDS,
             100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
             100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > MOST_CAPITALS * F.length(text),
             text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))


def rows_of(df: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """digest, absent, id, part, mask of each row; works on a stream too."""
    rows = df.select(plain(doc_id).alias("id"), F.coalesce(plain(part).cast("string"), F.lit("")).alias("part"),
                     F.coalesce(plain(text), F.lit("")).alias("text"))
    rows = rows.select("id", "part", "text", fixed(words_of(F.col("text")).alias("words")))
    return rows.select(F.unhex(F.sha2("text", 256)).alias("digest"), F.col("id").isNull().alias("absent"), "id", "part",
                       text_mask(F.col("text"), F.col("words")).alias("mask"))


def marks_of(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """id, good, toxic: one row per labelled id; of contradicting labels the 1 counts."""
    def marked(name):
        return F.max(F.coalesce(plain(name) == 1, F.lit(False)))
    return labels.where(plain(doc_id).isNotNull()).groupBy(plain(doc_id).alias("id")).agg(marked(quality).alias("good"), marked(toxic).alias("toxic"))


class Audit:
    """State and counters of one audit in ``folder``; ``add`` takes a micro-batch of (digest, absent, id, part, mask)."""

    def __init__(self, spark: SparkSession, folder: str, marks: DataFrame):
        self.spark, self.folder, self.marks = spark, folder, marks

    def _write(self, df: DataFrame, table: str, batch: int) -> DataFrame:
        path = f"{self.folder}/{table}/{batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _before(self, table: str, batch: int, schema) -> DataFrame:
        """The table's rows of all earlier batches."""
        paths = [f"{self.folder}/{table}/{k}" for k in range(batch)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def add(self, batch: DataFrame, number: int) -> None:
        who = F.struct(*WHO)
        rows = self._write(batch, "rows", number)
        facts = rows.groupBy("digest", *WHO, "part", "mask").agg(F.count(F.lit(1)).alias("n")).join(self.marks, "id", "left")
        facts = self._write(facts.select("digest", *WHO, "part", "mask", F.coalesce("good", F.lit(False)).alias("good"),
                                         F.coalesce("toxic", F.lit(False)).alias("toxic"), "n"), "facts", number)
        here = facts.groupBy("digest").agg(F.min(who).alias("now"))
        state = self._before("state", number, facts.schema).join(here.select("digest"), "digest")
        known = state.groupBy("digest").agg(F.min(who).alias("was"))
        firsts = self._write(here.join(known, "digest", "left").select("digest", "was", F.least("now", "was").alias("first")), "firsts", number)

        placed = facts.join(firsts, "digest").withColumn("copy", who > F.col("first"))
        seen = placed.select("part", F.col("mask").bitwiseOR(F.when(F.col("copy"), COPY).otherwise(0)).alias("mask"), "good", "toxic", "n")
        moved = state.join(firsts.where("first < was"), "digest").where(who == F.col("was"))
        taken = moved.select(*CELL, (-F.col("n")).alias("n"))
        again = moved.select("part", F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), "good", "toxic", "n")
        self._write(seen.unionByName(taken).unionByName(again).groupBy(*CELL).agg(F.sum("n").alias("n")), "counters", number)
        self._write(placed.where(~F.col("copy")).select(*facts.columns), "state", number)

    def counters(self) -> DataFrame:
        """part, mask, good, toxic, n after all batches."""
        schema = "part string, mask int, good boolean, toxic boolean, n long"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/counters/*").groupBy(*CELL).agg(F.sum("n").alias("n")).where("n <> 0")


def steps() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, bit of the step's filter, bits of the filters before it) of all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            out.append(("".join(FILTERS[x] for x in order), k + 1, 1 << f, before))
            before |= 1 << f
    return out


def report(counters: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the mask counters.

    What a step does depends on its filter and the set of filters before it alone: each mask is counted for those 80
    pairs, and the orders take their steps from them.
    """
    pairs = sorted({s[2:] for s in steps()})
    every = F.array(*[F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit, before in pairs])
    mask = F.col("mask")
    fails, earlier = mask.bitwiseAND(F.col("bit")) != 0, mask.bitwiseAND(F.col("before")) != 0
    stays = mask.bitwiseAND(F.col("bit").bitwiseOR(F.col("before"))) == 0

    def total(when: Column) -> Column:
        return F.sum(F.when(when, F.col("n")).otherwise(F.lit(0)))

    gone = fails & ~earlier
    by_pair = counters.select("*", F.inline(every)).groupBy("part", "bit", "before").agg(
        total(stays).alias("kept"), total(gone).alias("removed"), total(fails & earlier).alias("redundant"),
        total(mask == F.col("bit")).alias("unique_fails"), total(gone & F.col("good")).alias("good_lost"), total(gone & F.col("toxic")).alias("toxic_lost"))
    orders = counters.sparkSession.createDataFrame(steps(), "filter_order string, step int, bit int, before int")
    rows = by_pair.join(F.broadcast(orders), ["bit", "before"])  # 600 rows
    total_removed = rows.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return rows.join(total_removed, ["part", "bit"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(spark: SparkSession, path: str, labels: DataFrame, folder: str | None = None, batches: int = BATCHES,
          doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, filter order and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (longs; zeros included).

    path: a Parquet table, whose files pass in about ``batches`` micro-batches; folder: where checkpoint, state and
    counters are kept (a new one in the shared folder by default; an audit that was broken off goes on if given the
    same). Null texts count as empty, a null part as the empty string; a part appears if it has a row. Of equal texts
    the smallest id passes filter E; rows that repeat that id pass too, and a null id is larger than any other. Labels
    of ids without a document, null ids and null labels mark nothing; rows that repeat an id are marked alike. Whole
    texts are read, however long. An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    folder = folder or f"{ensure_checkpoint_dir(spark)}/audit-{uuid.uuid4().hex}"
    table = spark.read.parquet(path)
    files = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"  # as a pattern, since a stream takes a single file only so
    each = -(-max(1, len(table.inputFiles())) // batches)
    state = Audit(spark, folder, saved(marks_of(labels)))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", each).parquet(files)
    query = (rows_of(stream, doc_id, text, part).writeStream.foreachBatch(state.add).option("checkpointLocation", f"{folder}/offsets")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return report(state.counters())
