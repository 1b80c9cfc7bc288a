"""N-gram Jaccard join by prefix trees.

1. Every document's set of 5-word shingles becomes 64-bit fingerprints. Documents with equal sets form a class (a
   128-bit digest of the set); from here on a class counts once, however many copies it has.
2. A set that reaches 0.8 with another shares at least 4/5 of its shingles. One pass sends 32-bit fingerprints by
   bucket and counts each class's shingles that no other class has; a class with more than a fifth of them has no
   link. Fingerprint clashes can only keep a class longer.
3. Among the classes left, shingles get exact frequencies and one global order, rare first. Two linked sets share a
   shingle of their prefixes (the first n - ceil(0.8 n) + 1), so the components of "shares a prefix shingle" (found
   from one edge per posting, to the posting's smallest class) are blocks that no link leaves.
4. The sets of a block are stored in prefix trees, split into chunks of bounded size. Each chunk's tree is probed with
   its own sets and those of the block's later chunks, so that any two classes meet once; links are counted by class,
   weighted by the documents of the class at the other end.
5. Components of the links, carried back to the classes' documents.

Where components alone are asked for, each chunk is probed with the block's first set; sets linked to it are one
component and need not probe each other, all others probe all chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .graph import components
from .memory import lean
from .prefix_tree import PrefixTree, local_ids
from .store import WORD, bucket_count, fresh, plain, saved, text_volume
from .words import Words, mix64, pairs_index, pieces

SIZE = 5
BUCKET_BYTES = 24 << 20  # text whose shingles one bucket task sees on average (its memory is about ten times that)
CHUNK_SHINGLES = 1 << 21  # shingles of the sets in one tree, on average
LINK_SHINGLES = 1 << 19  # the same where every set probes: the work of a task grows with its square
BLOOM_BITS = 26


class ShingleSets:
    """Distinct shingles of each text of a column: values sorted by text, bounds, sizes and two digests of each set."""

    def __init__(self, column: pa.Array, size: int = SIZE):
        words = Words(column, lower=True)
        counts, left = words.counts(), words.left()
        start = np.arange(len(left)) == np.repeat(words.bounds[:-1], counts)
        short = np.repeat(counts, counts) < size
        use = (left >= size) | (start & short)  # a text of fewer words is one shingle as a whole
        values = words.grams(size)
        if short.any():
            at = np.flatnonzero(start & short)
            values[at] = words.runs(at, at + left[at])
        doc = np.repeat(np.arange(len(counts)), counts)[use]
        values = values[use]
        order = np.lexsort((values, doc))
        doc, values = doc[order], values[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
        self.doc, self.values = doc[new], values[new]
        self.sizes = np.bincount(self.doc, minlength=len(counts))
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        self.digests = np.stack([self._sum(mix64(self.values ^ np.uint64(salt))) for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)], 1)

    def _sum(self, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return (sums[self.bounds[1:]] - sums[self.bounds[:-1]]).view(np.int64)


def _int64(column: pa.Array) -> np.ndarray:
    return column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def shingle_classes(rows: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 and the text's digest for each row of (doc_id, text, digest)."""

    @lean
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = ShingleSets(piece.column(1), size)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sets.sizes, pa.int64()), *(pa.array(d) for d in sets.digests.T), piece.column(2)],
                                                 ["doc_id", "n_shingles", "d1", "d2", "digest"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, digest binary")


PACKED = "bucket int, owners binary, counts binary, values binary"


def deal(owners: np.ndarray, doc: np.ndarray, target: np.ndarray, buckets: int, *values: np.ndarray) -> pa.RecordBatch:
    """Rows of PACKED (one more column for a second array of values): each bucket's owners, their counts and values."""
    order = np.lexsort((doc, target)) if buckets > 1 else np.argsort(doc, kind="stable")
    target, doc, values = target[order], doc[order], [v[order] for v in values]
    edges = np.searchsorted(target, np.arange(buckets + 1))
    out: list[list] = [[] for _ in range(3 + len(values))]
    for bucket in np.flatnonzero(np.diff(edges)):
        part = slice(edges[bucket], edges[bucket + 1])
        held, counts = np.unique(doc[part], return_counts=True)
        for column, value in zip(out, (int(bucket), owners[held].tobytes(), counts.astype(np.uint32).tobytes(), *(v[part].tobytes() for v in values))):
            column.append(value)
    names = ["bucket", "owners", "counts", "values", "often"][:len(out)]
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], names)


def by_value(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a fingerprint, from its high bits."""
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def dealt(batches, columns: int, *widths: type) -> list[np.ndarray]:
    """All of a bucket task's PACKED rows: owners (n, columns), owner index by value, values."""
    owners, counts, values = [], [], [[] for _ in widths]
    for batch in batches:
        for o, c, *v in zip(*(col.to_pylist() for col in batch.columns[1:])):
            owners.append(np.frombuffer(o, np.int64).reshape(-1, columns))
            counts.append(np.frombuffer(c, np.uint32))
            for held, one, width in zip(values, v, widths):
                held.append(np.frombuffer(one, width))
    if not owners:
        return [np.zeros((0, columns), np.int64), np.zeros(0, np.int64), *(np.zeros(0, w) for w in widths)]
    owners = np.concatenate(owners)
    return [owners, np.repeat(np.arange(len(owners)), np.concatenate(counts)), *(np.concatenate(v) for v in values)]


def unshared(rows: DataFrame, size: int, buckets: int) -> DataFrame:
    """d1, d2, alone: for each class the number of its shingles that no other class has (or fewer, on clashes)."""

    @lean
    def send(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = ShingleSets(piece.column(1), size)
                first = np.zeros(len(sets.sizes), bool)
                first[np.unique(sets.digests, axis=0, return_index=True)[1]] = True  # copies of a class once a piece
                use = first[sets.doc]
                if use.any():
                    values = sets.values[use]
                    yield deal(sets.digests, sets.doc[use], by_value(values, buckets), buckets, values.astype(np.uint32))

    @lean
    def count(batches):
        owners, at, values = dealt(batches, 2, np.uint32)
        if not len(owners):
            return
        classes, index = pairs_index(owners)
        owner = index[at]
        order = np.lexsort((owner, values))
        owner, values = owner[order], values[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
        owner, values = owner[new], values[new]
        fresh = np.ones(len(values), bool)
        fresh[1:] = values[1:] != values[:-1]
        alone = np.bincount(owner[fresh & np.append(fresh[1:], True)], minlength=len(classes))
        yield deal(classes, np.arange(len(classes)), by_value(classes[:, 0].view(np.uint64), buckets), buckets, alone.astype(np.uint32))

    @lean
    def total(batches):
        owners, at, alone = dealt(batches, 2, np.uint32)
        if not len(owners):
            return
        classes, index = pairs_index(owners)
        sums = np.bincount(index[at], weights=alone, minlength=len(classes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(classes[:, 0]), pa.array(classes[:, 1]), pa.array(sums)], ["d1", "d2", "alone"])

    parts = rows.mapInArrow(send, PACKED).repartitionById(buckets, F.col("bucket")).mapInArrow(count, PACKED)
    return parts.repartitionById(buckets, F.col("bucket")).mapInArrow(total, "d1 long, d2 long, alone long")


def _bloom_keys(d1: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return mix64(d1.view(np.uint64) ^ mix64(doc_id.view(np.uint64)))


def likely(left: DataFrame) -> list[np.ndarray]:
    """Bloom bitmaps of (d1, first_id), of fixed size."""

    @lean
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield sketch.report(_bloom_keys(_int64(batch.column(0)), _int64(batch.column(1))), BLOOM_BITS)

    return sketch.merged(left.select("d1", "first_id").mapInArrow(run, sketch.SCHEMA), BLOOM_BITS, 1)


def class_sets(rows: DataFrame, left: DataFrame, size: int) -> DataFrame:
    """cls, n, values (packed): the shingle set of each class of ``left``, from its first document.

    The Bloom bits keep most other documents on the map side; the join after them is exact.
    """
    bitmaps = rows.sparkSession.sparkContext.broadcast(likely(left))

    @lean
    def run(batches):
        maps = bitmaps.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = ShingleSets(piece.column(1), size)
                ok = sketch.reached(maps, _bloom_keys(np.ascontiguousarray(sets.digests[:, 0]), _int64(piece.column(0))), BLOOM_BITS) & (sets.sizes > 0)
                at = np.flatnonzero(ok)
                packed = [sets.values[sets.bounds[i]:sets.bounds[i + 1]].tobytes() for i in at]
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(at)), pa.array(sets.digests[at, 0]), pa.array(sets.digests[at, 1]),
                                                  pa.array(packed, pa.binary())], ["id", "d1", "d2", "values"])

    sets = rows.mapInArrow(run, "id long, d1 long, d2 long, values binary").withColumn("id", F.coalesce("id", F.lit(-(1 << 63))))
    sets = sets.groupBy("d1", "d2", "id").agg(F.first("values").alias("values"))
    wanted = left.select("cls", "n_shingles", "d1", "d2", F.coalesce("first_id", F.lit(-(1 << 63))).alias("id"))
    return sets.join(wanted, ["d1", "d2", "id"]).select("cls", F.col("n_shingles").alias("n"), "values")


def ordered_sets(sets: DataFrame, buckets: int) -> DataFrame:
    """cls, n, values (packed, shared ones only, rare first), prefix (array of long): classes that may have links."""

    @lean
    def send(batches):
        for batch in batches:
            arrays = [np.frombuffer(v, np.uint64) for v in batch.column(2).to_pylist()]
            if arrays:
                values = np.concatenate(arrays)
                owners = np.stack([batch.column(i).to_numpy() for i in (0, 1)], 1)
                yield deal(owners, np.repeat(np.arange(len(arrays)), [len(a) for a in arrays]), by_value(values, buckets), buckets, values)

    @lean
    def count(batches):
        owners, at, values = dealt(batches, 2, np.uint64)
        if not len(values):
            return
        _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
        often = counts[inverse]
        keep = often > 1
        if keep.any():
            target = by_value(mix64(owners[:, 0].view(np.uint64)), buckets)[at[keep]]
            yield deal(owners, at[keep], target, buckets, values[keep], often[keep].astype(np.uint32))

    @lean
    def order(batches):
        owners, at, values, often = dealt(batches, 2, np.uint64, np.uint32)
        if not len(owners):
            return
        classes, index = pairs_index(owners)
        owner = index[at]
        by = np.lexsort((values, often, owner))
        owner, values = owner[by], values[by]
        ends = np.searchsorted(owner, np.arange(len(classes) + 1))
        out = []
        for i, (cls, n) in enumerate(classes.tolist()):
            own = values[ends[i]:ends[i + 1]]
            needed = n - -(-4 * n // 5) + 1 - (n - len(own))  # prefix length less the unshared, which come first
            if needed > 0:
                out.append((cls, n, own.tobytes(), own[:needed].view(np.int64).tolist()))
        for i in range(0, len(out), 1000):
            cls, n, packed, prefix = zip(*out[i:i + 1000])
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(packed, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))],
                                             ["cls", "n", "values", "prefix"])

    counted = sets.select("cls", "n", "values").mapInArrow(send, PACKED).repartitionById(buckets, F.col("bucket")).mapInArrow(count, f"{PACKED}, often binary")
    return counted.repartitionById(buckets, F.col("bucket")).mapInArrow(order, "cls long, n long, values binary, prefix array<long>")


def blocks(ordered: DataFrame) -> DataFrame:
    """(node, root): classes by block; classes that share a prefix shingle are in one block."""
    postings = ordered.select("cls", F.explode("prefix").alias("shingle"))
    hubs = postings.groupBy("shingle").agg(F.min("cls").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = postings.join(hubs, "shingle").where("cls <> hub").select(F.col("cls").alias("u"), F.col("hub").alias("v")).distinct()
    return components(edges)


TASK = ["block", "chunk", "side"]


def _groups(batches):
    """Rows (dicts) of runs of equal TASK columns of sorted input."""
    held, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[c] for c in TASK)
            if held and now != key:
                yield held
                held = []
            key = now
            held.append(row)
    if held:
        yield held


def _ids(rows: list[dict]) -> tuple[list[np.ndarray], int]:
    return local_ids([np.frombuffer(r["values"], np.uint64) for r in rows])


def _unite(root: np.ndarray, own: int, found: np.ndarray) -> None:
    """One component of ``own`` and the sets found for it."""
    if (root[found] != root[own]).any():
        joined = np.unique(np.append(root[found], root[own]))
        root[np.isin(root, joined)] = joined[0]


def _edges(rows: list[dict], root: np.ndarray, pending: np.ndarray) -> pa.RecordBatch:
    """u, v, pending: a row of each set that is pending or hangs together with another, v the component's set."""
    cls = np.array([r["cls"] for r in rows], np.int64)
    at = np.flatnonzero(pending | (root != np.arange(len(rows))))
    return pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(cls[root[at]]), pa.array(pending[at])], ["u", "v", "pending"])


@lean
def chunk_links(batches):
    """First step, by (block, chunk): one row for each set of the chunk's components and those of the block's first set;
    sets not linked to that set are pending, as they still have to probe the block's other chunks."""
    for rows in _groups(batches):
        arrays, vocabulary = _ids(rows)
        hub = next(i for i, r in enumerate(rows) if r["cls"] == r["block"])
        tree = PrefixTree(arrays, [r["n"] for r in rows], vocabulary)
        near = np.zeros(len(rows), bool)
        near[tree.probe(arrays[hub], rows[hub]["n"])] = near[hub] = True
        root = np.arange(len(rows))
        root[near] = hub
        asking = np.flatnonzero(~near)
        for own, found in tree.probe_all([arrays[i] for i in asking], [rows[i]["n"] for i in asking]) if len(asking) else ():
            _unite(root, own, asking[found])
        yield _edges(rows, root, ~near)


@lean
def cross_links(batches):
    """Second step, by (block, chunk, side): sets of chunk ``side`` left pending probe the tree of another chunk."""
    for rows in _groups(batches):
        arrays, vocabulary = _ids(rows)
        inside = [i for i, r in enumerate(rows) if not r["probe"]]
        asking = np.array([i for i, r in enumerate(rows) if r["probe"]], np.int64)
        if not inside or not len(asking):  # no set fell into one of the chunks
            continue
        tree = PrefixTree([arrays[i] for i in inside], [rows[i]["n"] for i in inside], vocabulary)
        root = np.arange(len(rows))
        for own, found in tree.probe_all([arrays[i] for i in asking], [rows[i]["n"] for i in asking]):
            _unite(root, inside[own], asking[found])
        yield _edges(rows, root, np.zeros(len(rows), bool))


def tree_links(ordered: DataFrame, block_of: DataFrame, chunk_shingles: int) -> DataFrame:
    """(u, v): enough links for the components of all links between the sets of each block."""
    sets = ordered.select("cls", "n", "values").join(block_of.select(F.col("node").alias("cls"), F.col("root").alias("block")), "cls")
    total = sets.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / chunk_shingles)).alias("chunks"))
    sets = saved(sets.join(total, "block").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks"))))
    columns = ["block", "chunk", "side", "cls", "n", "values"]
    everywhere = sets.where("cls = block and chunks > 1").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).where("at <> chunk")
    first = sets.unionByName(everywhere.withColumn("chunk", F.col("at")).drop("at")).withColumn("side", F.lit(0).cast("long")).select(*columns)
    kind = "u long, v long, pending boolean"
    step = saved(first.repartition("block", "chunk", "side").sortWithinPartitions(*TASK, "cls").mapInArrow(chunk_links, kind))
    links = step.where("u <> v").select("u", "v")
    open_ = sets.where("chunks > 1").join(step.where("pending").select(F.col("u").alias("cls")).distinct(), "cls")
    if open_.isEmpty():
        return links
    sides = open_.groupBy("block", F.col("chunk").alias("side")).agg(F.lit(1).alias("one")).drop("one")
    trees = sets.join(sides, "block").where("chunk <> side").withColumn("probe", F.lit(False))
    probes = (open_.withColumn("side", F.col("chunk")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
              .where("chunk <> side").withColumn("probe", F.lit(True)))
    second = trees.select(*columns, "probe").unionByName(probes.select(*columns, "probe"))
    more = second.repartition(*TASK).sortWithinPartitions(*TASK, "cls").mapInArrow(cross_links, kind)
    return links.unionByName(more.select("u", "v"))


@lean
def every_link(batches):
    """By (block, chunk, side): all links within a chunk (side = chunk) or between a chunk's tree and the sets of chunk
    ``side``. One row per linked class: the smallest class it hangs together with here and the documents it links to."""
    for rows in _groups(batches):
        arrays, vocabulary = _ids(rows)
        inside = [i for i, r in enumerate(rows) if not r["probe"]]
        asking = [i for i, r in enumerate(rows) if r["probe"]]
        within = rows[0]["side"] == rows[0]["chunk"]
        if not inside or not (within or asking):  # no set fell into one of the chunks
            continue
        tree = PrefixTree([arrays[i] for i in inside], [rows[i]["n"] for i in inside], vocabulary)
        probes = np.array(inside if within else asking)
        copies = np.array([r["copies"] for r in rows], np.int64)
        linked, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for own, found in tree.probe_all([arrays[i] for i in probes], [rows[i]["n"] for i in probes]):
            own, found = inside[own], probes[found]
            found = found[found != own]
            linked[found] += copies[own]
            if not within:
                linked[own] += copies[found].sum()
            _unite(root, own, found)
        cls = np.array([r["cls"] for r in rows], np.int64)
        at = np.flatnonzero(linked)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(cls[root[at]]), pa.array(linked[at])], ["cls", "root", "linked"])


def all_links(ordered: DataFrame, block_of: DataFrame, copies: DataFrame, chunk_shingles: int) -> DataFrame:
    """cls, root, linked: by class and pair of chunks the documents of other classes it links to; (cls, root) are edges
    with the components of all links. ``copies`` has the documents of each class (cls, copies)."""
    sets = (ordered.select("cls", "n", "values").join(block_of.select(F.col("node").alias("cls"), F.col("root").alias("block")), "cls")
            .join(copies, "cls"))
    total = sets.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / min(chunk_shingles, LINK_SHINGLES))).alias("chunks"))
    sets = saved(sets.join(total, "block").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks"))))
    columns = ["block", "chunk", "side", "cls", "n", "copies", "values", "probe"]
    trees = sets.withColumn("side", F.explode(F.sequence("chunk", F.col("chunks") - 1))).withColumn("probe", F.lit(False))
    probes = (sets.where("chunk > 0").withColumn("side", F.col("chunk")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("side") - 1)))
              .withColumn("probe", F.lit(True)))
    return (trees.select(*columns).unionByName(probes.select(*columns)).repartition(*TASK).sortWithinPartitions(*TASK, "cls")
            .mapInArrow(every_link, "cls long, root long, linked long"))


def joined(rows: DataFrame, size: int, chunk_shingles: int, links: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, d1, d2, digest) of (doc_id, text, digest), and their classes: d1, d2, component_id,
    n_links, first_id and digest (the row of the smallest id, then digest), kept (one class of each component)."""
    texts = rows.select("doc_id", "text")
    buckets = bucket_count(text_volume(texts, "text"), BUCKET_BYTES)
    members = saved(shingle_classes(rows, size))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "digest"))
    classes = (members.where("n_shingles > 0").groupBy("d1", "d2")
               .agg(F.first("n_shingles").alias("n_shingles"), first.alias("first"), F.count(F.lit(1)).alias("copies"))
               .select("d1", "d2", "n_shingles", F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("digest"), "copies"))
    left = saved(classes.join(unshared(texts, size, buckets), ["d1", "d2"]).where(F.col("alone") * 5 <= F.col("n_shingles"))
                 .withColumn("cls", F.monotonically_increasing_id()))
    ordered = saved(ordered_sets(saved(class_sets(texts, left, size)), buckets))
    if links:
        pairs = saved(all_links(ordered, blocks(ordered), left.select("cls", "copies"), chunk_shingles))
        linked = components(pairs.select(F.col("cls").alias("u"), F.col("root").alias("v")))
        counts = pairs.groupBy("cls").agg(F.sum("linked").alias("linked"))
    else:
        linked = components(tree_links(ordered, blocks(ordered), chunk_shingles))
        counts = linked.select(F.col("node").alias("cls"), F.lit(0).alias("linked"))
    grouped = left.select("cls", "first_id", "d1", "d2").join(linked.withColumnRenamed("node", "cls"), "cls")
    place = F.struct(F.col("first_id").isNull().alias("absent"), "first_id", "d1", "d2")
    smallest = grouped.groupBy("root").agg(F.min(place).alias("least"))
    found = (grouped.join(smallest, "root").join(counts, "cls")
             .select("d1", "d2", F.col("least.first_id").alias("linked_id"), "linked", ((F.col("least.d1") == F.col("d1")) & (F.col("least.d2") == F.col("d2"))).alias("least")))
    known = classes.join(found, ["d1", "d2"], "left").select(
        "d1", "d2", F.coalesce("linked_id", "first_id").alias("component_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        "first_id", "digest", F.coalesce("least", F.lit(True)).alias("kept"))
    return members, known


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE,
                    chunk_shingles: int = CHUNK_SHINGLES, links: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, n_links, at a similarity of 0.8 or more.

    n_links is the number of other documents that the row's document links with, copies included. Without ``links`` it
    is left out, and links that components don't need are not searched.
    component_id is the smallest id reachable by links, the row's own id included. Texts without words have no
    shingles and link with nothing; texts of fewer than five words have one, the whole sequence. Rows that repeat an id
    are documents of their own (equal texts link). Null ids take part; they are larger than any other, so a component
    has a null id only if all its documents have. Ids are integers. Other columns are not read. An empty table gives
    an empty result.
    """
    rows = df.select(plain(doc_id).cast("long").alias("doc_id"), F.coalesce(plain(text), F.lit("")).alias("text"), F.lit(None).cast("binary").alias("digest"))
    members, known = joined(rows, size, chunk_shingles, links)
    out = members.join(known.drop("digest"), ["d1", "d2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out if links else out.drop("n_links")


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE,
                         chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """The input's rows, of each component one row, of its smallest id (all columns).

    Components are told apart by their rows, not by ids: rows that share an id, or have none, stand for their own
    component only. Rows without words stay, all of them.
    """
    here, key = fresh(df, "_digest"), fresh(df, "_id")
    value, number = here + "_kept", plain(doc_id).cast("long")
    whole = F.coalesce(plain(text), F.lit(""))
    digest = F.unhex(F.sha2(whole, 256))
    members, known = joined(df.select(number.alias("doc_id"), whole.alias("text"), digest.alias("digest")), size, chunk_shingles, False)
    kept = saved(known.where("kept").select(F.col("first_id").alias(key), F.col("digest").alias(value))
                 .unionByName(members.where("n_shingles = 0").select(F.col("doc_id").alias(key), F.col("digest").alias(value)).distinct()))
    out = df.withColumn(here, digest).join(kept, number.eqNullSafe(F.col(key)) & (F.col(here) == F.col(value)), "left_semi")
    repeats = saved(members.where("n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if not repeats.isEmpty():  # ids that repeat: of their rows of one text with words one stays
        again = repeats.select(F.col("doc_id").alias(key))
        same = number.eqNullSafe(F.col(key))
        worded = whole.rlike(WORD)
        more = out.where(worded).join(again, same, "left_semi").dropDuplicates([doc_id, here])
        out = out.where(~worded).unionByName(out.where(worded).join(again, same, "left_anti")).unionByName(more)
    return out.select(*[plain(c) for c in df.columns])
