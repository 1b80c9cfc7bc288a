"""Merkle manifest of a dataset by slot pivot.

Each row is a leaf; leaves of a part (language) are ordered and folded by runs of ``fanout`` into the part's subroot,
subroots in the order of their parts likewise into the root. Every pass groups nodes by the subtree that is ``height``
levels up and spreads its children with conditional aggregates into slot columns; concatenating the columns of a run
hashes its parent, and leaving out the own slot's column gives the siblings. So a pass is one shuffle of equal groups
of at most ``fanout ** height`` rows, whatever the sizes of the parts, and the passes number log(rows) / height.

Positions come from a range partitioning by part and order key: rows are numbered inside their partition and shifted by
a table of one row per partition and part. No part, however large, is numbered in one task. Proofs go from the root
down, one row per subtree, and meet the leaves in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import plain, positions, saved

FANOUT, HEIGHT = 2, 4  # a pass has FANOUT ** HEIGHT slots
ENTRY = "struct<before:string,after:string>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated parts; a null part adds nothing."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """A value as its length in UTF-8 bytes, a colon and its text; a dash where it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _level_up(nodes: list[Column], left: Column, fanout: int) -> list[Column]:
    """Parents of the slots of a subtree; a part with one node left passes it on."""
    runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
    return [F.when(left > 1, F.when(run[0].isNotNull(), digest(*run))).otherwise(run[0]) for run in runs]


def pivot(nodes: DataFrame, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """part, block, n, level0 .. level<height>: one row per subtree of ``height`` levels of (part, pos, n, h).

    level0 holds the slots (null where a node is lacking), level k the hashes k levels up, the last one the subtree's own;
    n is the number of nodes that the part has at level0.
    """
    slots = fanout ** height
    spread = nodes.groupBy("part", F.floor(F.col("pos") / slots).alias("block")).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("pos") % slots == s, F.col("h"))).alias(f"slot{s}") for s in range(slots)])
    out = spread.select("part", "block", "n", F.array(*[f"slot{s}" for s in range(slots)]).alias("level0"))
    for k in range(height):
        held = [F.get(f"level{k}", F.lit(s)) for s in range(fanout ** (height - k))]
        out = out.select("*", F.array(*_level_up(held, nodes_left(k, fanout), fanout)).alias(f"level{k + 1}"))
    return out


def nodes_left(k: int, fanout: int) -> Column:
    """Nodes that a part of n nodes has k levels up."""
    return F.ceil(F.col("n") / fanout ** k)


def siblings(slot: Column, fanout: int, height: int) -> Column:
    """Path of a slot through its subtree: for each level the hashes before and after the own one in its run."""
    entries = []
    for k in range(height):
        at = F.floor(slot / fanout ** k).cast("int")
        own = at % fanout
        level, first = F.col(f"level{k}"), at - own
        entry = F.struct(F.array_join(F.slice(level, first + 1, own), "").alias("before"),
                         F.array_join(F.slice(level, at + 2, fanout - 1 - own), "").alias("after"))
        entries.append(F.when(nodes_left(k, fanout) > 1, F.array(entry)).otherwise(F.array().cast(f"array<{ENTRY}>")))
    return F.concat(*entries)


class Tree:
    """Merkle trees of all parts of a node table (part, pos, n, h) at once; keeps one pivot table per pass."""

    def __init__(self, nodes: DataFrame, fanout: int = FANOUT, height: int = HEIGHT):
        self.fanout, self.height, self.passes = fanout, height, []
        largest = nodes.agg(F.max("n")).first()[0] or 1
        while True:
            blocks = saved(pivot(nodes, fanout, height))
            self.passes.append(blocks)
            largest = -(-largest // fanout ** height)
            nodes = blocks.select("part", F.col("block").alias("pos"), nodes_left(height, fanout).alias("n"), F.get(f"level{height}", F.lit(0)).alias("h"))
            if largest == 1:
                break
        self.roots = nodes.select("part", F.col("h").alias("root"))

    def with_paths(self, tops: DataFrame) -> DataFrame:
        """The subtrees of the first pass with ``path``, from their root up; tops: part, path above the part's root, more columns."""
        paths = tops.withColumn("block", F.lit(0).cast("long"))
        for blocks in reversed(self.passes[1:]):
            here = blocks.join(paths, ["part", "block"]).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(self.fanout ** self.height - 1))))
            here = here.where(F.get("level0", F.col("slot")).isNotNull())
            path = F.concat(siblings(F.col("slot"), self.fanout, self.height), "path").alias("path")
            below = (F.col("block") * self.fanout ** self.height + F.col("slot")).alias("block")
            paths = saved(here.select("part", below, path, *[c for c in tops.columns if c not in ("part", "path")]))
        return self.passes[0].join(paths, ["part", "block"])

    def join_leaves(self, leaves: DataFrame, tops: DataFrame) -> DataFrame:
        """leaves (part, pos and others) with the path of each to the root and the other columns of ``tops``."""
        slots = self.fanout ** self.height
        inner = self.with_paths(tops)
        rows = leaves.drop("n").withColumn("block", F.floor(F.col("pos") / slots)).withColumn("slot", (F.col("pos") % slots).cast("int"))
        path = F.concat(siblings(F.col("slot"), self.fanout, self.height), "path").alias("path")
        others = [c for c in tops.columns if c not in ("part", "path")]
        return rows.join(inner, ["part", "block"]).select(*[c for c in leaves.columns if c != "n"], path, *others)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, e: digest(e["before"], h, e["after"]))


def manifest(df: DataFrame, fields: list[Column], part: Column, order: Column, forged: Column | None = None,
             fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """One row per input row: doc_id (the order key), part, pos, leaf, subroot, root, path, proof_sha256, folded_root, verified.

    fields: the encoded values (see ``field``) whose concatenation a leaf hashes; forged: the hash that a row's leaf is
    replaced by when its path is folded, null where it stays. Leaves ascend by the order key, null keys first; ties by
    leaf; equal rows are interchangeable leaves, one each. Parts ascend bytewise, a null part first. A part with one
    row has that leaf as subroot, and a single part's subroot is the root; such levels add no path entry. A run that has
    one node hashes it alone. Texts count as bytes, however long; an empty text differs from null. An empty
    table gives an empty result. Columns of the input not named are not read, whatever their names.
    """
    key = F.coalesce(F.concat(F.lit("="), part.cast("string")), F.lit(""))  # sorts as the part does, null first
    forged = F.lit(None).cast("string") if forged is None else forged
    leaves = saved(df.select(order.alias("doc_id"), part.alias("lang"), key.alias("part"), digest(*fields).alias("h"), forged.alias("forged")))
    leaves = saved(positions(leaves, "part", ["doc_id", "h"]))
    tree = Tree(leaves.select("part", "pos", "n", "h"), fanout, height)
    subroots = saved(tree.roots.select(F.lit("").alias("part"), F.col("part").alias("name"), F.col("root").alias("h")))
    placed = saved(positions(subroots, "part", ["name"]))
    top = Tree(placed.select("part", "pos", "n", "h"), fanout, height)
    root = top.roots.first()
    start = top.roots.select("part", F.array().cast(f"array<{ENTRY}>").alias("path"))
    tops = saved(top.join_leaves(placed, start).select(F.col("name").alias("part"), "path", F.col("h").alias("subroot")))
    rows = tree.join_leaves(leaves, tops)
    root = F.lit(root["root"] if root else None).cast("string")
    folded = fold(F.coalesce("forged", "h"), F.col("path"))
    proof = digest(F.array_join(F.flatten(F.transform("path", lambda e: F.array(e["before"], e["after"]))), ""))
    return (rows.select("doc_id", F.col("lang").alias("part"), "pos", F.col("h").alias("leaf"), "subroot", root.alias("root"), "path",
                        proof.alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def document_manifest(df: DataFrame, tampered: Column | None = None, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """The manifest of a document table by language; rows where ``tampered`` holds are folded with n_chars one higher."""
    values = {c: plain(c) for c in COLUMNS}
    later = values | {"n_chars": plain("n_chars").cast("decimal(20,0)") + 1}
    forged = None if tampered is None else F.when(tampered, digest(*map(field, later.values())))
    return manifest(df, list(map(field, values.values())), plain("lang"), plain("doc_id"), forged, fanout, height)
