"""Quoted delimited text over file pieces: records that hold delimiters or line breaks inside quotes.

A scan deals a file in pieces (its splits), and whether a piece begins inside quotes is known only from all pieces before
it. Each piece is therefore read once for both possibilities: an automaton over its lines (outside quotes, or inside)
gives the state it ends in and the field counts of its records. The pieces' maps are composed by file in one pass over a
row per piece, which tells every piece how it begins. Records are then put together piece by piece, in parallel; only the
lines of a record that crosses pieces meet again by a shuffle.

A quote opens a quoted field only where a field begins; a doubled quote inside stands for one; a quote within an unquoted
field is an ordinary character.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import q
from ..session import saved

OUTSIDE, INSIDE = 0, 1


@lru_cache(maxsize=None)
def _patterns(sep: bytes):
    d = re.escape(sep)
    return (re.compile(b'(^|' + d + b')"(?:[^"]++|"")*+"'), re.compile(b'(?:^|' + d + b')"'), re.compile(b'(?:[^"]++|"")*+"'))


def step(line: bytes, sep: bytes, state: int) -> tuple[int, int]:
    """(state after the line, delimiters outside quotes in it) of a line that begins in ``state``."""
    whole, opening, closing = _patterns(sep)
    if state == INSIDE:
        end = closing.match(line)
        if end is None:
            return INSIDE, 0
        line = b"x" + line[end.end():]  # goes on within the field that the quote closed
    rest = whole.sub(rb"\1", line)
    open_ = opening.search(rest)
    if open_ is None:
        return OUTSIDE, rest.count(sep)
    return INSIDE, rest[:open_.end()].count(sep)


class Run:
    """Records of a piece that begins in a state: closed ones by field count, the pieces of open ones at both ends."""

    def __init__(self, state: int):
        self.state, self.ended, self.head, self.open, self.crosses = state, state == OUTSIDE, 0, 0, False
        self.fields: Counter = Counter()

    def plain(self, counts: Counter) -> None:
        """Lines without quotes (delimiters by count), that begin and end outside."""
        self.fields.update({k + 1: n for k, n in counts.items()})

    def line(self, state: int, delimiters: int) -> None:
        self.open += delimiters
        if state == INSIDE:
            self.crosses = True
        elif self.ended:
            self.fields[self.open + 1] += 1
            self.open = 0
        else:
            self.head, self.open, self.ended = self.open, 0, True
        self.state = state


PIECES = ("file string, block long, sep string, entry int, state int, ended boolean, head long, open long, crosses boolean, "
          "fields array<long>, counts array<long>")


def lines_of(spark: SparkSession, paths) -> DataFrame:
    """file, block, value (bytes) of each line, in the order of the file within a block (a split of it)."""
    return spark.read.text(paths, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                         F.col("value").cast("binary").alias("value"))


def _blocks(batches):
    """(file, block, lines) of runs of equal blocks."""
    for batch in batches:
        at = 0
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        while at < batch.num_rows:
            end = at + 1
            while end < batch.num_rows and blocks[end] == blocks[at] and files[end] == files[at]:
                end += 1
            yield files[at], blocks[at], batch.column(2).slice(at, end - at)
            at = end


def pieces(lines: DataFrame, seps: list[str]) -> DataFrame:
    """PIECES of each piece, candidate delimiter and entry state."""

    def run(batches):
        held: dict = {}
        for file, block, values in _blocks(batches):
            runs = held.setdefault((file, block), {(d, e): Run(e) for d in seps for e in (OUTSIDE, INSIDE)})
            quoted = pc.match_substring(values.cast(pa.large_binary()), '"').to_pylist()
            text, at = values.to_pylist(), 0
            while at < len(text):
                end = at
                while end < len(text) and not quoted[end]:
                    end += 1
                for d in seps if end > at else ():
                    sep = d.encode()
                    filled = [x for x in text[at:end] if x.strip()]
                    counts = Counter(x.count(sep) for x in filled)
                    if runs[d, OUTSIDE].state == OUTSIDE:
                        runs[d, OUTSIDE].plain(counts)
                    if runs[d, INSIDE].state == OUTSIDE:
                        runs[d, INSIDE].plain(counts)
                if end < len(text):
                    for d in seps:
                        steps = {}
                        for e in (OUTSIDE, INSIDE):
                            state = runs[d, e].state
                            if state not in steps:
                                steps[state] = step(text[end], d.encode(), state)
                            runs[d, e].line(*steps[state])
                    end += 1
                at = end
        rows = [(f, b, d, e, r.state, r.ended, r.head, r.open, r.crosses, list(r.fields), list(r.fields.values()))
                for (f, b), runs in held.items() for (d, e), r in runs.items()]
        if rows:
            names = [c.split()[0] for c in PIECES.split(", ")]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names), schema=_PIECES_ARROW, preserve_index=False)

    return lines.mapInArrow(run, PIECES)


_PIECES_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("sep", pa.string()), ("entry", pa.int32()), ("state", pa.int32()),
                           ("ended", pa.bool_()), ("head", pa.int64()), ("open", pa.int64()), ("crosses", pa.bool_()),
                           ("fields", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
STARTS = "file string, sep string, fields array<long>, counts array<long>, crosses boolean, blocks array<long>, entries array<int>, begins array<long>"


def compose(found: DataFrame) -> DataFrame:
    """STARTS: by file and delimiter the records by field count, and of each piece the state it begins in and the piece
    in which the record began that is open there. One row per piece meets by file."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, open_, began, total, crosses = OUTSIDE, 0, -1, Counter(), False
        blocks, entries, begins = [], [], []
        for block, both in pdf.sort_values("block").groupby("block"):
            r = both[both["entry"] == state].iloc[0]
            blocks.append(int(block))
            entries.append(state)
            begins.append(began if state == INSIDE else int(block))
            total.update(dict(zip(map(int, r["fields"]), map(int, r["counts"]))))
            crosses |= bool(r["crosses"]) or state == INSIDE
            if state == INSIDE and r["ended"]:
                total[open_ + int(r["head"]) + 1] += 1
            if r["state"] == INSIDE:
                carried = state == INSIDE and not r["ended"]
                open_ = (open_ if carried else 0) + int(r["open"])
                began = began if carried else int(block)
            state = int(r["state"])
        if state == INSIDE:  # a quote that nothing closes: the file's end ends the record
            total[open_ + 1] += 1
        return pd.DataFrame([[pdf["file"].iloc[0], pdf["sep"].iloc[0], list(total), list(total.values()), crosses, blocks, entries, begins]],
                            columns=[c.split()[0] for c in STARTS.split(", ")])

    return found.groupBy("file", "sep").applyInPandas(run, STARTS)


RECORDS = "file string, block long, place long, part long, value binary"


def records(lines: DataFrame, sep: str, starts: dict[tuple[str, int], tuple[int, int]]) -> DataFrame:
    """file, block, place, value: whole records, by the piece they begin in and their place there, blank lines left out.

    starts: for (file, piece) the state it begins in and the piece in which the open record began; others begin outside.
    """
    held = lines.sparkSession.sparkContext.broadcast(starts)  # one entry per piece of the quoted files

    def run(batches):
        delimiter, now, out = sep.encode(), None, []

        def flush():
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                                 ["file", "block", "place", "part", "value"])
                out.clear()

        def close():
            """The record that the piece ends in goes on in later pieces."""
            if now and (state == INSIDE or not ended) and gathered:
                out.append((now[0], began, place if ended else -1, now[1], b"\n".join(gathered)))

        for file, block, values in _blocks(batches):
            if now != (file, block):
                close()
                now = (file, block)
                state, began = held.value.get(now, (OUTSIDE, block))
                ended, place, gathered = state == OUTSIDE, 0, []
            for line in values.to_pylist():
                if state == OUTSIDE and not line.strip():
                    continue
                state = step(line, delimiter, state)[0] if b'"' in line else state
                gathered.append(line)
                if state == OUTSIDE:
                    gathered[-1] = gathered[-1].removesuffix(b"\r")
                    out.append((file, began, place if ended else -1, block, b"\n".join(gathered)))
                    began, place, gathered = block, place + 1 if ended else 0, []
                    ended = True
                if len(out) >= 4096:
                    yield from flush()
        close()
        yield from flush()

    found = lines.mapInArrow(run, RECORDS)
    # the first line of a crossing record has its place in the piece it begins in, the others have place -1
    crossing = saved(found.withColumn("first", F.col("block") == F.col("part")))
    more = crossing.where("place = -1").groupBy("file", "block").agg(F.sort_array(F.collect_list(F.struct("part", "value"))).alias("rest"))
    last = crossing.where("place >= 0").groupBy("file", "block").agg(F.max("place").alias("place"))
    joined = more.join(last, ["file", "block"]).select("file", "block", "place", "rest")
    whole = crossing.where("place >= 0").join(joined, ["file", "block", "place"], "left")
    text = F.concat_ws("\n", F.col("value").cast("string"), F.transform("rest", lambda r: r["value"].cast("string")))
    return whole.select("file", "block", "place", F.when(F.col("rest").isNull(), F.col("value")).otherwise(text.cast("binary")).alias("value"))


def decoded(value: Column, encoding: str) -> Column:
    """Text of bytes in UTF-8 or a code page of one byte a character, read as Latin-1 and translated where it differs."""
    name = codecs.lookup(encoding).name
    if name in ("utf-8", "utf-8-sig"):
        return value.cast("string")
    page = bytes(range(256)).decode(name, "replace")
    if len(page) != 256:
        raise ValueError(f"{encoding} is no code page of single bytes")
    latin = F.decode(value, "ISO-8859-1")
    other = [i for i in range(256) if page[i] != chr(i)]
    return F.translate(latin, "".join(map(chr, other)), "".join(page[i] for i in other)) if other else latin


def _typed(df: DataFrame) -> DataFrame:
    """Text columns as the first type that fits all their values: int, bigint, double, date, timestamp, boolean or text."""
    kinds = ["int", "bigint", "double", "date", "timestamp", "boolean"]
    row = df.agg(*[F.count(F.col(q(c))).alias(f"n{i}") for i, c in enumerate(df.columns)],
                 *[F.count(F.expr(f"try_cast({q(c)} AS {k})")).alias(f"k{i}_{k}") for i, c in enumerate(df.columns) for k in kinds]).first()
    fit = [next((k for k in kinds if row[f"n{i}"] and row[f"k{i}_{k}"] == row[f"n{i}"]), "string") for i in range(len(df.columns))]
    return df.select(*[F.col(q(c)).cast(k).alias(c) for c, k in zip(df.columns, fit)])


def read_quoted(spark: SparkSession, files: list[str], encoding: str, sep: str, header: bool, infer_schema: bool,
                starts: dict[tuple[str, int], tuple[int, int]]) -> DataFrame:
    """Files whose records hold line breaks, or of any code page, as a table; files of different headers are united by name."""
    rows = saved(records(lines_of(spark, files), sep, starts))
    text = decoded(F.col("value"), encoding)
    first = (F.col("block") == 0) & (F.col("place") == 0)
    heads: dict[tuple, list[str]] = {}
    for r in rows.where(first).select("file", text.alias("text")).collect():  # one record per file
        names = next(csv.reader(io.StringIO(r["text"].lstrip("﻿")), delimiter=sep))
        heads.setdefault(tuple(names) if header else tuple(f"_c{i}" for i in range(len(names))), []).append(r["file"])
    out = None
    for names, own in heads.items():
        part = rows.where(F.col("file").isin(own) & (~first if header else F.lit(True)))
        fields = ", ".join(f"f{i} STRING" for i in range(len(names)))
        options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
        table = part.select(F.from_csv(text, fields, options).alias("r")).select(*[F.col("r")[f"f{i}"].alias(n) for i, n in enumerate(names)])
        out = table if out is None else out.unionByName(table, allowMissingColumns=True)
    return _typed(out) if infer_schema else out
