"""Chat formatting with typed content parts.

A message's content is a list of typed parts. A visitor flattens them in order: text is escaped, an image, audio or
document part becomes a placeholder, its reference is recorded as an attachment and its expanded token count added.
Template of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts ``<|`` is written ``<\\|`` (one
backslash is added between ``<`` and ``|`` however many are there), which ``unescape`` reverses exactly; no control
string can therefore come from a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import plain

START, END = "<|im_start|>", "<|im_end|>\n"
EXPANDED = {"image": 256, "audio": 128, "document": 512}  # tokens a part stands for unless it says otherwise
PART = "struct<kind:string,text:string,ref:string,tokens:int>"
TURN = f"struct<turn:long,role:string,parts:array<{PART}>>"
FORMATTED = ("formatted string, n_turns long, loss_spans array<struct<from:int,to:int>>, "
             "attachments array<struct<position:int,kind:string,ref:string,tokens:int>>, expanded_tokens long")
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


class PartVisitor:
    """Flattens the parts of one conversation; one method per kind of part."""

    def __init__(self):
        self.out: list[str] = []
        self.length = 0
        self.loss: list[dict] = []
        self.attachments: list[dict] = []
        self.expanded = 0

    def write(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def turn(self, role: str, parts: list[dict]) -> None:
        self.write(f"{START}{escape(role)}\n")
        for kind, run in groupby(parts, lambda part: part.get("kind") or "text"):
            if kind == "text":  # neighbouring texts are escaped as one, so that no control string arises between them
                run = [{"text": "".join(part.get("text") or "" for part in run)}]
            for part in run:
                begin = self.length
                getattr(self, f"visit_{kind}", self.visit_other)(kind, part)
                if role == "assistant" and kind == "text":
                    self.loss.append({"from": begin, "to": self.length})
        self.write(END)

    def visit_text(self, kind: str, part: dict) -> None:
        self.write(escape(part.get("text") or ""))

    def _attach(self, kind: str, part: dict) -> None:
        tokens = part.get("tokens")
        tokens = EXPANDED[kind] if tokens is None else tokens
        self.attachments.append({"position": self.length, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        self.expanded += tokens
        self.write(f"<|{kind}_{len(self.attachments)}|>")

    visit_image = visit_audio = visit_document = _attach

    def visit_other(self, kind: str, part: dict) -> None:
        raise ValueError(f"unknown kind of content part: {kind}")


def format_turns(turns: list[dict]) -> dict:
    """Format one conversation; turns: dicts of role and parts, in order."""
    visitor = PartVisitor()
    for turn in turns:
        visitor.turn(turn["role"] or "", turn["parts"] or [])
    return {"formatted": "".join(visitor.out), "n_turns": len(turns), "loss_spans": visitor.loss,
            "attachments": visitor.attachments, "expanded_tokens": visitor.expanded}


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, read back from the formatted string; placeholders stay in the text."""
    for block in formatted.split(START)[1:]:
        role, _, text = block.removesuffix(END).partition("\n")
        yield unescape(role), unescape(text)


def format_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", parts: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns, loss_spans, attachments, expanded_tokens.

    ``parts`` names a column of typed parts (kind, text, ref, tokens); without it the text is one text part. Turns are
    in order of turn number, equal numbers by role and content, null numbers last; repeated rows stay. Null roles and
    texts count as empty, rows with a null conv_id form one conversation. A role with a line break is read back cut at
    it. loss_spans (code points of the formatted string) cover the assistant's text parts. Other columns are not read.
    A conversation is one output value, so its turns meet in one task.
    """
    content = plain(parts) if parts else F.array(F.struct(F.lit("text").alias("kind"), plain(text).alias("text"),
                                                          F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))
    key = F.struct(plain(turn).isNull().alias("absent"), plain(turn).cast("long").alias("turn"), plain(role).alias("role"), content.alias("parts"))
    grouped = df.select(plain(conv_id).alias("conv_id"), key.alias("key")).groupBy("conv_id").agg(F.sort_array(F.collect_list("key")).alias("turns"))

    def run(batches):
        for batch in batches:
            ids, turns = batch.column(0), batch.column(1)
            for at in range(batch.num_rows):
                row = format_turns(turns[at].as_py())
                yield pa.RecordBatch.from_pylist([{"conv_id": ids[at].as_py(), **row}], schema)

    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("n_turns", pa.int64()),
                        ("loss_spans", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
                        ("attachments", pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))),
                        ("expanded_tokens", pa.int64())])
    return grouped.mapInArrow(_merged(run), f"conv_id long, {FORMATTED}")


def read_back(formatted: DataFrame) -> DataFrame:
    """Facts read from the formatted strings: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def facts(conv_id, whole: str, spans: list[dict]) -> dict:
        turns = list(read_turns(whole))
        loss = "".join(unescape(whole[s["from"]:s["to"]]) for s in spans)
        return {"conv_id": conv_id, "n_turns": len(turns), "loss_chars": len(loss), "formatted_chars": len(whole),
                "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                "loss_sha256": hashlib.sha256(loss.encode()).hexdigest()}

    def run(batches):
        for batch in batches:
            rows = [facts(c.as_py(), f.as_py(), s.as_py()) for c, f, s in zip(*batch.columns)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _merged(run, rows: int = 500, size: int = 8 << 20):
    """Gather one-row batches into larger ones, bounded by rows and bytes."""

    def merged(batches):
        held, mass = [], 0
        for batch in run(batches):
            held.append(batch)
            mass += batch.nbytes
            if len(held) >= rows or mass >= size:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, mass = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return merged
