"""Token counts of a sentencepiece BPE model with a whole-token shortcut.

No piece of the vocabulary has a word mark after another character, and none longer than a line break holds one
(``prove`` checks both and refuses a model for which they fail). No merge can therefore cross the start of a run of
word marks or touch a line break, and a text's tokens are those of its pre-tokens: a run of marks with the characters
that follow, or a line break. Offline, each vocabulary string that encodes alone as one token is proven by encoding it;
such pre-tokens count one without any merging, only the rest is merged by the library, once per distinct pre-token.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import plain

MODEL = "piece_bpe_32k.model"
MARK = "▁"
PRE_TOKEN = re.compile(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
REMEMBERED = 400_000  # pre-tokens whose counts a task keeps


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class PreTokenCounts(dict):
    """Tokens of a pre-token; proven whole tokens are known from the start."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.update(self.proven())
        self.limit = len(self) + REMEMBERED
        self.base = dict(self)

    def pieces(self) -> list[str]:
        m = self.model
        skip = (m.is_control, m.is_unknown, m.is_byte, m.is_unused)
        return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not any(f(i) for f in skip)]

    def proven(self) -> dict[str, int]:
        """Vocabulary strings that are pre-tokens and encode alone as one token."""
        pieces = self.pieces()
        if any(MARK in p.lstrip(MARK) or ("\n" in p and p != "\n") for p in pieces) or self.model.encode("\n") == []:
            raise ValueError("the shortcut needs a model whose pieces do not cross pre-tokens")
        whole = [p for p in pieces if PRE_TOKEN.fullmatch(p)]
        return {p: 1 for p, n in zip(whole, map(self.merged, whole)) if n == 1} | {"\n": self.merged("\n")}

    def merged(self, token: str) -> int:
        """Tokens of one pre-token by the library, which itself puts a mark before a text."""
        if token[0] == MARK:
            return len(self.model.encode(token[1:])) if len(token) > 1 else 1
        return len(self.model.encode("\n" + token)) - len(self.model.encode("\n"))

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
            self.update(self.base)
        count = self.merged(token)
        if len(token) <= 64:
            self[token] = count
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, PRE_TOKEN.findall(MARK + text.replace(" ", MARK))))


def count_tokens(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
                 limit: int = 4096) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    Counts equal the library's encode() without begin, end or added tokens; null and empty texts have none. Rows are
    independent: repeated and null ids stay as they are, other columns are not read, an empty table gives none.
    The model file is found on each machine by the tokenizer package unless ``path`` is given.
    """

    def run(batches):
        counts = PreTokenCounts(path or model_path())
        for batch in batches:
            tokens = [counts.count(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = df.select(plain(doc_id).alias("doc_id"),
                     F.coalesce(F.octet_length(plain(text)), F.lit(0)).cast("long").alias("n_bytes"), plain(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
