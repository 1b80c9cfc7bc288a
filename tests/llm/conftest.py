import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside; they may be columns of the input too
CLASHES = ["digest", "row", "size", "hash", "key1", "positions", "cls", "score", "ids", "n", "part", "first", "count", "_id", "_copies", "label"]


def words(rng, n):
    return [rng.choice("the of and to in is on by with ant bee cat dog elk fox gnu hen".split()) + rng.choice("abcdefghij") for _ in range(n)]


def hand_rows():
    """Null, empty and blank texts, ties, repeated rows, short, long and very long texts, near copies, shared passages."""
    rng = random.Random(5)
    base = words(rng, 300)
    passage = words(rng, 60)
    near = list(base)
    near[150] = "changed"
    texts = [None, "", " \n\t ", "one", "one two", "ONE two", "one two three four five", "One  Two\nthree four five",
             " ".join(base), " ".join(base), "  ".join(base), " ".join(near), " ".join(base[:290]),
             " ".join(words(rng, 100) + passage + words(rng, 80)), " ".join(passage + words(rng, 40)),
             " ".join(words(rng, 50) + passage[:35]), " ".join(words(rng, 50) + passage[:34]),
             "x" * 3000, "la " * 200, " ".join(words(rng, 20_000)), "é ü <|endoftext|> 😀 ﬁ ▁▁ a▁b \x00 <s>",
             "don't we'll IT'S 1234 ?!? <|im_end|> <\\|x", "\r\n\x0b\x0c"]
    rows = [(i, t, "en", ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, "one two", "en", "a", 7), (None, None, None, None, None), (None, " ".join(base), "en", None, 0)]
    return rows


@pytest.fixture(scope="session")
def hand(spark):
    """Hand-made documents with extra columns of clashing names, over several partitions."""
    df = spark.createDataFrame(hand_rows(), DOCS).repartition(3)
    return df.select("*", *[F.lit(1).alias(c) for c in CLASHES]).cache()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def none(spark, hand):
    return hand.limit(0).cache()
