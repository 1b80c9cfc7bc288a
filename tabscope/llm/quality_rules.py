"""Quality rules: surface counts of every text and a hashed n-gram log-likelihood ratio, in DataFrame functions alone.

Words and word pairs of a text fall into ``buckets`` hash buckets. Two multinomials over the buckets are counted over
all documents: the trusted target (documents whose id is in a list of trusted ids) and the raw corpus (all documents).
A document's score is the mean over its n-grams of log(target / raw), so length does not count. The weights are whole
numbers (fixed point, ``SCALE``), so sums and verdicts do not depend on the order of summation and reruns agree.

Only the list of weights (``buckets`` numbers, whatever the corpus) passes through the driver. The corpus is read twice:
once joined to the trusted ids and counted by bucket with map-side partial sums, once to score each row on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import BLANKS, fixed, plain, saved, words_of

BUCKETS = 1 << 14
PRIOR = 5.0  # added to both expected and seen trusted counts of a bucket: rare n-grams weigh little
THRESHOLD = -0.11  # least mean log ratio of a document that stays
SCALE = 65536  # fixed-point unit of the weights
SYMBOLS = "[#*$%&|<>]"
RUN = 5  # words of a window whose repetition counts
LEAST_WORDS, MOST_REPEATED = 10, 20  # fewer words, or more than this percentage in repeated windows, fail


def bucket_of(gram: Column, buckets: int) -> Column:
    return (F.crc32(gram.cast("binary")) % buckets).cast("int")


def gram_buckets(words: Column, buckets: int) -> Column:
    """Buckets of all words and of all pairs of neighbouring words (one space between), repeats included."""
    later = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    earlier = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.concat(F.transform(words, lambda w: bucket_of(w, buckets)),
                    F.zip_with(earlier, later, lambda a, b: bucket_of(F.concat(a, F.lit(" "), b), buckets)))


def count_grams(df: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """bucket, raw, target: n-grams of all documents and of the trusted ones, over whole texts.

    The trusted ids are the hashed side of the join, so texts are shuffled once and not sorted; rows under one hot id
    are split by adaptive execution. Each task sums by bucket before the shuffle (at most ``buckets`` rows of a task).
    """
    ids = trusted.select(plain(trusted.columns[0]).alias("id")).where("id is not null").distinct().withColumn("listed", F.lit(True))
    rows = df.select(plain(doc_id).alias("id"), plain(text).alias("text"))
    flagged = rows.join(ids.hint("shuffle_hash"), "id", "left").select(
        F.col("listed").isNotNull().cast("long").alias("hit"), fixed(words_of(F.coalesce("text", F.lit(""))).alias("words")))
    grams = flagged.select("hit", F.explode(gram_buckets(F.col("words"), buckets)).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("hit").alias("target"))


def bucket_weights(counts: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> list[int]:
    """Weight of each bucket: log((target + prior) / (expected + prior)) in units of 1 / SCALE, expected the raw share.

    Both multinomials carry the same smoothing mass; without trusted n-grams, and for an unseen bucket, the weight is 0.
    """
    raw, target = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    expected = F.col("raw") * F.lit(float(target) / max(raw, 1))
    weight = F.round(F.log((F.col("target") + F.lit(float(prior))) / (expected + F.lit(float(prior)))) * SCALE).cast("long")
    seen = dict(counts.select("bucket", weight.alias("w")).collect())  # at most ``buckets`` rows
    return [seen.get(b, 0) for b in range(buckets)]


def repeated_words(words: Column, run: int = RUN) -> Column:
    """Words covered by windows of ``run`` words that occur twice or more in the same text, first occurrence included.

    Distinct window hashes prove most texts free of repeats. Only the others sort their windows by hash and compare
    neighbours, by hash and word by word.
    """
    def word(i: Column, k: int) -> Column:
        return F.get(words, i + k)  # slice() would copy the whole array for each window

    def same(one: Column, other: Column) -> Column:
        equal = one["h"] == other["h"]
        for k in range(run):
            equal = equal & (word(one["i"], k) == word(other["i"], k))
        return F.coalesce(equal, F.lit(False))

    def covered(hashes: Column) -> Column:
        # Each array is bound as the element of a one-element array, so that it is made once and not for each neighbour.
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = F.sort_array(F.get(F.transform(F.array(ordered), lambda s: F.transform(
            F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))), lambda x: x["i"])), F.lit(0)))
        none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-run).alias("last"))
        return F.aggregate(places, none, lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(run), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - run), lambda i: F.xxhash64(*[word(i, k) for k in range(run)]))
    counted = F.get(F.transform(F.array(hashed), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))), F.lit(0))
    return F.when(F.size(words) <= run, F.lit(0).cast("long")).otherwise(counted)


def surface(text: Column, words: Column) -> dict[str, Column]:
    """Counts of one text (not null): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    repeated = F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0))
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_dup_lines": repeated,
        "n_repeat_words": repeated_words(words),
    }
    return {name: value.cast("long") for name, value in counts.items()}


def score(df: DataFrame, weights: list[int], threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, the surface counts, base_failed, n_grams, ratio_sum, score, kept."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")  # constant, folded once
    rows = df.select(plain(doc_id).alias("doc_id"), F.coalesce(plain(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", fixed(words_of(F.col("text")).alias("words")))
    words = F.col("words")
    total = F.aggregate(gram_buckets(words, len(weights)), F.lit(0).cast("long"), lambda sum_, b: sum_ + F.get(table, b))
    grams = F.greatest(2 * F.size(words) - 1, F.lit(0)).cast("long")
    counts = [c.alias(n) for n, c in surface(F.col("text"), words).items()]
    out = rows.select("doc_id", fixed(*counts, grams.alias("n_grams"), total.alias("ratio_sum")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (out.withColumn("base_failed", failed)
            .withColumn("score", F.col("ratio_sum") / F.greatest(F.col("n_grams"), F.lit(1)) / F.lit(float(SCALE)))
            .withColumn("kept", ~F.col("base_failed") & (F.col("ratio_sum") >= F.lit(round(threshold * SCALE)) * F.col("n_grams"))))


def quality_rules(df: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
                  prior: float = PRIOR, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_grams,
    ratio_sum, score, kept; ``trusted`` holds the ids of the trusted documents in its first column.

    Null texts count as empty, and empty texts have no words and fail the base rule. Repeated rows get the same result
    each and count each in the multinomials; a trusted id marks all rows that hold it. Null ids are scored and never
    trusted; ids without a document and repeated ids in the list change nothing. Without trusted documents every score
    is 0 and the base rule alone decides. A score equal to the threshold stays. Whole texts are read, however long.
    An empty table gives an empty result. Other columns of the input are not read, whatever their names.
    """
    weights = bucket_weights(saved(count_grams(df, trusted, buckets, doc_id, text)), buckets, prior)
    return score(df, weights, threshold, doc_id, text)


def keep_good(df: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
              prior: float = PRIOR, threshold: float = THRESHOLD) -> DataFrame:
    """The input's rows whose texts pass, all columns kept; judged row by row, so repeated and null ids do no harm."""
    weights = bucket_weights(saved(count_grams(df, trusted, buckets, doc_id, text)), buckets, prior)
    judged = score(df.select(F.struct(*[plain(c) for c in df.columns]).alias("row"), plain(text).alias("text")), weights, threshold, "row")
    return judged.where("kept").select(*[F.col("doc_id")[c].alias(c) for c in df.columns])
