"""Quality rules, filter interaction audit and Merkle manifest against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tabscope.llm import filter_audit, merkle, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_surface(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def brute_rules(rows, trusted, buckets, prior=5.0, threshold=quality_rules.THRESHOLD):
    def grams(text):
        words = WORD.findall(text)
        return [zlib.crc32(g.encode()) % buckets for g in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i is not None and i in trusted:
            target.update(grams(t))
    share = sum(target.values()) / max(1, sum(raw.values()))
    weight = {b: round(math.log((target[b] + prior) / (raw[b] * share + prior)) * 65536) for b in raw}
    out = Counter()
    for i, t in rows:
        g, base = grams(t), brute_surface(t)
        total = sum(weight[b] for b in g)
        out[(i, *base, total, not base[-1] and total >= round(threshold * 65536) * len(g))] += 1
    return out


@pytest.mark.parametrize("name,buckets", [("hand", 64), ("docs", 1 << 14), ("none", 64)])
def test_quality_rules(request, spark, name, buckets):
    df = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    trusted = {i for i, _ in rows if i is not None and i % 3 == 0}
    ids = spark.createDataFrame([(i,) for i in [*trusted, *trusted, None, 10**9]], "clash long")
    got = quality_rules.quality_rules(df, ids, buckets=buckets).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.ratio_sum, r.kept)
                   for r in got) == brute_rules(rows, trusted, buckets)


def test_quality_rules_repeats_and_lines(spark):
    text = "a b c d e f a b c d e\nx y\n\nx y\n \nz a b c d e\n" + "n1 n2 n3 n4 n5 n6 n7 n8 n9 n10 " * 3
    texts = [text, "la " * 300, "one two three four five " * 2, "p q r s t u v w x y z", "a b c d", "\n\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality_rules.quality_rules(df, df.select("doc_id").limit(0)).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_surface(t or "")
        assert r.score == 0 and r.kept == (not r.base_failed)


def test_keep_good_judges_rows(spark):
    good = [(i, f"the quick fox number n{i} runs over the wide green field and rests") for i in range(60)]
    bad = [(None if i % 2 else 1, f"the&&& quick$$$ fox%%% x{i} runs### over*** the&&& wide%%% green### field*** and&&&") for i in range(20)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string").withColumn("score", F.lit(3)).withColumn("row", F.lit(4))
    trusted = spark.createDataFrame([(i,) for i in range(2, 60)], "doc_id long")
    kept = quality_rules.keep_good(df, trusted)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encode(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def levels(hashes, fanout):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def route(tree, at, fanout):
    """(before, after) of a leaf at each level below the root."""
    path = []
    for nodes in tree[:-1]:
        first = at - at % fanout
        path.append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + fanout])))
        at //= fanout
    return path


def brute_manifest(rows, fanout):
    parts = {}
    for r in rows:
        leaf = sha(encode(r.doc_id, r.source, r.lang, r.n_chars, r.text))
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        other = sha(encode(r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + 1, r.text)) if hit else leaf
        parts.setdefault(r.lang, []).append(((r.doc_id is not None, r.doc_id or 0), leaf, other, r.doc_id))
    names = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        parts[name].sort(key=lambda x: x[:2])
        trees[name] = levels([x[1] for x in parts[name]], fanout)
    top = levels([trees[name][-1][0] for name in names], fanout) if names else []
    out = Counter()
    for k, name in enumerate(names):
        for at, (_, leaf, other, doc_id) in enumerate(parts[name]):
            path = route(trees[name], at, fanout) + route(top, k, fanout)
            h = other
            for before, after in path:
                h = sha(before, h, after)
            out[(doc_id, leaf, trees[name][-1][0], top[-1][0], sha(*[x for e in path for x in e]), h, h == top[-1][0])] += 1
    return out


def manifest_rows(n):
    """Parts of one to many rows, null and empty values, repeated ids and rows, an id at the end of the long range."""
    rows = [(i, f"text {i} é" * (i % 4), ("en", "de", "fr")[i % 3 if i % 5 else 0], ("a", None, "")[i % 3], None if i % 6 == 0 else i) for i in range(n)]
    return rows + [(5, "alone", "it", None, 2**63 - 1), (7, None, None, None, None), (None, "", None, "a", 0), (None, "x", "en", "a", 0), rows[3], rows[3], rows[3],
                   (2**63 - 1, "long " * 50_000, "en", "s", 1), (14, "tie", "Ünï", "s", 2**63 - 1)]


@pytest.mark.parametrize("n,fanout,height", [(60, 2, 4), (60, 2, 1), (45, 3, 2), (4, 4, 2)])
def test_manifest(spark, n, fanout, height):
    df = spark.createDataFrame(manifest_rows(n), "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    clashing = df.select("*", *[F.lit(1).alias(c) for c in ("part", "pos", "h", "n", "block", "_row", "path", "leaf", "root")])
    out = merkle.document_manifest(clashing, hit, fanout, height).collect()
    got = Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out)
    assert got == brute_manifest(df.collect(), fanout)
    assert {r.verified for r in out} == {True, False}


def test_manifest_of_one_row_and_none(spark):
    df = spark.createDataFrame([(3, "only", "en", "a", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    one = merkle.document_manifest(df).first()
    assert one.root == one.leaf == one.subroot == one.folded_root and one.path == [] and one.verified and one.proof_sha256 == sha("")
    assert merkle.document_manifest(df.limit(0)).collect() == []


def brute_audit(rows, good, toxic):
    rows = [(i, t or "", p or "") for i, t, p in rows]
    least = {}
    for i, t, _ in rows:
        least[t] = min(least.get(t, (True, 0)), (i is None, i or 0))
    marked = []
    for i, t, p in rows:
        w = WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": (i is None, i or 0) > least[t]}
        marked.append((p, {f for f, x in fails.items() if x}, i in good, i in toxic))
    out, shapley = {}, defaultdict(int)
    for p in {m[0] for m in marked}:
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                own = [m for m in marked if m[0] == p]
                gone = [m for m in own if f in m[1] and not m[1] & set(order[:k])]
                shapley[p, f] += len(gone)
                out[p, order, k + 1] = (sum(not m[1] & set(order[:k + 1]) for m in own), len(gone), sum(f in m[1] and bool(m[1] & set(order[:k])) for m in own),
                                        sum(m[1] == {f} for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone))
    return {(*key, *v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def audit_rows():
    """Copies whose smallest id comes late, repeated rows and ids, null ids, texts and parts, a text of each failure."""
    long = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", "short", long, long + " #", long.upper(), "la " * 90, "LA| " * 90, long]
    rows = [(100 - i, texts[i % len(texts)], ("a", "b", None)[i % 3]) for i in range(60)]
    return rows + [(None, long, "a"), (None, "alone", "b"), (None, "alone", "c"), rows[3], rows[3], (41, long, "only here"), (5, "x " * 100_000, "a")]


@pytest.fixture(scope="module")
def audit_table(spark, tmp_path_factory):
    """Five files, so that several micro-batches bring smaller ids of texts already counted."""
    path = str(tmp_path_factory.mktemp("audit") / "documents.parquet")
    rows = audit_rows()
    for k in range(5):
        part = spark.createDataFrame(rows[k::5], "doc_id long, text string, source string").withColumn("mask", F.lit(1)).withColumn("id", F.lit(2))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("batches", [1, 5])
def test_audit(spark, audit_table, batches):
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(200)] + [(50, None, None), (None, 1, 1), (51, 0, 1)], "doc_id long, quality int, toxic int")
    good = {r.doc_id for r in labels.where("quality = 1 and doc_id is not null").collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1 and doc_id is not null").collect()}
    got = filter_audit.audit(spark, audit_table, labels, batches=batches)
    assert {tuple(r[c] for c in AUDIT) for r in got.collect()} == brute_audit(audit_rows(), good, toxic)


def test_audit_retracts_and_repeats_a_batch(spark, tmp_path):
    """A batch that is added again after a failure counts once; a smaller id moves the earlier original to the copies."""
    marks = filter_audit.marks_of(spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int"))
    state = filter_audit.Audit(spark, str(tmp_path / "audit"), marks)
    one = filter_audit.rows_of(spark.createDataFrame([(9, "same", "p"), (9, "same", "p"), (12, "same", "q")], "doc_id long, text string, source string"), "doc_id", "text", "source")
    two = filter_audit.rows_of(spark.createDataFrame([(3, "same", "q"), (9, "same", "p")], "doc_id long, text string, source string"), "doc_id", "text", "source")
    counted = lambda: {(r.part, r["mask"] & 16, r.good): r.n for r in state.counters().collect()}
    state.add(one, 0)
    assert counted() == {("p", 0, True): 2, ("q", 16, False): 1}
    state.add(two, 1)
    state.add(two, 1)
    assert counted() == {("p", 16, True): 3, ("q", 16, False): 1, ("q", 0, False): 1}


def test_audit_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(path)
    assert filter_audit.audit(spark, path, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
