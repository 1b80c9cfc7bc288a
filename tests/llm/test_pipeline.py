"""Stages of corpus_pipeline and its run against plain Python versions, on odd and given documents."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabscope.llm import mixing, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STAGE = dict(corpus_pipeline.STAGES)


def key(i):
    return (i is None, i or 0)


def brute_exact(rows):
    """Of equal texts one row of the smallest id."""
    kept = {}
    for r in rows:
        t = SPACE.sub(" ", r[1] or "")
        if t not in kept or key(r[0]) < key(kept[t]):
            kept[t] = r[0]
    return Counter((i, t) for t, i in kept.items())


def shingles(text):
    w = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows):
    """Numbers of rows that stay together: components of shingle sets at 0.8, rows without words alone."""
    sets = [shingles(r[1] or "") for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                parent[find(a)] = find(b)
    groups = {}
    for a in range(len(rows)):
        groups.setdefault(find(a), []).append(rows[a])
    return list(groups.values())


def words(rng, n):
    return [rng.choice("lake hill road tree bird sky rain wind".split()) + rng.choice("abcdefghij") for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean and toxic documents, copies, near copies, null and repeated ids, empty texts; labels for some."""
    rng = random.Random(9)
    bad = "you stupid idiot you are worthless trash and scum"
    rows = []
    for i in range(160):
        text = " ".join(words(rng, 40))
        rows.append((i, f"{text} {bad} {text[:50]}" if i % 4 == 0 else text, "en", ("a", "b", None)[i % 3], i))
    base = rows[1][1]
    near = base.replace(" ", "  ", 3)
    rows += [(200, base, "de", "a", 1), (None, base, "en", "b", 2), (5, near, "en", "a", 3), (None, None, None, None, None), (201, "", "en", "a", 0),
             (202, " \n", "en", "a", 2), (203, base + " tail", "en", "a", 4), (None, base + " tail", "en", "a", 4), (204, bad, "en", "b", 5), (7, bad + " again", "en", "b", 6)]
    rows += [(rows[9][0], "another text under a known id " + " ".join(words(rng, 20)), "en", "a", 9), rows[10], rows[10]]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(160)], "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return path, rows, bad


def read(spark, path):
    return spark.read.parquet(f"{path}/documents.parquet")


def plain(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_toxic_documents_go_and_clean_ones_stay(spark, tables):
    path, rows, bad = tables
    out = STAGE["toxicity"](spark, read(spark, path), path)
    assert out.columns == COLUMNS
    assert Counter(plain(out)) == Counter(r for r in rows if bad not in (r[1] or ""))
    docs, labels = read(spark, path), spark.read.parquet(f"{path}/labels.parquet")
    assert Counter(plain(out)) == Counter(plain(toxicity.drop_toxic(docs, labels)))


def test_exact_copies(spark, tables):
    path, rows, _ = tables
    out = STAGE["exact_dedup"](spark, read(spark, path), path)
    assert out.columns == COLUMNS
    assert Counter((r[0], SPACE.sub(" ", r[1] or "")) for r in plain(out)) == brute_exact(rows)


def test_near_copies(spark, tables):
    path, rows, _ = tables
    out = STAGE["ngram_join"](spark, read(spark, path), path)
    assert out.columns == COLUMNS
    left = Counter(plain(out))
    assert not left - Counter(rows)
    for group in brute_near(rows):
        own = [r for r in left.elements() if r in group]
        if WORD.search(group[0][1] or ""):
            assert len(own) == 1 and key(own[0][0]) == min(key(r[0]) for r in group)
        else:
            assert len(own) >= len(group)


def brute_mix(rows):
    """Row -> how often it is taken; rows equal in id, source and text are numbered in any order."""
    sizes, place = Counter(), Counter()
    items = []
    for r in rows:
        text = hashlib.md5((r[1] or "").encode()).hexdigest()
        k = (r[0], r[3], text)
        name = f"{'' if r[0] is None else r[0]}:{text}:{place[k]}"
        place[k] += 1
        size = len(WORD.findall(r[1] or ""))
        items.append((r, size, int(hashlib.md5(name.encode()).hexdigest()[:15], 16)))
        sizes[r[3]] += size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = budget - sum(2 * sizes[s] for s in capped)
        level = rest / max(1e-12, sum(weight[s] for s in order if s not in capped))
        over = {s for s in order if s not in capped and level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    out = Counter()
    for s in order:
        target = 2.0 * sizes[s] if s in capped else level * weight[s]
        base = int(target // sizes[s]) if sizes[s] else 0
        left, upto = target - base * sizes[s], 0
        for r, size, _ in sorted((x for x in items if x[0][3] == s), key=lambda x: x[2]):
            more = base < 2 and left > 0 and upto + size / 2 <= left
            upto += size
            out[r] += base + more
    return out


def test_mix(spark, tables):
    path, rows, _ = tables
    out = STAGE["mixing"](spark, read(spark, path), path)
    assert out.columns == COLUMNS
    want = brute_mix(rows)
    assert Counter({k: n for k, n in Counter(plain(out)).items() if k[1]}) == Counter({k: n for k, n in want.items() if n and k[1]})


def test_tokens(spark, tables):
    tokenizers = pytest.importorskip("tokenizers")
    import sys

    sys.path.insert(0, "/opt/tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path, rows, _ = tables
    library = tokenizers.Tokenizer.from_file(str(public.path("word_bpe_49k.json")))
    library.no_truncation()
    library.no_padding()

    def expected(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    got = STAGE["bpe"](spark, read(spark, path), path).collect()
    assert Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == Counter((r[0], r[3], *expected(r[1])) for r in rows)


def test_run_applies_the_stages_in_turn(spark, tables):
    path, rows, bad = tables
    got = corpus_pipeline.run(spark, path).collect()
    left = [r for r in rows if bad not in (r[1] or "")]
    kept = brute_exact(left)
    firsts = []
    for (i, t), _ in kept.items():
        firsts.append(next(r for r in left if r[0] == i and SPACE.sub(" ", r[1] or "") == t))
    alone = [min(g, key=lambda r: key(r[0])) for g in brute_near(firsts)]
    want = brute_mix(alone)
    assert Counter((r.doc_id, r.source) for r in got) == sum((Counter({(k[0], k[3]): n}) for k, n in want.items() if n), Counter())


def test_empty_tables(spark, tables):
    path, _, _ = tables
    empty = read(spark, path).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0, name
    assert mixing.mix(empty).agg(F.count("*")).first()[0] == 0
