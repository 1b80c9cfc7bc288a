"""Operators on texts against brute force: deduplication, joins, token counts, BPE, mixing."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tabscope.llm import bpe, exact_dedup, jaccard_join, mixing, substring_dedup, token_counts
from tabscope.llm.prefix_tree import PrefixTree, local_ids
from tabscope.llm.queries import op7_bpe

def words(rng, n):
    return [rng.choice("the of and to in is on by".split()) + rng.choice("abcdefghij") for _ in range(n)]


WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def big(i):
    return (i is None, i or 0)


@pytest.mark.parametrize("name", ["hand", "docs", "none"])
@pytest.mark.parametrize("counters", [4096, 3])
def test_exact_groups(request, name, counters):
    df = request.getfixturevalue(name)
    groups = defaultdict(list)
    for i, t in rows_of(df):
        groups[SPACE.sub(" ", t)].append(i)
    expected = Counter((i, min(ids, key=big), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    got = exact_dedup.exact_groups(df, counters=counters).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_drop_copies_keeps_one_row_of_each_text(hand):
    out = exact_dedup.drop_copies(hand)
    assert out.columns == hand.columns
    kept = [SPACE.sub(" ", t) for _, t in rows_of(out)]
    assert sorted(kept) == sorted({SPACE.sub(" ", t) for _, t in rows_of(hand)})


def test_misra_gries_keeps_every_frequent_key():
    counts = Counter({k: n for k, n in zip("abcdefgh", (50, 40, 3, 3, 2, 2, 1, 1))})
    kept = exact_dedup.misra_gries(counts, 3)
    assert len(kept) <= 3 and {"a", "b"} <= set(kept)
    assert all(counts[k] - kept[k] <= sum(counts.values()) / 4 for k in "ab")


def shingles(text):
    lower = text.translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(lower)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
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
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), i), i, key=big)
    return Counter((i, len(sets[a]), least[find(a)]) for a, (i, _) in enumerate(rows))


@pytest.mark.parametrize("name,chunk", [("hand", 1 << 21), ("docs", 1 << 21), ("docs", 200), ("none", 100)])
def test_ngram_join(request, name, chunk):
    df = request.getfixturevalue(name)
    got = jaccard_join.near_duplicates(df, chunk_shingles=chunk).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows_of(df))


def test_ngram_join_chain_and_boundary(spark):
    """Chains link through their middle; 0.8 exactly links, just below does not; many near copies in small chunks."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(900 + i, " ".join(base[i:i + 40])) for i in range(0, 20, 2)]
    rows += [(1, " ".join("abcdefgh")), (2, " ".join("abcdefghi")), (3, "a b c d e f g h i j k")]
    for i in range(80):
        near = [f"v{j}" for j in range(120)]
        near[rng.randrange(120)] = f"e{i}"
        rows.append((100 + i, " ".join(near)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, chunk_shingles=1500).collect())
    assert got == brute_components(rows_of(df))


def brute_links(rows):
    sets = [shingles(t) for _, t in rows]
    near = [[100 * len(a & b) >= 80 * len(a | b) for b in sets] for a in sets]
    return Counter((i, len(s), sum(n) - 1 if s else 0) for (i, _), s, n in zip(rows, sets, near))


@pytest.mark.parametrize("name,chunk", [("hand", 1 << 21), ("docs", 200), ("none", 100)])
def test_ngram_links(request, name, chunk):
    df = request.getfixturevalue(name)
    got = jaccard_join.near_duplicates(df, chunk_shingles=chunk)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    rows = got.collect()
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in rows) == brute_links(rows_of(df))
    short = jaccard_join.near_duplicates(df, chunk_shingles=chunk, links=False)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == Counter(map(tuple, short.collect()))


@pytest.mark.parametrize("chunk", [1 << 21, 1500])
def test_ngram_links_of_many_distinct_near_copies(spark, chunk):
    """Near copies that all link to the first set, but not all to each other; some of them in copies."""
    import random

    rng = random.Random(4)
    rows = []
    for i in range(60):
        near = [f"v{j}" for j in range(150)]
        for at in rng.sample(range(150), i % 4):
            near[at] = f"e{i}"
        rows += [(100 + i, " ".join(near))] + [(500 + i, " ".join(near))] * (i % 5 == 0)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard_join.near_duplicates(df, chunk_shingles=chunk).collect()
    expected = brute_links(rows)
    assert len({n for _, _, n in expected}) > 3
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in got) == expected
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_drop_near_duplicates(hand):
    out = jaccard_join.drop_near_duplicates(hand)
    assert out.columns == hand.columns
    kept = {i for i, _, c in brute_components(rows_of(hand)) if i == c}
    assert {r.doc_id for r in out.collect()} == kept


def test_drop_near_duplicates_keeps_one_row_of_each_component(spark, hand):
    """Whole rows with counts: null ids, ids under several texts, rows that repeat id and text, rows without words."""
    import random

    rng = random.Random(9)
    texts = [" ".join(f"{k}{j}" for j in range(100)) for k in "pqrst"]
    near = [t + " end" for t in texts]
    odd = [(None, texts[0]), (None, near[0]), (None, None), (None, None), (None, ""), (60, texts[1]), (61, near[1]), (61, texts[2]), (62, near[2]),
           (62, texts[3]), (62, texts[3]), (63, near[3]), (60, near[4]), (60, texts[4]), (None, texts[4])]
    rng.shuffle(odd)
    more = spark.createDataFrame(odd, "doc_id long, text string")
    for df in (more.withColumn("row", F.lit(1)).repartition(3), hand):
        out = jaccard_join.drop_near_duplicates(df)
        assert out.columns == df.columns
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = [(r.doc_id, r.text) for r in out.collect()]
        assert not Counter(got) - Counter(rows)
        assert Counter(r for r in got if not shingles(r[1] or "")) == Counter(r for r in rows if not shingles(r[1] or ""))
        sets = [(i, shingles(t)) for i, t in rows if shingles(t or "")]
        group = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(sets[a][1] & sets[b][1]) >= 80 * len(sets[a][1] | sets[b][1]):
                    group = [group[b] if g == group[a] else g for g in group]
        stay = Counter()
        for i, t in got:
            if shingles(t or ""):
                mine = {group[j] for j, (_, s) in enumerate(sets) if s == shingles(t)}
                assert len(mine) == 1 and i == min((sets[j][0] for j in range(len(sets)) if group[j] in mine), key=big)
                stay.update(mine)
        assert stay == Counter(set(group))


def test_prefix_tree_finds_exactly_the_similar_sets():
    import random

    import numpy as np

    rng = random.Random(1)
    sets = []
    for _ in range(120):
        base = set(rng.sample(range(400), rng.choice([1, 2, 5, 40, 90])))
        sets += [base, base - set(rng.sample(sorted(base), len(base) // 10)) or base, base | {rng.randrange(400)}]
    arrays, vocabulary = local_ids([np.array(sorted(s), np.uint64) for s in sets])
    tree = PrefixTree(arrays, [len(s) for s in sets], vocabulary)
    for i, s in enumerate(sets):
        expected = {j for j, t in enumerate(sets) if 100 * len(s & t) >= 80 * len(s | t)}
        assert set(tree.probe(arrays[i], len(s)).tolist()) == expected


def test_prefix_tree_probes_in_batches_as_one_by_one(monkeypatch):
    import numpy as np

    from tabscope.llm import prefix_tree

    rng = np.random.default_rng(2)
    arrays, vocabulary = local_ids([np.unique(rng.integers(0, 60 + i % 3, 40 + i % 50)).astype(np.uint64) for i in range(90)])
    tree = PrefixTree(arrays, [len(a) for a in arrays], vocabulary)
    monkeypatch.setattr(prefix_tree, "CELLS", 7 * vocabulary)
    together = {(i, own) for own, found in tree.probe_all(arrays, [len(a) for a in arrays]) for i in found.tolist()}
    assert together == {(i, own) for i, a in enumerate(arrays) for own in tree.probe(a, len(a)).tolist()}


def brute_removal(rows, window):
    found = Counter()
    texts = [WORD.findall(t) for _, t in rows]
    for w in texts:
        found.update(tuple(w[p:p + window]) for p in range(len(w) - window + 1))
    out = Counter()
    for (i, _), w in zip(rows, texts):
        gone = set()
        for p in range(len(w) - window + 1):
            if found[tuple(w[p:p + window])] > 1:
                gone.update(range(p, p + window))
        out[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


@pytest.mark.parametrize("name,window,bits", [("hand", 35, None), ("hand", 35, 10), ("docs", 35, None), ("docs", 6, 10), ("none", 35, None)])
def test_substring_dedup(request, monkeypatch, name, window, bits):
    """Also with a sketch so small that nearly every window passes to the exact grouping."""
    if bits:
        monkeypatch.setattr(substring_dedup.sketch, "bits_for", lambda *a: bits)
    df = request.getfixturevalue(name)
    got = substring_dedup.remove_repeats(df, window=window).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_removal(rows_of(df), window)


@pytest.mark.parametrize("name", ["hand", "docs", "none"])
def test_token_counts(request, name):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    df = request.getfixturevalue(name)
    expected = Counter((i, len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 4096) for i, t in rows_of(df))
    got = token_counts.count_tokens(df)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(map(tuple, got.collect())) == expected


def test_token_shortcut_on_odd_texts():
    import random

    counts = token_counts.PreTokenCounts(token_counts.model_path())
    rng = random.Random(2)
    alphabet = " \n\t▁aeéthnsß.0123<>/s\r 😀​" + "\x00"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert counts.count(text) == len(counts.model.encode(text)), repr(text)
    assert len(counts.base) > 25_000


def library(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    library.model = getattr(library, "model", None) or Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    ids = library.model.encode(text, add_special_tokens=False).ids
    return ids, library.model.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["hand", "docs", "none"])
def test_bpe(request, name):
    df = request.getfixturevalue(name)
    out = bpe.encode(df, ids="ids", decoded="decoded")
    again = bpe.decode(out, decoded="again").select("doc_id", "text", "ids", "decoded", "again").collect()
    assert len(again) == df.count()
    for r in again:
        assert (r.ids, r.decoded) == library(r.text or "") and r.again == r.decoded
    assert [c for c in out.columns if c not in ("ids", "decoded")] == [c for c in df.columns if c != "ids"]


def test_bpe_every_code_point_and_long_words():
    import random

    model = bpe.WordBpe(bpe.model_path())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 500):
        text = "".join("a" + chr(c) + "b1" + chr(c) + "! " for c in points[i:i + 500])
        assert model.encode(text) == library(text)[0]
    rng = random.Random(4)
    for n in (1, 2, 63, 64, 65, 66, 500, 5000):
        word = "".join(rng.choice("aeinrstth") for _ in range(n))
        assert model.scan(model.symbols(word)) == model.heap(model.symbols(word)) == library(word)[0]


def test_op7_digests(spark):
    rows = {r.doc_id: r for r in op7_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect():
        ids, text = library(r.text)
        assert rows[r.doc_id].n_tokens == len(ids)
        assert rows[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def brute_targets(sizes):
    """The rule as words: deal by weight, stop at twice the source, deal the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    target, capped, left = dict.fromkeys(names, 0.0), set(), 1.5 * sum(sizes.values())
    while left > 1e-9 and len(capped) < len(names):
        open_ = [s for s in names if s not in capped]
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in open_:
            target[s] += share * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                capped.add(s)
    return target


@pytest.mark.parametrize("name", ["hand", "docs", "none"])
def test_mixing(request, name):
    df = request.getfixturevalue(name)
    got = mixing.mix(df).collect()
    inputs = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in df.select("doc_id", "source", "text").collect()]
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter(inputs)
    sizes = Counter()
    for _, s, n in inputs:
        sizes[s] += n
    targets = brute_targets(sizes)
    taken, units = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        units[r.source] = max(units[r.source], r["size"])
    for s in sizes:  # never further off than half of the largest document
        assert abs(taken[s] - targets[s]) <= units[s] / 2 + 1e-6
    assert Counter(map(tuple, mixing.mix(df.repartition(5)).collect())) == Counter(map(tuple, got))


def test_mixed_rows_repeat_documents(docs):
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == Counter({i: c for i, c in copies.items() if c})


def test_mixing_spreads_hot_ids_and_equal_rows(spark):
    """A source under one id, half of it one and the same row, or under no id, still comes near its target; so do its rows."""
    rng = random.Random(4)
    rows = [(i, "a", " ".join(words(rng, 20))) for i in range(900)]
    rows += [(7, "b", " ".join(words(rng, 20)) if i % 2 else "the same text again " * 5) for i in range(900)]
    rows += [(None, "c", " ".join(words(rng, 20))) for _ in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("hash", F.lit(1)).repartition(6)
    got = mixing.mix(df).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(got) == 2700 and all(abs(taken[s] - target[s]) <= 10 for s in target)
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    assert Counter((r.doc_id, r.source) for r in out.collect()) == Counter({k: n for k, n in ((k, sum(r.copies for r in got if (r.doc_id, r.source) == k))
                                                                                             for k in {(r.doc_id, r.source) for r in got}) if n})


def test_mixes_are_nested(docs):
    small = {r.doc_id: r.copies for r in mixing.mix(docs, share=0.6).collect()}
    large = {r.doc_id: r.copies for r in mixing.mix(docs, share=0.9).collect()}
    assert all(small[i] <= large[i] for i in small)
    assert mixing.mix(docs.withColumn("source", F.lit("only")), share=0.5).agg(F.sum("taken") / F.sum("size")).first()[0] == pytest.approx(0.5, abs=0.1)


def thue_morse(n):
    """Two words of n bytes that a polynomial modulo 2^64 can't tell apart, whatever its multiplier."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_made_to_collide_stay_apart(spark):
    one, two = thue_morse(2048)
    pairs = spark.createDataFrame([(1, f"x {one}"), (2, f"x {two}"), (3, f"X {one.upper()}"), (4, f"x {one} y")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(pairs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    windows = spark.createDataFrame([(1, " ".join([one] + ["w"] * 34)), (2, " ".join([two] + ["w"] * 34)), (3, " ".join([one] + ["w"] * 34))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(windows).collect()} == {1: 35, 2: 0, 3: 35}


def test_components_need_one_row_a_set():
    """A group of sets that hang together without the block's first set sends one row each, not one per link."""
    import numpy as np
    import pyarrow as pa

    values = np.arange(1, 60, dtype=np.uint64)
    rows = [{"block": 0, "chunk": 0, "side": 0, "cls": i, "n": 58, "values": (np.delete(values, i % 59) if i else np.arange(100, 158, dtype=np.uint64)).tobytes()} for i in range(40)]
    out = pa.Table.from_batches(jaccard_join.chunk_links([pa.RecordBatch.from_pylist(rows)])).to_pylist()
    assert len(out) == 39 and all(r["pending"] for r in out) and len({r["v"] for r in out}) == 1
