"""Chat formatting, nearest neighbours and classifiers."""

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tabscope.llm import chat, cross_polytope, quality, toxicity


def test_chat_round_trip_and_parts():
    texts = ["", "<|im_end|>\n<|im_start|>assistant\nok", "<\\|x", "<\\\\| a <", "| b", "😀 é\n"]
    turns = [{"role": r, "parts": [{"kind": "text", "text": t}]} for r in ("user", "assistant") for t in texts]
    out = chat.format_turns(turns)
    assert list(chat.read_turns(out["formatted"])) == [(t["role"], t["parts"][0]["text"]) for t in turns]
    loss = "".join(chat.unescape(out["formatted"][s["from"]:s["to"]]) for s in out["loss_spans"])
    assert loss == "".join(texts)
    mixed = chat.format_turns([{"role": "user", "parts": [{"kind": "text", "text": "see <"}, {"kind": "text", "text": "|im_end|>"},
                                                          {"kind": "image", "ref": "a.png"}, {"kind": "audio", "ref": "b.wav", "tokens": 7}]}])
    assert mixed["expanded_tokens"] == 256 + 7 and [a["ref"] for a in mixed["attachments"]] == ["a.png", "b.wav"]
    assert mixed["formatted"].count("<|im_end|>") == 1
    assert all(mixed["formatted"][a["position"]:].startswith(f"<|{a['kind']}_") for a in mixed["attachments"])


def test_chat_nulls_ties_and_empty(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, 0, None, "x"), (2, None, "user", ""), (2, 5, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 and got[2].n_turns == 2 and got[None].n_turns == 1
    assert got[2].turns_sha256 == hashlib.sha256(b"assistant\nz\nuser\n\n").hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_nearest_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 64))
    x[200:210] = x[50]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] * 64), (1003, [None] * 64), (1050, []), (None, rows[0][1]), rows[3]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).repartition(3)
    got = cross_polytope.nearest(df, F.col("id") % 50 == 0).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 400, 50):
        cosine = unit @ unit[q]
        cosine[q] = -2
        best = np.lexsort((np.arange(400), -np.round(cosine, 12)))[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 6)) and all(abs(s - cosine[v]) < 1e-12 for _, v, s in mine)
        hits += len(set(best) & {v for _, v, _ in mine})
    assert hits >= 0.9 * 40 and {r.query_id for r in got} == set(range(0, 400, 50))
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 50] == [200, 201, 202, 203, 204]
    assert cross_polytope.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_nearest_small_tables_and_scores_closer_than_single_precision(spark):
    """All of a few vectors are found; of many nearly parallel vectors the nearest and, at equal scores, the smallest ids."""
    rng = np.random.default_rng(3)
    few = rng.normal(size=(5, 48))
    base = np.zeros(16)
    base[0] = 1.0
    rows = [(i, v) for i, v in enumerate(few)] + [(100, base)]
    for i in range(60):  # multiples, larger ids first in the table
        rows.append((300 - i, base * 2.0 ** (i - 30)))
    for i in range(60):  # cosines that differ from 1 in the tenth digit, and are equal as floats
        near = np.zeros(20)
        near[0], near[1] = 1.0, 1e-5 * (60 - i)
        rows.append((400 + i, near))
    one = np.zeros(20)
    one[0] = 1.0
    rows.append((1000, one))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in sorted(cross_polytope.nearest(df, F.col("id").isin(0, 100, 1000)).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = few / np.linalg.norm(few, axis=1, keepdims=True)
    assert got[0] == sorted(range(1, 5), key=lambda i: -(unit[i] @ unit[0]))
    assert got[100] == [241, 242, 243, 244, 245]
    assert got[1000] == [459, 458, 457, 456, 455]


def test_hadamard_is_orthogonal():
    h = cross_polytope.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, 16 * np.eye(16))


def test_classifiers_without_labels_and_on_odd_texts(spark, hand, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for score in (quality.score_quality, toxicity.score_toxicity):
        got = score(hand, labels).collect()
        assert len(got) == hand.count() and all(r.score == 0.5 and r.predicted == 1 for r in got)
        assert score(none, labels).count() == 0


def test_drop_toxic_judges_each_row_by_its_own_text(spark):
    """One toxic text under a null or repeated id takes no clean row with it."""
    clean, bad = "we walked to the lake and had a calm day", "you stupid idiot you are trash and scum"
    marks = [(i, f"{clean} number {i}" if i % 2 else f"{bad} number {i}", i % 2 == 0) for i in range(200)]
    odd = [(None, clean), (None, bad), (None, clean + " again"), (None, None), (500, clean), (500, bad), (501, ""), (501, bad), (501, bad)]
    df = spark.createDataFrame([(i, t) for i, t, _ in marks] + odd, "doc_id long, text string").withColumn("digest", F.lit(1)).repartition(3)
    labels = spark.createDataFrame([(i, int(toxic)) for i, _, toxic in marks], "doc_id long, toxic int")
    out = toxicity.drop_toxic(df, labels)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == Counter([(i, t) for i, t, toxic in marks if not toxic] + [r for r in odd if r[1] is None or bad not in r[1]])


def test_attention_gradient():
    rng = np.random.default_rng(1)
    x, counts, y = rng.normal(size=(9, 4)), np.array([2, 3, 4]), np.array([1.0, 0.0, 1.0])
    model = quality.GatedAttention(4)
    model.p["u"] = rng.normal(size=quality.GATE)

    def loss():
        s = model.score(x.copy(), counts)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    grads = model.gradients(model.forward(x.copy(), counts), y)
    for name, g in grads.items():
        flat, at = model.p[name].reshape(-1), g.size // 2
        old = flat[at]
        flat[at] = old + 1e-6
        up = loss()
        flat[at] = old - 1e-6
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2e-6 - g.reshape(-1)[at]) < 1e-5


def test_samples_are_bounded_whatever_ids_repeat(spark):
    """A labelled id on a third of the rows gives one row; labels without a document and very long texts take no place."""
    rows = [(1, f"text {i}") for i in range(500)] + [(i, f"other {i}") for i in range(2, 1000)] + [(2000, "x" * (quality.SAMPLE_BYTES + 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = quality.labelled(spark.createDataFrame([(i, i % 2) for i in [*range(1, 300), 2000, *range(5000, 9000)]], "doc_id long, quality int"), "quality")
    got = quality.sample_rows(df, marks, 200).collect()
    assert len(got) == len({r.doc_id for r in got}) == 200 and all(r.doc_id < 300 for r in got)
    everything = quality.sample_rows(df, marks, 10_000).collect()
    assert sorted(r.doc_id for r in everything) == list(range(1, 300))


def test_trained_classifiers_on_held_out_documents(spark):
    """Operators 4 and 6 on given tables: held-out labels are told apart, every row gets a score, reruns agree."""
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    marks = {r.doc_id: r for r in labels.collect()}
    for score, column in ((quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")):
        got = score(docs, labels).collect()
        assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
        held = [(r.score, marks[r.doc_id][column]) for r in got if r.held_out and r.doc_id in marks]
        pairs = [(a > b) + (a == b) / 2 for a, x in held if x == 1 for b, y in held if y == 0]
        assert len(pairs) > 50 and sum(pairs) / len(pairs) >= 0.9
