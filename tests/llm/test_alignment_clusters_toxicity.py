"""Operators 11 to 13 against plain versions and on awkward rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import differs

from riskloom.llm import alignment, clusters, toxicity

SF = "/root/testdata/sf0.001"
ODD = ["a ▁b", "x  y", "  two  spaces ", "\n\nlead", "a\tb \r\n c", "<|endoftext|> <s> </s> <unk> <0x41>", "é ü 中文 字 🙂 x", "nul\0l x", "a b", "　全角 空白", "'s 's it's don't", "1 22 333",
       "x" * 5000 + " " + "y " * 300, "\x1c x \x1f y", "﻿ bom", " ", "a", "tab\t", "", None, "same same", "same same", "z" * 100_000]


@pytest.fixture(scope="module")
def codec():
    return alignment.Codec(alignment._read(alignment.A_FILE), alignment._read(alignment.B_FILE))


def plain_groups(c, t):
    """Groups by merging the end offsets of whole-text encodings."""
    raw = (" " + (t or "")).encode()
    a = c.a.encode(" " + t, add_special_tokens=False).ids if t else []
    b = c.b.encode(t) if t else []
    if not t or b"".join(c.a_bytes[i] for i in a) != raw or b"".join(c.b_bytes[i] for i in b) != raw:
        return []
    ends_a, ends_b = (np.cumsum([len(k[i]) for i in x]).tolist() for k, x in ((c.a_bytes, a), (c.b_bytes, b)))
    out, x, y = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        i, j = ends_a.index(cut, x) + 1, ends_b.index(cut, y) + 1
        out.append((a[x:i], b[y:j]))
        x, y = i, j
    return out


def said(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def test_alignment_of_all_documents_against_whole_text_encodings(spark, codec):
    got = {r["doc_id"]: r for r in alignment.op11_tokenizer_alignment(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    groups = {i: plain_groups(codec, t) for i, t in texts.items()}
    count = Counter((a[-1], b[-1]) for g in groups.values() for a, b in g)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    assert got.keys() == texts.keys() and len(count) <= codec.most_pairs()
    for i, g in groups.items():
        links = [count[a[-1], b[-1]] for a, b in g]
        want = (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(n == most[b[-1]] for n, (_, b) in zip(links, g)), sum(links), hashlib.sha256(said(g).encode()).hexdigest() if g else "")
        assert tuple(got[i][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) == want


def test_alignment_of_awkward_texts(spark, codec):
    rows = spark.createDataFrame([(k if k % 4 else None, t, "clash", 1) for k, t in enumerate(ODD)], "doc_id long, text string, id string, n_a int")
    got = alignment.align(rows, outputs=("n_a", "n_b", "n_groups", "groups", "groups_sha256", "cuts")).collect()
    assert len(got) == len(ODD)
    by = Counter((r["id"], r["groups"]) for r in got)
    assert by == Counter((k if k % 4 else None, said(plain_groups(codec, t))) for k, t in enumerate(ODD))
    for r in got:
        assert (r["n_groups"] == 0) == (r["groups_sha256"] == "") and len(r["cuts"]) == r["n_groups"]
    lost = next(r for r in got if r["id"] is None and r["groups"] == "" and r["n_a"] == 0)
    assert lost["n_b"] == 0
    counted = alignment.align(rows, outputs=("pairs", "times"))
    assert alignment.agreement(counted.selectExpr("1 AS id", "pairs", "times"), alignment.pair_counts(counted), ["id"]).count() == len(ODD)


def test_alignment_of_random_texts(codec):
    r = random.Random(3)
    pool = ["a", "The", "foo.bar", "é", " ", "  ", "\n", "\t", "中", "🙂", "12", "don't", " ", "▁", "-", "'", "　", "Ａ", "x" * 40]
    known = alignment.Aligned(codec)
    texts = ["".join(r.choice(pool) + (" " if r.random() < 0.5 else "") for _ in range(r.randint(1, 60))) for _ in range(800)]
    for t, at in zip(texts, known.rows(texts)):
        assert (";".join(known.names[i] for i in at) if at is not None else "") == said(plain_groups(codec, t)), repr(t)


def test_owners():
    a, b, x, y = alignment.owners(np.array([2, 1, 3]), np.array([1, 2, 1, 2]))
    assert list(zip(a, b)) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3)] and list(zip(x, y)) == [(1, 1), (2, 3)]


def test_alignment_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    aligned = alignment.align(none, outputs=("n_a", "pairs", "times"))
    assert alignment.agreement(aligned, alignment.pair_counts(aligned), ["id", "n_a"]).count() == 0


def plain_clusters(x, centres, rounds):
    """Every vector against every centroid."""
    def nearest(c):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        own, _ = nearest(centres)
        centres = np.array([np.floor_divide(x[own == j].sum(0), (own == j).sum()) if (own == j).any() else centres[j] for j in range(len(centres))])
    return *nearest(centres), centres


@pytest.mark.parametrize("spread", [2, 40])
def test_balls_find_what_plain_rounds_find_with_fewer_distances(spark, spread):
    r = np.random.Generator(np.random.PCG64(spread))
    means = r.normal(0, 30, (16, 8))
    v = np.concatenate([means[r.integers(0, 16, 3000)] + r.normal(0, spread / 8, (3000, 8)), np.repeat(means[:1], 1000, 0)])  # a third alike
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    history = []
    members, centres, found = clusters.cluster(rows, k=16, rounds=4, size=8, scale=4, history=history)
    x = np.floor(v * 4).astype(np.int64)
    first = sorted(range(len(v)), key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:16]
    own, far, want = plain_clusters(x, x[first], 4)
    got = {m["vec_id"]: (m["cluster"], m["distance"]) for m in members.collect()}
    assert [got[i] for i in range(len(v))] == list(zip(own.tolist(), far.tolist())) and (centres == want).all()
    assert found["inertia"].sum() == far.sum() and history[0][1] == 16 * len(v)
    assert sum(n for _, n in history[1:]) < (0.5 if spread == 2 else 1.01) * sum(16 * n for n, _ in history[1:])


def test_clusters_of_awkward_vectors(spark):
    good = [(i, [float((i * 7 + j) % 5) for j in range(64)]) for i in range(9)]
    nan, inf = float("nan"), float("inf")
    bad = [(20, None), (21, []), (22, [1.0] * 63), (23, [1.0] * 65), (24, [None] + [1.0] * 63), (25, [nan] + [1.0] * 63), (26, [inf] + [1.0] * 63), (27, [-inf] + [1.0] * 63)]
    rows = spark.createDataFrame([(i, v, 7) for i, v in good + bad + [good[0], (None, good[1][1]), (30, [1e300] + [0.0] * 63)]], "vec_id long, embedding array<double>, cluster int")
    members, centres, found = clusters.cluster(rows)
    got = members.collect()
    assert Counter(m["vec_id"] for m in got) == Counter([*range(9), 0, None, 30]) and len(centres) == 12  # fewer vectors than k
    assert len({(m["cluster"], m["distance"]) for m in got if m["vec_id"] == 0}) == 1 and all(m["distance"] >= 0 for m in got)
    assert clusters.cluster(rows.where("vec_id >= 20 AND vec_id < 30"))[0].count() == 0
    assert clusters.cluster(rows.limit(0))[0].columns == ["vec_id", "cluster", "distance"]


def test_clusters_match_their_sql(spark):
    assert not differs(clusters.op12_ball_clusters(spark, SF), clusters.ORACLE_SQL["op12_ball_clusters"], SF)


# --- 13


def plain_subwords(t):
    out = []
    for w in "".join(c if c.isalnum() or c in "@$*" or ord(c) >= 0xFFFF else " " for c in t.lower()).split(" "):
        if w:
            out.append(("word", w))
            m = "<" + w + ">"
            out += [(k, m[i : i + k]) for k in (3, 4, 5) for i in range(len(m) - k + 1)]
    return Counter(out)


def test_subwords_against_plain_counts():
    texts = ["The idiot, the IDIOT's hat.", "", None, "ÉCOLE école x 🙂🙂a 1+1", "a", "b@d $h*t", "naïve " * 50]
    bucket, count, off = toxicity.bags(pa.array(texts))
    name = {}
    for k, t in enumerate(texts):
        want = plain_subwords(t or "")
        mine = dict(zip(bucket[off[k] : off[k + 1]].tolist(), count[off[k] : off[k + 1]].tolist()))
        assert sum(mine.values()) == sum(want.values()) and sorted(mine.values()) == sorted(want.values())
        name |= {b: name.get(b) for b in mine}
    one = lambda t: set(toxicity.bags(pa.array([t]))[0].tolist())
    assert one("école") == one("ÉCOLE") and len(one("idiot") & one("idiots")) >= 8 and not one("idiot") & one("wafer")


def test_long_texts_are_read_whole_in_pieces(monkeypatch):
    r = random.Random(5)
    long = " ".join("".join(r.choice("abcdefé") for _ in range(r.randint(1, 9))) for _ in range(4000))
    bag = toxicity.Bag(np.arange(1 << toxicity.BITS), np.random.Generator(np.random.PCG64(1)).normal(0, 1, (1 << toxicity.BITS, 2)), np.array([[0.0, 1], [1, 0]]), np.array([0.1, 0.2]))
    texts = pa.array(["x y", long, None, "z"])
    whole, bags = bag.score(texts), toxicity.bags(texts)
    monkeypatch.setattr(toxicity.text, "PIECE", 1000)
    assert np.allclose(bag.score(texts), whole) and all((a == b).all() for a, b in zip(toxicity.bags(texts), bags))
    assert np.isclose(whole[2], 1 / (1 + np.exp(-0.1)))


def test_gradients_of_the_log_loss_by_finite_differences():
    r = np.random.Generator(np.random.PCG64(2))
    theta = [r.normal(0, 1, (5, 3)), r.normal(0, 1, (3, 2)), r.normal(0, 1, 2)]
    at, share, off, y = np.array([0, 1, 1, 4, 2, 0]), r.random(6), np.array([0, 2, 2, 5, 6]), np.array([1, 0, 1, 0])
    _, *grads = toxicity.loss_and_gradient(*theta, at, share, off, y)
    for t, g in zip(theta, grads):
        for k in np.ndindex(t.shape):
            t[k] += 1e-5
            up = toxicity.loss_and_gradient(*theta, at, share, off, y)[0]
            t[k] -= 2e-5
            down = toxicity.loss_and_gradient(*theta, at, share, off, y)[0]
            t[k] += 1e-5
            assert abs((up - down) / 2e-5 - g[k]) < 1e-6


def test_misspelt_words_share_vectors(spark):
    r = random.Random(7)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    prose = lambda: [r.choice(words) for _ in range(r.randint(20, 200))]
    rows, marks = [], []
    for i in range(600):
        w, y = prose(), int(i % 6 == 0)
        for _ in range(y * max(1, len(w) // 40)):
            w.insert(r.randrange(len(w)), r.choice(["pathetic", "worthless", "scumbag"]))
        rows.append((i, " ".join(w)))
        marks.append((i, y))
    rows += [(1000, " ".join(prose()[:20] + ["pathetiic"])), (1001, " ".join(prose()[:20] + ["worthles", "w0rthless"])), (1002, " ".join(prose())), (1003, None), (1004, ""), (1005, "pathetic"), (1000, "path"), (None, "x")]
    docs = spark.createDataFrame([(i, t, 5.0) for i, t in rows], "doc_id long, text string, score double")
    bag = toxicity.learn(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    got = toxicity.score_toxicity(docs, bag).collect()
    by = {}
    for x in got:
        by.setdefault(x["doc_id"], []).append(x["score"])
    right = sum((by[i][0] >= 0.5) == y for i, y in marks)
    assert right >= 595 and len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got)
    assert by[1000][0] > 0.5 and by[1001][0] > 0.5 and by[1002][0] < 0.5 and by[1005][0] > 0.9 and by[1003] == by[1004]


def test_toxicity_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, "c")], "doc_id long, text string")
    for marks in ([], [(1, 1)], [(1, None), (2, 0), (None, 1)]):
        labels = spark.createDataFrame(marks, "doc_id long, toxic int")
        bag = toxicity.learn(docs, labels)
        assert bag is None and {r["score"] for r in toxicity.score_toxicity(docs, bag).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.limit(0), None).count() == 0


def test_toxicity_holds_on_rows_not_learnt_from(spark):
    got = toxicity.op13_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.toxic).mean() > 0.97 and held[held.toxic == 1].predicted.mean() > 0.9 and held[held.toxic == 0].predicted.mean() < 0.02
    assert len(got) == 10000
