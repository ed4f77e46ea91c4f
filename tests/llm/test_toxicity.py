import zlib

import numpy as np
import pytest

from coldsplit.llm import toxicity as T

from .helpers import edge_docs, edge_rows, empty_docs


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in T.op7_query(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    return rows, labels


def test_held_out_accuracy(scored):
    rows, labels = scored
    own = [(labels[i], r["score"]) for i, r in rows.items() if r["held_out"] and i in labels]
    y, s = np.array([a for a, _ in own]), np.array([b for _, b in own])
    assert auc(y, s) > 0.92
    assert ((s >= 0.7) == y).mean() > 0.94


def test_columns(scored):
    rows, _ = scored
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(1)
    calm = ["garden", "river", "window", "morning", "yellow", "table", "paper", "winter"]
    texts, y = [], []
    for k in range(240):
        w = list(rng.choice(calm, 20))
        if k % 2:
            w[3] = w[11] = "scoundrel"
        texts.append(" ".join(w))
        y.append(k % 2)
    return T.train(texts, np.array(y), 0.5, bits=10, epochs=30)


def test_misspellings_share_vectors(small):
    w, b = small
    calm = T.score_text("the river in the morning", w, b, 10)
    assert T.score_text("you scoundrell", w, b, 10) > 0.7 > calm
    assert T.score_text("such sc0undrels", w, b, 10) > calm


def test_slices_add_up(small, monkeypatch):
    text = " ".join(f"word{i} scoundrel" for i in range(200))
    whole = T.bag(text, 10)
    monkeypatch.setattr(T, "SLICE", 37)
    assert (T.bag(text, 10) == whole).all()


def test_edge_cases(spark, small):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = T.fit(docs, labels, epochs=2)
    out = docs.select("doc_id", "text", T.score(docs, model).alias("score")).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if not (r["text"] or "").strip()}) == 1
    assert T.fit(docs, labels.filter("toxic = 1")) is None
    assert {r[0] for r in docs.select(T.score(docs, None)).collect()} == {0.0}
    assert empty_docs(spark).select(T.score(docs, model)).count() == 0


def plain_bag(text, bits):
    """Letter by letter: a dict of bucket counts."""
    flat = b" " + b" ".join(text.lower().encode().split()) + b" "
    out = {}
    for n in T.GRAMS if len(flat) > 2 else ():
        for i in range(len(flat) - n + 1):
            gram = flat[i : i + n]
            if 32 in gram[1:-1]:
                continue
            h = 0
            for c in gram:
                h = (h * 0x100000001B3 + c + 1) % 2**64
            b = ((h ^ h >> 31) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - bits)
            out[b] = out.get(b, 0) + 1
    return out


def test_bag_and_score_against_plain_python(monkeypatch):
    rng = np.random.default_rng(3)
    weights = rng.normal(0, 1, 1 << 9)
    for size in (1 << 20, 7, 1):
        monkeypatch.setattr(T, "SLICE", size)
        for text in ["", " ", "a", "Ab", "you IDIOT", "naïve 世界 😀 x", "one two  three\nfour" * 5, None]:
            want = plain_bag(text or "", 9)
            got = T.bag(text, 9)
            assert {int(i): int(got[i]) for i in got.nonzero()[0]} == want
            n = sum(want.values())
            mean = sum(weights[b] * c for b, c in want.items()) / n if n else 0.0
            assert abs(T.score_text(text, weights, 0.25, 9) - 1 / (1 + np.exp(-mean - 0.25))) < 1e-12


def test_training_steps_follow_the_numeric_gradient():
    """A few steps of Adam on gradients of finite differences give the same model."""
    bits, dim, epochs, rate, decay, seed = 3, 2, 4, 0.05, 1e-2, 5
    texts, y = ["you idiot", "good day", "idiots all", "a fine day", "stupid idiot", "kind words"], np.array([1, 0, 1, 0, 1, 0])
    x = np.array([T.features(t, bits) for t in texts], np.float64)
    rng = np.random.default_rng(seed)
    shapes = [(1 << bits, dim), (dim, 2), (2,)]
    p = np.concatenate([rng.normal(0, 0.1, shapes[0]).ravel(), rng.normal(0, 0.5, shapes[1]).ravel(), np.zeros(2)])

    def parts(p):
        a, b = (1 << bits) * dim, (1 << bits) * dim + 2 * dim
        return p[:a].reshape(shapes[0]), p[a:b].reshape(shapes[1]), p[b:]

    def loss(p):
        e, w, b = parts(p)
        z = x @ e @ w + b
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]) + decay / 2 * (e**2).sum() + 1e-4 / 2 * (w**2).sum())

    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, epochs + 1):
        d = np.array([(loss(p + h) - loss(p - h)) / 2e-5 for h in 1e-5 * np.eye(len(p))])
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    e, w, b = parts(p)
    weights, bias = T.train(texts, y, 0.5, bits=bits, dim=dim, epochs=epochs, rate=rate, decay=decay, seed=seed)
    np.testing.assert_allclose(weights, e @ (w[:, 1] - w[:, 0]) * np.sqrt(1 << bits), atol=2e-2)
    assert abs(bias - (b[1] - b[0])) < 2e-2


def test_long_texts_are_learned_from(spark):
    """Only texts of 400,000 characters, sent as features, teach the two classes; the
    model equals that of their texts."""
    docs = [(i, ("vile rotten scum " if i % 2 else "lovely calm garden ") * 22_000) for i in range(24)]
    docs += [(i, "rotten scum" if i % 2 else "calm garden") for i in range(24, 30)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = T.fit(frame, labels, bits=10, epochs=40)
    known = [d for d in docs[:24] if zlib.crc32(str(d[0]).encode()) % 3 != 1]
    same = T.train([t for _, t in known], np.array([i % 2 for i, _ in known]), sum(i % 2 for i, _ in known) / len(known), bits=10, epochs=40)
    np.testing.assert_array_equal(model[0], same[0])
    assert model[1] == same[1]
    for i, t in docs[24:]:
        assert (T.score_text(t, *model, 10) > 0.5) == (i % 2 == 1)
