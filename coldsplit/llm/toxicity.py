"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is a bag of hashed character n-grams (3 to 6 bytes of the lower-cased
text, words marked by a space on each side). Bucket vectors (embeddings) are
averaged over the bag and go into a two-class softmax; embeddings (with weight
decay) and softmax are trained jointly by Adam in numpy on the driver, on a
bounded sample of the labelled rows. A misspelling shares most n-grams with the
word it hides.

Scoring is linear before the softmax, so the model that goes to the executors
is one number per bucket (embedding times weight difference): 2**bits floats.
Whole texts are scored, in slices of bounded size whose sums add up.

Defined results: a null or empty text, or one without an n-gram, has an empty
bag and gets the softmax of the bias; repeated rows are scored each; rows
without label, or with a null doc_id, are scored and never learned from; with
no labels of both classes every score is 0.0; an empty table gives an empty result;
very long texts are learned from and scored whole; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldsplit.llm.common import table

GRAMS = (3, 4, 5, 6)
BITS = 15
SAMPLE = 3000  # labelled rows to learn from, half of each class where there are as many
SLICE = 1 << 20  # bytes of text hashed at once


def _slices(text: str):
    flat = b" " + b" ".join(text.lower().encode().split()) + b" "
    if len(flat) < 3:
        return
    step, most = SLICE, max(GRAMS)
    for a in range(0, len(flat), step):
        # n-grams that start in this slice; the overlap lets them end in the next
        yield np.frombuffer(flat[a : a + step + most - 1], np.uint8), min(step, len(flat) - a)


def _buckets(raw: np.ndarray, starts: int, bits: int):
    """Bucket numbers of the n-grams that start at the first ``starts`` bytes."""
    x = raw.astype(np.uint64)
    space = raw == 32
    h = np.zeros(len(x), np.uint64)
    inner = np.zeros(len(x), bool)  # a space that is neither first nor last
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            m = len(x) - n + 1
            if m <= 0:
                return
            h = h[:m] * np.uint64(0x100000001B3) + x[n - 1 :] + np.uint64(1)
            if n > 2:
                inner = inner[:m] | space[n - 2 : n - 2 + m]
            else:
                inner = inner[:m]
            if n in GRAMS:
                ok = ~inner[:starts]
                v = h[:starts][ok]
                yield ((v ^ (v >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def bag(text: str | None, bits: int = BITS) -> np.ndarray:
    out = np.zeros(1 << bits, np.int64)
    for raw, starts in _slices(text or ""):
        for b in _buckets(raw, starts, bits):
            out += np.bincount(b, minlength=1 << bits)
    return out


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """The averaged bag, scaled to suit its type."""
    counts = bag(text, bits)
    return (counts * (np.float32(np.sqrt(1 << bits)) / max(1, counts.sum()))).astype(np.float16)


def train(texts: list[str | bytes], labels: np.ndarray, prior: float, bits: int = BITS, dim: int = 8, epochs: int = 60, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Joint training on texts or the bytes of their ``features``; returns one weight per bucket and the bias, so that the
    class-1 probability is sigmoid(mean of the bag's weights + bias). ``prior``:
    share of class 1 among all labelled rows, which the sample may not have."""
    rng = np.random.default_rng(seed)
    scale = np.float32(np.sqrt(1 << bits))
    x = np.empty((len(texts), 1 << bits), np.float16)
    for k, text in enumerate(texts):
        x[k] = np.frombuffer(text, np.float16) if isinstance(text, bytes) else features(text, bits)
    y = np.asarray(labels, np.int64)
    p = [rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32), rng.normal(0, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), 256):
            rows = order[a : a + 256]
            xb = x[rows].astype(np.float32)
            hid = xb @ p[0]
            z = hid @ p[1] + p[2]
            z -= z.max(axis=1, keepdims=True)
            g = np.exp(z)
            g /= g.sum(axis=1, keepdims=True)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            grads = [xb.T @ (g @ p[1].T) + decay * p[0], hid.T @ g + 1e-4 * p[1], g.sum(axis=0)]
            t += 1
            for k, d in enumerate(grads):
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.001 * (d * d - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    diff = (p[1][:, 1] - p[1][:, 0]).astype(np.float64)
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    bias = float(p[2][1] - p[2][0]) + np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return p[0].astype(np.float64) @ diff * float(scale), float(bias)


def score_text(text: str | None, weights: np.ndarray, bias: float, bits: int = BITS) -> float:
    total, n = 0.0, 0
    for raw, starts in _slices(text or ""):
        for b in _buckets(raw, starts, bits):
            total += float(weights[b].sum())
            n += len(b)
    return float(1 / (1 + np.exp(-np.clip((total / n if n else 0.0) + bias, -500, 500))))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, bits: int = BITS, **parameters):
    """The model of ``train`` from at most ``sample`` labelled rows that are not held
    out, chosen by a hash of their id; None if a class has no row. Whole texts are
    learned from: one of more bytes than its features have is sent to the driver as
    these (2**bits halves), so the driver gets sample * 2**(bits + 1) bytes at most."""
    most = 2 << bits

    @F.pandas_udf("binary")
    def long_text(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t, bits).tobytes() if t is not None and len(t.encode()) > most else None for t in texts], dtype=object)

    known = labels.select(F.col(doc_id).alias("_id"), F.col("toxic").alias("_y")).filter("_y in (0, 1)").filter(~held_out("_id"))
    known = known.groupBy("_id").agg(F.max("_y").cast("int").alias("_y"))
    n = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    rows = []
    for y in (0, 1):
        take = known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample // 2)  # a documented bound
        got = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(take), "_id")
        got = got.groupBy("_id", "_y").agg(F.min("_t").alias("_t")).withColumn("_f", long_text("_t"))
        rows += got.select("_id", "_y", F.when(F.col("_f").isNull(), F.col("_t")).alias("_t"), "_f").collect()
    if len({r["_y"] for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: r["_id"])
    texts = [bytes(r["_f"]) if r["_f"] is not None else r["_t"] or "" for r in rows]
    return train(texts, np.array([r["_y"] for r in rows]), n[1] / (n[0] + n[1]), bits=bits, **parameters)


def score(docs: DataFrame, model, text: str = "text") -> Column:
    """A column with the probability of class 1."""
    if model is None:
        return F.lit(0.0)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        model = sent.value
        return pd.Series([score_text(t, *model) for t in texts], dtype="float64")

    return toxic(text)


THRESHOLD = 0.7


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = docs.select("doc_id", held_out().alias("held_out"), score(docs, fit(docs, labels)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
