import numpy as np
import pytest

from coldsplit.llm import topk_nra as T

from .helpers import same_as_sql


def brute(ids, x, qids, q, k):
    out = []
    for i in range(len(q)):
        scores = x @ q[i]
        order = [c for c in np.lexsort((ids, -scores)) if ids[c] != qids[i]][:k]
        out += [(i, int(ids[c]), int(scores[c])) for c in order]
    return sorted(out)


def test_query_matches_sql(spark, sf_small):
    same_as_sql(T.op2_query(spark, sf_small), T.OP2_SQL, sf_small)


@pytest.mark.parametrize(("n", "d", "big"), [(3, 4, 5), (500, 2, 3), (900, 8, 100), (700, 64, 60), (300, 3, 2**40)])
def test_block_is_exact(n, d, big):
    rng = np.random.default_rng(n)
    x = rng.integers(-big, big, (n, d))
    x[n // 2 :: 3] = x[0]  # many ties
    ids = rng.permutation(n).astype(np.int64)
    q = np.concatenate([x[:5], rng.integers(-3, 3, (4, d))])
    qids = np.concatenate([ids[:5], [-1, -2, -3, -4]]).astype(np.int64)
    if big > 2**30:
        q = np.sign(q) * 3
    got = sorted((i, int(ids[c]), s) for i, c, s in T.nra_block(ids, x, qids, q, 5))
    assert got == brute(ids, x, qids, q, 5)


def test_reads_stop_early_on_skewed_lists():
    """A few heavy candidates: the first round's bounds leave few survivors."""
    x = np.abs(np.random.default_rng(1).integers(0, 5, (2000, 3)))
    x[:5] += 1000
    ids, q = np.arange(2000), np.array([[1, 2, 3]])
    got = T.nra_block(ids, x, np.array([-1]), q, 5)
    assert {c for _, c, _ in got} == set(range(5))


def test_bounds_decide_on_the_given_vectors(spark, sf_small):
    """Most queries stop before the lists end, with few survivors to resolve."""
    rows = spark.read.parquet(f"{sf_small}/../sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.floor(256 * np.array([r["embedding"] for r in rows], dtype=float)).astype(np.int64)
    asked = np.flatnonzero(ids % 50 == 0)
    stops: dict = {}
    got = sorted((i, int(ids[c]), s) for i, c, s in T.nra_block(ids, x, ids[asked], x[asked], 5, stops))
    assert got == brute(ids, x, ids[asked], x[asked], 5)
    early = [n for share, n in stops.values() if share < 1]
    assert len(stops) == len(asked) and len(early) > 0.9 * len(asked) and max(early) <= max(40, len(ids) // 32)


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 4)
    monkeypatch.setattr(T, "QUERY_BLOCK", 2)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (50, [0.5, -1.0]), (1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 0.0]),
            (6, [1.0]), (7, []), (None, [1.0, 1.0]), (8, [-1.0, -2.0]), (8, [-1.0, -2.0]), (100, [3.0]), (150, None), (9, [0.001, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rank int, score int").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in T.top_k(df.filter("vec_id % 50 = 0"), df, k=3).collect())
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, q in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        c = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))[:3]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(c)]
    assert got == sorted(want)
    assert T.top_k(df.limit(0), df).count() == 0 and T.top_k(df, df.limit(0)).count() == 0
