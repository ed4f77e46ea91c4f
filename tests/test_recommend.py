"""Rankings of all items: by node lists for routed users, by pruned search for factors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coldsplit.operators import recommend as R
from coldsplit.operators.route import node_rankings, predict_all_items


def brute(q, c, n):
    out = []
    for i, u in q:
        best = sorted((-float(np.dot(u, v)), j) for j, v in c)[:n]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("group_bytes", [R.GROUP_BYTES, 3000, 1])
def test_pruned_search_is_exact(spark, monkeypatch, group_bytes):
    """Groups of one range, of some rows, and of a row each; ties and equal norms."""
    monkeypatch.setattr(R, "BLOCK", 8)
    rng = np.random.default_rng(4)
    n = 40 if group_bytes == 1 else 300
    c = [(j, (rng.integers(-3, 4, 5) * (1.0 + 40 // (1 + j % 50))).tolist()) for j in range(n)]
    q = [(i, (1.0 * rng.integers(-4, 5, 5)).tolist()) for i in range(30)] + [(99, [0.0] * 5)]
    qs = spark.createDataFrame([*q, (None, [1.0] * 5), (7777, None)], "user_id int, features array<float>").repartition(3)
    cs = spark.createDataFrame([*c, (None, [1.0] * 5), (8888, None)], "item_id int, features array<float>").repartition(3)
    found, work = R.search_products(qs, cs, 4, group_bytes)
    assert sorted((r["user_id"], r["rank"], r["item_id"], r["score"]) for r in found.collect()) == brute(q, c, 4)
    assert found.columns == ["user_id", "rank", "item_id", "score"] and dict(found.dtypes)["item_id"] == "int"
    scored = {r["user_id"]: r["n_scored"] for r in work.collect()}
    assert scored[99] == n  # a zero vector rules nothing out
    assert sum(scored.values()) < 0.7 * n * len(q)


def test_equal_norms_are_sent_in_parts(spark):
    c = [(j, [float((j >> b) % 2 * 2 - 1) for b in range(6)]) for j in range(64)]
    q = [(i, [float(i % 3), 1.0, -2.0, float(i), 0.5, -1.0]) for i in range(9)]
    qs, cs = spark.createDataFrame(q, "user_id int, features array<double>"), spark.createDataFrame(c, "item_id int, features array<double>")
    got = R.top_products(qs, cs, 3, group_bytes=10 * 8 * 8)
    assert sorted(tuple(r) for r in got.collect()) == brute(q, c, 3)


def test_few_candidates_and_empty_sides(spark):
    qs = spark.createDataFrame([(1, [1.0, 0.0])], "user_id int, features array<double>")
    cs = spark.createDataFrame([(5, [0.5, 1.0]), (4, [0.5, -1.0])], "item_id long, features array<double>")
    assert [tuple(r) for r in R.top_products(qs, cs, 10).orderBy("rank").collect()] == [(1, 1, 4, 0.5), (1, 2, 5, 0.5)]
    assert R.top_products(qs.limit(0), cs).count() == 0 and R.top_products(qs, cs.limit(0)).count() == 0


def _als(spark):
    rng = np.random.default_rng(1)
    rows = [(u, i, float(1 + (u * i + u) % 5)) for u in range(60) for i in range(200) if rng.random() < 0.9 / (1 + i / 10)]
    df = spark.createDataFrame(rows, "user_id int, item_id int, rating double")
    return R.als_baseline(df, max_iter=3)[0]


def test_recommendations_equal_all_pairs(spark):
    model = _als(spark)
    got = R.recommend_items(model, 5)
    want = model.recommendForAllUsers(5).select("user_id", F.posexplode("recommendations").alias("r", "x"))
    scores = {(r["user_id"], r["r"] + 1): r["x"]["rating"] for r in want.collect()}
    rows = got.collect()
    assert len(rows) == len(scores) and all(abs(scores[r["user_id"], r["rank"]] - r["score"]) < 1e-4 for r in rows)
    some = R.recommend_users(model, 3, got.filter("user_id < 2"))
    assert some.groupBy("item_id").count().filter("count <> 3").count() == 0 and some.count() > 0


@pytest.mark.parametrize("node_bytes", [1 << 20, 400])
def test_node_lists_equal_scores_of_every_user(spark, node_bytes):
    """One node holds a third of the users; an item without factors at a level is
    scored with the ancestor's vector."""
    rng = np.random.default_rng(2)
    nodes = {(lv, nd): (1.0 * rng.integers(-5, 6, 3)).tolist() for lv in range(3) for nd in range(3**lv)}
    items = {(lv, i): (1.0 * rng.integers(-5, 6, 3)).tolist() for lv in range(3) for i in range(40) if lv == 0 or (i + lv) % 5}
    users = [(u, 2, 4, [(i % 40, "LDU"[i % 3]) for i in range(u % 7)]) for u in range(60)]
    users += [(100 + u, u % 3, u % 3**(u % 3), [(u % 40, "D")] if u % 3 else []) for u in range(90)]
    routed = spark.createDataFrame(users, "user_id int, level int, node int, asked array<struct<item_id:int,attitude:string>>").repartition(4)
    nf = spark.createDataFrame([(*k, v) for k, v in nodes.items()], "level int, node int, features array<float>")
    itf = spark.createDataFrame([(*k, v) for k, v in items.items()], "level int, item_id int, features array<float>")
    got = sorted(tuple(r) for r in predict_all_items(routed, nf, itf, 6, 3, node_bytes).collect())
    want = []
    for u, level, node, asked in users:
        scored = []
        for i in range(40):
            at = max(lv for lv in range(level + 1) if (lv, i) in items)
            scored.append((-float(np.dot(nodes[at, node // 3 ** (level - at)], items[at, i])), i))
        out = {i for i, a in asked if a != "U"}
        want += [(u, r + 1, i, -s) for r, (s, i) in enumerate([x for x in sorted(scored) if x[1] not in out][:6])]
    assert got == sorted(want)
    lists = node_rankings(routed, nf, itf, 8, 3, node_bytes).collect()
    assert len(lists) == len({(u[1], u[2]) for u in users}) and all(len(r["ranking"]) == 8 for r in lists)


def test_few_pairs_are_scored_and_few_queries_make_many_tasks(spark):
    """Random directions, where norms rule nothing out; queries in one small file."""
    rng = np.random.default_rng(6)
    c = [(j, np.round(rng.normal(size=24) * 100).tolist()) for j in range(3000)]
    q = [(i, np.round(rng.normal(size=24) * 100).tolist()) for i in range(60)]
    qs, cs = spark.createDataFrame(q, "user_id int, features array<float>").coalesce(1), spark.createDataFrame(c, "item_id int, features array<float>")
    found, work = R.search_products(qs, cs, 5)
    assert sorted(tuple(r) for r in found.collect()) == brute(q, c, 5)
    assert sum(r["n_scored"] for r in work.collect()) < 0.1 * len(q) * len(c)
    cores = spark.sparkContext.defaultParallelism
    assert R._task_count(spark, 60_000, 100_000) == max(2 * cores, 1) and R._task_count(spark, 3, 10**6) == 3
    assert R._task_count(spark, 5_000_000, 100_000) >= 5_000_000 * 100_000 // R.TASK_PAIRS


def test_equal_candidates_and_vectors_of_unlike_length():
    """Many equal scores and tiny, huge and zero vectors: the block search keeps ties to the smaller id."""
    rng = np.random.default_rng(7)
    v = np.concatenate([np.repeat(rng.integers(-3, 4, (1, 4)), 9000, axis=0), rng.integers(-3, 4, (500, 4)) * 1e-30, np.zeros((50, 4)), rng.integers(-3, 4, (500, 4)) * 1e15])
    c = rng.permutation(len(v)).astype(np.int64)
    norm = np.sqrt((v * v).sum(axis=1))
    order = np.lexsort((c, -norm))
    u = np.concatenate([rng.integers(-3, 4, (20, 4)), np.zeros((1, 4)), rng.integers(-3, 4, (9, 4)) * 1e-20])
    ids, best, scored = np.full((len(u), 3), R.NONE, np.int64), np.full((len(u), 3), -np.inf), np.zeros(len(u), np.int64)
    R._best_of(u, c[order], v[order], norm[order], ids, best, scored)
    for row, x in enumerate(u):
        s = np.einsum("j,ij->i", x, v)
        want = np.lexsort((c, -s))[:3]
        assert ids[row].tolist() == c[want].tolist() and best[row].tolist() == s[want].tolist()
