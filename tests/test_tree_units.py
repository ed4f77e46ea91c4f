"""Hand-sized cases: ties, empty branches, half stars, zeros, duplicates,
stop rule, and the sparse split score against a dense brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coldsplit.operators import prepare
from coldsplit.operators.route import route_users
from coldsplit.operators.tree import build_tree, level_frames

SCHEMA = "user_id int, item_id int, rating double"


def dense_errors(rows, lam=7.0, k=200):
    """Brute force of the split error at the root, straight from the definition."""
    users = sorted({u for u, _, _ in rows})
    items = sorted({i for _, i, _ in rows})
    R = {(u, i): r for u, i, r in rows if r != 0}
    mu = np.mean(list(R.values()))
    bias = {}
    for u in users:
        rs = [r for (uu, _), r in R.items() if uu == u]
        bias[u] = (sum(rs) + lam * mu) / (lam + len(rs))
    out = {}
    for c in items:
        err = 0.0
        for i in items:
            groups = {0: [], 1: [], 2: []}
            for u in users:
                if (u, i) not in R:
                    continue
                e = R[(u, i)] - bias[u]
                a = R.get((u, c))
                g = 2 if a is None else (0 if a >= 4 else (1 if a <= 3 else 2))
                groups[g].append(e)
            for g in groups.values():
                s, s2, n = sum(g), sum(x * x for x in g), len(g)
                err += s2 - s * s / (n + 1e-9)
        out[c] = err
    return out


def test_sparse_score_equals_dense(spark, sf_small):
    from coldsplit.plans import fixtures as fx

    r = fx.ratings(spark, sf_small, "supp")
    rows = [tuple(x) for x in r.collect()]
    t = build_tree(r, depth=1, k=200)
    scored = {row.item_id: row.error for row in level_frames(t, 0)["scored"].collect()}
    dense = dense_errors(rows)
    assert set(scored) == set(dense)
    for c, e in scored.items():
        assert abs(e - dense[c]) < 1e-6 * max(1.0, abs(dense[c]))
    best = t.splits.filter("level = 0").first()
    assert abs(best.error - min(dense.values())) < 1e-6 * abs(min(dense.values()))


def test_levels_partition_users(spark, sf_small):
    from coldsplit.plans import fixtures as fx

    r = fx.ratings(spark, sf_small, "part")
    t = build_tree(r, depth=3, k=50)
    a = t.assignment
    n_users = r.select("user_id").distinct().count()
    assert a.filter("level = 0").count() == n_users
    # every child node's users are a subset of its parent's users
    kids = a.alias("c").join(
        a.alias("p"),
        (F.col("c.level") == F.col("p.level") + 1) & (F.col("c.user_id") == F.col("p.user_id")),
    )
    bad = kids.filter(F.floor(F.col("c.node") / 3) != F.col("p.node")).count()
    assert bad == 0
    # a level's nodes never hold more users than the level above
    sizes = {row.level: row.n for row in a.groupBy("level").agg(F.count("*").alias("n")).collect()}
    for lv in range(1, t.levels + 1):
        assert sizes[lv] <= sizes[lv - 1]
    # error never exceeds the node's base error
    sc = level_frames(t, 0)["scored"].collect()
    assert all(x.gain >= -1e-6 for x in sc)


def test_tie_breaks_by_popularity_then_item(spark):
    # items 1 and 2 split users identically -> equal error; 2 is more rated? no: equal
    rows = [
        (0, 1, 5.0), (0, 2, 5.0), (0, 3, 1.0),
        (1, 1, 1.0), (1, 2, 1.0), (1, 3, 5.0),
        (2, 3, 4.0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    t = build_tree(df, depth=1, k=10)
    s = t.splits.first()
    sc = {x.item_id: (round(x.gain, 6), x.popularity) for x in level_frames(t, 0)["scored"].collect()}
    assert sc[1] == sc[2]
    # item 3 has the most raters; among equals the smaller id wins
    best_gain = max(g for g, _ in sc.values())
    winners = sorted([i for i, (g, p) in sc.items() if g == best_gain], key=lambda i: (-sc[i][1], i))
    assert s.item_id == winners[0]


def test_half_star_is_unknown_and_zero_dropped(spark):
    rows = [(0, 1, 3.5), (0, 2, 4.0), (1, 1, 5.0), (1, 2, 2.0), (2, 1, 1.0), (2, 2, 0.0), (3, 2, 5.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    t = build_tree(df, depth=1, k=10)
    root_item = t.splits.first().item_id
    kids = {x.user_id: x.node for x in t.assignment.filter("level = 1").collect()}
    assert 2 in kids  # user 2 keeps its non-zero rating
    if root_item == 1:
        assert kids[0] == 2  # 3.5 is neither like nor dislike
    # the zero rating is not a rating: item 2 has 3 raters
    pop = {x.item_id: x.popularity for x in level_frames(t, 0)["cands"].collect()}
    assert pop[2] == 3


def test_stop_rule_when_path_holds_all_items(spark):
    rows = [(u, i, float(1 + (u + i) % 5)) for u in range(12) for i in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    t = build_tree(df, depth=5, k=10)
    # two items: at most two questions on any path
    assert t.levels <= 2
    assert t.splits.filter("level >= 2").count() == 0


def test_k_smaller_than_depth(spark, sf_small):
    from coldsplit.plans import fixtures as fx

    r = fx.ratings(spark, sf_small, "supp")
    t = build_tree(r, depth=3, k=1)
    # with one candidate per node, a child whose top item is its parent's
    # question is a leaf
    per_level = {x.level: x.n for x in t.splits.groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert per_level.get(0) == 1
    assert sum(per_level.values()) < 13


def test_route_training_users_match_assignment(spark, sf_small):
    from coldsplit.plans import fixtures as fx

    r = fx.ratings(spark, sf_small, "supp")
    t = build_tree(r, depth=3, k=200)
    routed = route_users(t, r)
    deepest = t.assignment.groupBy("user_id").agg(F.max("level").alias("level"))
    final = t.assignment.join(deepest, ["user_id", "level"])
    j = routed.join(final.withColumnRenamed("node", "a_node").withColumnRenamed("level", "a_level"), "user_id")
    assert j.filter((F.col("level") != F.col("a_level")) | (F.col("node") != F.col("a_node"))).count() == 0


def test_swap_twice_is_identity(spark, sf_small):
    from coldsplit.plans import fixtures as fx

    r = fx.ratings(spark, sf_small, "supp")
    back = prepare.swap_roles(prepare.swap_roles(r))
    assert back.exceptAll(r).count() == 0 and r.exceptAll(back).count() == 0


def test_duplicates_summed_and_error_policy(spark):
    cells = spark.createDataFrame([(0, 1, 5.0), (0, 1, 5.0), (1, 1, 3.0)], SCHEMA)
    got = {(x.user_id, x.item_id): x.rating for x in prepare.coo_build(cells, "sum").collect()}
    assert got[(0, 1)] == 10.0
    with pytest.raises(Exception):
        prepare.coo_build(cells, "error").collect()


def test_known_item_filter_drops_unseen_items(spark):
    train = spark.createDataFrame([(0, 1, 5.0)], SCHEMA)
    test = spark.createDataFrame([(5, 1, 4.0), (5, 9, 2.0)], SCHEMA)
    out = prepare.known_item_filter(test, train).collect()
    assert [(x.user_id, x.item_id) for x in out] == [(5, 1)]


def test_pad_item_code(spark):
    from coldsplit.functions import pad_item_code

    df = spark.createDataFrame([("123",), ("0123456789",), ("B00X",), ("12345678",)], "c string")
    got = [x.p for x in df.select(pad_item_code(F.col("c")).alias("p")).collect()]
    assert got == ["0123", "0123456789", "B00X", "012345678"]


def test_index_codes_dense_sorted(spark):
    df = spark.createDataFrame([(c,) for c in ["b", "a", "c", "a", "e", "d"] * 3], "k string")
    got = {x.k: x.idx for x in prepare.index_codes(df, "k").collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}
