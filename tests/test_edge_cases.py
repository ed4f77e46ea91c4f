"""Remaining hand-sized cases of the fixture list."""

from pyspark.sql import functions as F

from coldsplit.operators import prepare, stats
from coldsplit.operators.evaluate import ColdStartModel, pseudo_users, score
from coldsplit.operators.route import route_users
from coldsplit.operators.tree import build_tree

SCHEMA = "user_id int, item_id int, rating double"


def test_node_without_like_users_is_not_materialised_nor_entered(spark):
    # nobody likes item 1 -> the like child of the root stays empty
    rows = [(0, 1, 2.0), (0, 2, 5.0), (1, 1, 1.0), (1, 2, 4.0), (2, 2, 5.0), (3, 2, 1.0), (3, 3, 4.0)]
    t = build_tree(spark.createDataFrame(rows, SCHEMA), depth=1, k=10)
    root = t.splits.first().item_id
    kids = {x.node for x in t.assignment.filter("level = 1").select("node").distinct().collect()}
    if root == 1:
        assert 0 not in kids
    test = spark.createDataFrame([(9, 1, 5.0), (9, 2, 3.0)], SCHEMA)
    r = route_users(t, test).first()
    # a like answer to an item whose like child is empty stays at the root
    if root == 1:
        assert (r.level, r.node) == (0, 0)
        assert r.trace == ["L"]


def test_user_whose_only_item_was_asked_is_skipped(spark):
    train = spark.createDataFrame(
        [(u, i, float(1 + (u * 7 + i * 3) % 5)) for u in range(12) for i in range(4)], SCHEMA
    )
    t = build_tree(train, depth=1, k=10)
    q = t.splits.first().item_id
    test = spark.createDataFrame([(50, q, 5.0), (51, q, 1.0), (51, (q + 1) % 4, 4.0)], SCHEMA)
    model = ColdStartModel(t, pseudo_users(t))
    per_user = {x.user_id for x in stats.rmse_per_user(score(model, test, train)).collect()}
    # 50 answered the only item it rated: nothing left to score
    assert 50 not in per_user
    assert 51 in per_user


def test_probe_only_user_has_no_training_ratings(spark):
    ratings = spark.createDataFrame([(0, 1, 4.0), (0, 2, 3.0), (1, 1, 5.0)], SCHEMA)
    probe = spark.createDataFrame([(1, 1)], "item_id int, user_id int")
    train = prepare.probe_remove(ratings, probe)
    assert train.filter("user_id = 1").count() == 0
    # compact_users runs before probe removal, so user 1 keeps an index
    ids = {x.user_id: x.new_user_id for x in prepare.compact_users(ratings).collect()}
    assert ids == {0: 1, 1: 2}
    t = build_tree(train, depth=1, k=10)
    assert t.assignment.filter("user_id = 1").count() == 0


def test_rated_item_missing_from_metadata_is_reported(spark):
    idx = spark.createDataFrame([("0001", 0), ("0002", 1), ("B003", 2)], "asin string, item_id int")
    meta = spark.createDataFrame(
        [("0001", "d1", "t1", 1.0), ("0001", "d0", "t0", 2.0), ("B003", "d3", "t3", 3.0)],
        "asin string, description string, title string, price double",
    )
    kept = prepare.restrict_items_to_rated(meta, idx).orderBy("asin").collect()
    assert [(x.asin, x.title) for x in kept] == [(0, "t0"), (2, "t3")]
    missing = [x.asin for x in prepare.missing_metadata(idx, meta).collect()]
    assert missing == ["0002"]


def test_item_seen_only_in_test_is_not_scored(spark):
    train = spark.createDataFrame(
        [(u, i, float(1 + (u + 2 * i) % 5)) for u in range(10) for i in range(3)], SCHEMA
    )
    t = build_tree(train, depth=1, k=10)
    test = spark.createDataFrame([(20, 0, 4.0), (20, 1, 2.0), (20, 99, 5.0)], SCHEMA)
    model = ColdStartModel(t, pseudo_users(t))
    items = {x.item_id for x in score(model, test, train).collect()}
    assert 99 not in items


def test_salted_join_spreads_a_hot_key_and_keeps_every_row(spark):
    from coldsplit.operators.skew import salted_join

    big = spark.createDataFrame(
        [(1, i) for i in range(500)] + [(2, i) for i in range(3)], "user_id int, item_id int"
    )
    small = spark.createDataFrame([(1, "a"), (2, "b")], "user_id int, tag string")
    plain = salted_join(big, small, ["user_id"], ["item_id"], key_rows=100)
    assert "BroadcastHashJoin" in plain._jdf.queryExecution().sparkPlan().toString()
    assert plain.count() == 503
    out = salted_join(big, small, ["user_id"], ["item_id"], key_rows=100, broadcast_rows=0)
    assert out.count() == 503
    assert out.filter("user_id = 1 AND tag = 'a'").count() == 500
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "_salt" in plan
    left = salted_join(
        big, small.filter("user_id = 2"), ["user_id"], ["item_id"], "left", key_rows=100, broadcast_rows=0
    )
    assert left.count() == 503 and left.filter("tag IS NULL").count() == 500


def test_scratch_tables_can_be_dropped(spark):
    from coldsplit.session import drop_scratch_tables, write_bucketed

    df = spark.createDataFrame([(1, 0, 2.0)], SCHEMA).withColumnRenamed("item_id", "salt")
    t = write_bucketed(df, "probe", ["user_id", "salt"], 2)
    assert t.count() == 1
    assert drop_scratch_tables(spark) >= 1
