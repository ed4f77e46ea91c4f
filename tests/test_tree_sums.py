"""The level loop: totals by subtraction, sums that depend on no order, one scan."""

import pytest
from pyspark.sql import functions as F

from coldsplit.operators import tree as T
from coldsplit.plans import fixtures as fx
from coldsplit.session import session_conf


def _splits(t):
    return sorted(tuple(r) for r in t.splits.select("level", "node", "item_id", "error", "gain", "n_users", "popularity").collect())


@pytest.fixture(scope="module")
def ratings(spark, sf_small):
    from coldsplit.session import write_table

    return write_table(fx.ratings(spark, sf_small, "supp"), "ratings")


def test_splits_do_not_depend_on_partitions(spark, ratings):
    """Bit-equal errors and gains, ties planted: items 90 and 91 split alike, and so
    do 92 and 93."""
    r = ratings
    for a, b in ((1, 90), (1, 91), (2, 92), (2, 93)):
        r = r.unionByName(ratings.filter(F.col("item_id") == a).withColumn("item_id", F.lit(b)))
    got = []
    for parts in ("3", "23"):
        with session_conf(spark, spark__sql__shuffle__partitions=parts):
            got.append(_splits(T.build_tree(r.repartition(int(parts)), depth=2, k=50)))
    assert got[0] == got[1]


def test_heavy_users_in_many_rows_change_nothing(spark, ratings):
    """Rows of at most 3 ratings (and a user with a third of all) against one row a user;
    long against decimal sums."""
    hot = spark.range(700).select(F.lit(5).cast("int").alias("user_id"), F.col("id").cast("int").alias("item_id"), (1.0 + F.col("id") % 5).alias("rating"))
    r = ratings.filter("user_id <> 5").unionByName(hot)
    plain = T.build_tree(r, depth=2, k=20)
    salted = T.build_tree(r, depth=2, k=20, salt_rows=3)
    assert salted.user_rows.filter("user_id = 5").count() > 100
    assert _splits(plain) == _splits(salted)
    assert plain.assignment.exceptAll(salted.assignment).count() == 0
    rows = T.level_rows(salted.user_rows, salted.salted_by_level[0])
    cands = T.level_frames(salted, 0)["cands"]
    sums = [T.branch_sums(rows, cands, 1, 20, wide=wide) for wide in (True, False)]
    assert sums[0].exceptAll(sums[1]).count() == 0 and sums[0].count() > 0


def test_child_totals_equal_the_ratings(spark, ratings):
    t = T.build_tree(ratings, depth=2, k=50)
    rows = T.level_rows(t.user_rows, t.salted_by_level[0])
    totals = T.node_item_totals(T.rating_rows(rows))
    sums = T.branch_sums(rows, T.level_frames(t, 0)["cands"], 1, 50)
    got = T.child_totals(totals, sums, t.splits.filter("level = 0"), 1)
    below = T.node_item_totals(T.rating_rows(T.level_rows(t.user_rows, t.salted_by_level[1]))).select("node", "item_id", "ts", "tn")
    assert got.exceptAll(below).count() == 0 and below.exceptAll(got).count() == 0


def test_a_level_reads_the_ratings_once(spark, ratings):
    t = T.build_tree(ratings, depth=2, k=50)
    rows = T.level_rows(t.user_rows, t.salted_by_level[1])
    cands = t.splits.select("node", "item_id")
    plan = T.branch_sums(rows, cands, 3, 50, heavy=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("coldsplit_residuals") == 1
    moved = T.partition_nodes(rows, t.splits.filter("level = 1"), 3, heavy=False)._jdf.queryExecution().executedPlan().toString()
    read = [line for line in moved.splitlines() if "ReadSchema" in line and "likes" in line]
    assert len(read) == 1 and "ratings" not in read[0] and "residuals" not in read[0].split("ReadSchema")[1]
