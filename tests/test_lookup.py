"""Vectors of pairs: what is shuffled, and the rows of repeated and absent keys."""

from coldsplit.operators import skew
from coldsplit.plans import queries


def test_pairs_are_shuffled_without_vectors(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROW_LIMIT", 0)
    pairs = [(u, i, 1, u % 3) for u in range(30) for i in range(8)] + [(1, 1, 1, 1), (2, None, 1, 1), (3, 99, 1, 1)]
    p = spark.createDataFrame(pairs, "user_id int, item_id int, level int, node int").repartition(3)
    nodes = spark.createDataFrame([(1, n, [1.0, float(n)]) for n in range(3)], "level int, node int, u array<float>")
    items = spark.createDataFrame([(1, i, [float(i)] * 3) for i in range(8)], "level int, item_id int, w array<float>")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = queries._lookup(p, nodes, items, 3)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["user_id"], r["item_id"], r["node"], r["u"], r["w"]) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == sorted((u, i, n, [1.0, float(n)], [float(i)] * 3) for u, i, _, n in pairs if i is not None and i < 8)
    assert plan.index("BroadcastHashJoin") < plan.index("SortMergeJoin")  # the node's join stands above
