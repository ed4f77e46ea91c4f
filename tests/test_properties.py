"""Property tests on random small rating matrices (hypothesis):
the sparse split score equals the dense definition for every candidate, the
children of a split partition its users, and routing a training user on its
own ratings lands on its assigned node."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coldsplit.operators.route import route_users
from coldsplit.operators.tree import build_tree, level_frames
from tests.test_tree_units import SCHEMA, dense_errors

cells = st.lists(
    st.tuples(st.integers(0, 7), st.integers(0, 5), st.sampled_from([1.0, 2.0, 3.0, 3.5, 4.0, 5.0])),
    min_size=4,
    max_size=30,
    unique_by=lambda t: (t[0], t[1]),
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=cells)
def test_sparse_equals_dense_and_children_partition(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    t = build_tree(df, depth=2, k=10)
    got = {r.item_id: r.error for r in level_frames(t, 0)["scored"].collect()}
    dense = dense_errors(rows)
    for c, e in got.items():
        assert abs(e - dense[c]) <= 1e-6 * max(1.0, abs(dense[c]))
    a = t.assignment
    n0 = a.filter("level = 0").count()
    n1 = a.filter("level = 1").count()
    assert n1 == (n0 if t.levels >= 1 else 0)
    routed = route_users(t, df).select("user_id", "level", "node")
    deepest = a.groupBy("user_id").agg(F.max("level").alias("level"))
    final = a.join(deepest, ["user_id", "level"])
    assert routed.exceptAll(final.select("user_id", "level", "node")).count() == 0
