from pyspark.sql import functions as F

from coldsplit.operators.route import route_users
from coldsplit.operators.tree import build_tree
from coldsplit.plans import fixtures as fx
from coldsplit.session import scratch_path
from coldsplit.streaming import start_routing


def test_streamed_answers_route_like_batch(spark, sf_small):
    r = fx.ratings(spark, sf_small, "supp")
    train = r.filter("user_id < 100")
    test = r.filter("user_id >= 100")
    t = build_tree(train, depth=2, k=50)
    src = scratch_path(spark, "stream-src")
    test.write.parquet(src)
    got = []

    def sink(df, batch_id):
        got.extend(tuple(x) for x in df.select("user_id", "level", "node").collect())

    q = start_routing(t, src, sink, scratch_path(spark, "stream-ckpt"))
    q.awaitTermination()
    batch = route_users(t, test).select("user_id", "level", "node").collect()
    assert sorted(got) == sorted(tuple(x) for x in batch)
