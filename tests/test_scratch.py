"""Scratch tables belong to a scope and go with it."""

import glob
import os

from coldsplit.session import Scratch, ensure_checkpoint_dir, session_conf, write_table


def _folders(spark):
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {os.path.basename(p) for p in glob.glob(f"{base}/scratch-*")}


def test_scope_leaves_only_the_result(spark):
    before = _folders(spark)
    with Scratch(spark) as tmp:
        a = tmp.write(spark.range(100), "a")
        b = tmp.bucketed(a.withColumn("k", a.id % 7), "b-c", ["k"], 4, sort=["k", "id"])
        c = tmp.write(b.groupBy("k").count(), "c")
        tmp.drop(a)
        assert len(_folders(spark) - before) == 2
        out = write_table(c.filter("k < 3"), "kept")
    left = _folders(spark) - before
    assert len(left) == 1 and next(iter(left)).startswith("scratch-kept")
    assert out.count() == 3


def test_scope_is_emptied_after_a_failure(spark):
    before = _folders(spark)
    try:
        with Scratch(spark) as tmp:
            tmp.write(spark.range(3), "a")
            raise KeyError("x")
    except KeyError:
        pass
    assert _folders(spark) == before


def test_settings_come_back(spark):
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(key)
    with session_conf(spark, spark__sql__requireAllClusterKeysForCoPartition="false"):
        assert spark.conf.get(key) == "false"
    assert spark.conf.get(key) == was


def test_salted_join_writes_no_scan_again(spark):
    from pyspark.sql import functions as F

    from coldsplit.operators.skew import salted_join
    from coldsplit.session import is_scan

    kept = write_table(spark.range(50).withColumnRenamed("id", "k"), "small")
    big = spark.range(200).withColumn("k", F.col("id") % 60)
    assert is_scan(kept) and is_scan(kept.filter("k > 3").select((F.col("k") + 1).alias("k"))) and not is_scan(kept.distinct())
    before = _folders(spark)
    assert salted_join(big, kept.filter("k < 40"), ["k"], ["id"]).count() == 140
    assert _folders(spark) == before
    with Scratch(spark) as tmp:
        out = salted_join(big, kept.distinct(), ["k"], ["id"], key_rows=2, broadcast_rows=0, tmp=tmp)
        assert out.count() == 170 and len(_folders(spark) - before) == 2
    assert _folders(spark) == before
