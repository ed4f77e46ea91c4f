"""Work that must not grow faster than the tables: partitions, shuffles, repeats."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from coldsplit import sources
from coldsplit.operators import evaluate, stats
from coldsplit.operators import tree as T
from coldsplit.plans import fixtures as fx
from coldsplit.plans import queries_data


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(u, i, float((u * 7 + i * 3) % 5 + 1)) for u in range(60) for i in range(12) if (u + i) % 3]
    return spark.createDataFrame(rows, "user_id int, item_id int, rating double")


@pytest.fixture(scope="module")
def grown(cells):
    return T.build_tree(cells, depth=2, k=6)


def _above_generate(plan) -> int:
    """Shuffles that move unpacked ratings before anything is summed."""
    text = plan._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in text.splitlines() if x.strip()]
    found = 0
    for n, line in enumerate(lines):
        if "Exchange" not in line:
            continue
        below = next((x for x in lines[n + 1 :] if "Generate" in x or "Aggregate" in x or "Exchange" in x), "")
        found += "Generate" in below
    return found


def test_rating_shuffles_follow_the_rows(spark, tmp_path, monkeypatch):
    n = 4000
    spark.range(n).select((F.col("id") % 900).alias("l_orderkey"), (F.col("id") % 70).alias("l_partkey"), (F.col("id") % 11).alias("l_suppkey"), (F.col("id") % 50 + 1).cast("double").alias("l_quantity")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(900).select(F.col("id").alias("o_orderkey"), (F.col("id") % 83).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(fx, "ROWS_PER_TASK", 100, raising=False)
    for which in ("supp", "part"):
        got = fx.ratings(spark, str(tmp_path), which)
        assert got.rdd.getNumPartitions() == n // 100
        assert got.count() == got.select("user_id", "item_id").distinct().count()
        assert fx.raw_cells(spark, str(tmp_path)).count() == n


def test_user_rows_are_dealt_by_the_shuffle_that_gathers_them(spark, cells, monkeypatch):
    seen = {}
    write = T.write_bucketed
    monkeypatch.setattr(T, "write_bucketed", lambda df, name, cols, p, **kw: seen.update({name: kw.get("dealt", False)}) or write(df, name, cols, p, **kw))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows, _, _, p = T.prepare_residuals(cells, salt_rows=5)  # users with several rows
    assert seen["residuals"]
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    files = [f.split("_")[-1].split(".")[0] for f in rows.inputFiles()]
    assert len(files) == len(set(files)) <= p  # a bucket is one file
    assert rows.groupBy("user_id", "salt").count().filter("count > 1").count() == 0
    assert rows.select(F.sum(F.size("items"))).first()[0] == cells.count()


def test_pseudo_users_leave_the_user_rows_in_place(grown, cells):
    got = evaluate.pseudo_users(grown)
    assert _above_generate(got) == 0
    want = stats.pseudo_user_ratings(cells, grown.assignment)
    order = ["level", "node", "item_id"]
    a, b = ([tuple(r) for r in d.select(*order, F.round("rating", 9)).orderBy(*order).collect()] for d in (got, want))
    assert a == b and a


def test_scored_pairs_are_built_once(spark, cells, grown, monkeypatch):
    written = []
    write = evaluate.write_table
    monkeypatch.setattr(evaluate, "write_table", lambda df, name: written.append(name) or write(df, name))
    model = evaluate.ColdStartModel(grown, evaluate.pseudo_users(grown))
    test = cells.withColumn("user_id", F.col("user_id") + 1000)
    assert evaluate.score(model, test).count() > 0
    assert "eval-pairs" in written


def test_item_totals_are_exact_without_decimals(spark):
    q = [2**59 + 1, 2**59 + 3, -(2**59) - 5, 2**59 + 7, 2**61, 2**61, 2**61, 2**61, -1, 2**30 - 1]
    ea = spark.createDataFrame([(0, 1, x) for x in q] + [(0, 2, -3), (0, 2, -(2**40) - 1)], "node int, item_id int, q long")
    got = {r.item_id: r for r in T.node_item_totals(ea, squares=False).collect()}
    assert "s2" not in got[1]
    assert (int(got[1].ts), got[1].tn) == (sum(q), len(q))
    assert (int(got[2].ts), got[2].tn) == (-(2**40) - 4, 2)


def test_squares_of_large_ratings(spark):
    rows = [(1, i, 1e5 + i) for i in range(30)] + [(2, i, -1e5) for i in range(5)]
    e = T.prepare_residuals(spark.createDataFrame(rows, "user_id int, item_id int, rating double"))[0]
    for r in e.collect():
        assert int(r.square) == sum(int(Decimal(repr((x / T.SCALE) * (x / T.SCALE) * T.SCALE))) for x in r.residuals)


def test_item_folders_are_listed_by_few_tasks(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    n = sources.LISTERS_PER_CORE * cores + 40 if hasattr(sources, "LISTERS_PER_CORE") else 8 * cores + 40
    for i in range(n):
        d = tmp_path / f"item_id={i}"
        d.mkdir()
        (d / "part.txt").write_text(f"{i}:\n{i + 1},3,2005-01-01\n")
    spark.sparkContext.setJobGroup("item-folders", "")
    got = sources.read_sectioned_ratings(spark, str(tmp_path), id_pattern=r"item_id=(\d+)")
    track = spark.sparkContext.statusTracker()
    stages = [s for j in track.getJobIdsForGroup("item-folders") for s in track.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages and max(track.getStageInfo(s).numTasks for s in stages) < n - 30
    assert sorted((r.user_id, r.item_id, r.rating) for r in got.collect()) == [(i + 1, i, 3.0) for i in range(n)]


def test_sectioned_ratings_are_built_once(spark, sf_small, monkeypatch):
    built = []
    ratings = fx.ratings
    seen = spark.sparkContext.accumulator(0)

    def counted(s, sf, which="supp"):
        built.append(which)

        def rows(batches):
            for b in batches:
                seen.add(len(b))
                yield b

        r = ratings(s, sf, which)
        return r.mapInPandas(rows, r.schema)

    monkeypatch.setattr(fx, "ratings", counted)
    queries_data._write_sectioned(spark, sf_small)
    assert built and seen.value == ratings(spark, sf_small).count()
