from pyspark.sql import functions as F

from coldsplit.operators.evaluate import pseudo_users
from coldsplit.operators.evaluate import ColdStartModel, fit, load_model, save_model, score
from coldsplit.operators.factors import factorize, fit_levels, grid_rmse, tune_levels, validation_rmse
from coldsplit.operators.prepare import probe_remove
from coldsplit.operators.route import predict_pairs
from coldsplit.operators.tree import build_tree
from coldsplit.plans import fixtures as fx


def test_stacked_als_one_vector_per_node_and_item(spark, sf_small):
    r = fx.ratings(spark, sf_small, "supp")
    t = build_tree(r, depth=2, k=50)
    p = pseudo_users(t)
    nf, itf = fit_levels(p, t.levels, rank=4, max_iter=5, reg=0.05, seed=3)
    nodes = t.assignment.select("level", "node").distinct().count()
    assert nf.count() == nodes
    assert itf.count() == p.select("level", "item_id").distinct().count()
    assert nf.select(F.max(F.size("features"))).first()[0] == 4


def test_als_repeatable_and_beats_mean(spark, sf_small):
    r = fx.ratings(spark, sf_small, "supp")
    m1, u1, _ = factorize(r, rank=5, max_iter=8, reg=0.05, seed=10, num_blocks=2)
    m2, u2, _ = factorize(r, rank=5, max_iter=8, reg=0.05, seed=10, num_blocks=2)
    a = sorted((x.id, tuple(round(v, 4) for v in x.features)) for x in u1.collect())
    b = sorted((x.id, tuple(round(v, 4) for v in x.features)) for x in u2.collect())
    assert a == b
    pred = m1.transform(r)
    mu = r.agg(F.avg("rating")).first()[0]
    rmse = pred.agg(F.sqrt(F.avg(F.pow(F.col("rating") - F.col("prediction"), 2)))).first()[0]
    base = r.agg(F.sqrt(F.avg(F.pow(F.col("rating") - F.lit(mu), 2)))).first()[0]
    assert rmse < base


def test_item_ids_near_the_int_limit(spark, sf_small):
    r = fx.ratings(spark, sf_small, "supp").withColumn("item_id", F.lit(2**31 - 1).cast("int") - F.col("item_id"))
    t = build_tree(r, depth=1, k=50)
    p = pseudo_users(t)
    _, itf = fit_levels(p, t.levels, rank=3, max_iter=2)
    want = {(x.level, x.item_id) for x in p.select("level", "item_id").distinct().collect()}
    assert {(x.level, x.item_id) for x in itf.collect()} == want


def test_reg_and_grid_per_level(spark, sf_small):
    r = fx.ratings(spark, sf_small, "supp")
    validation = r.filter("(user_id * 31 + item_id * 17) % 10 = 0")
    train = probe_remove(r, validation)
    t = build_tree(train, depth=2, k=50)
    p = pseudo_users(t)
    grids = {0: (0.01, 0.5), 1: (0.05,), 2: (0.02, 0.05, 0.0001)}
    table, nf, _ = tune_levels(p, t.levels, validation, t.assignment, t.node_bound(), grids, rank=3, max_iter=3)
    rows = table.collect()
    assert {lv: {x["lambda"] for x in rows if x.level == lv} for lv in grids} == {lv: set(g) for lv, g in grids.items()}
    best = {x.level: x["lambda"] for x in rows if x.best}
    for lv in grids:
        own = {x["lambda"]: x.rmse for x in rows if x.level == lv}
        assert own[best[lv]] == min(own.values())
    # one fit with the best value of each level gives the factors kept
    again, _ = fit_levels(p, t.levels, rank=3, max_iter=3, reg=best)
    key = lambda x: (x.level, x.node, tuple(round(v, 3) for v in x.features))
    assert sorted(map(key, again.collect())) == sorted(map(key, nf.collect()))


def test_validation_rmse_by_hand(spark):
    validation = spark.createDataFrame([(u, i, float((u + i) % 5)) for u in range(6) for i in range(4)], "user_id int, item_id int, rating double")
    assignment = spark.createDataFrame([(0, 0, u) for u in range(6)] + [(1, u % 3, u) for u in range(6)], "level int, node int, user_id int")
    nodes = {(0, 0): [1.0, 2.0], (1, 0): [0.5, 1.0], (1, 1): [1.0, 0.0], (1, 2): [2.0, 1.0]}
    items = {(lv, i): [0.5 * i, 1.0 + lv] for lv in (0, 1) for i in range(4)}
    nf = spark.createDataFrame([(*k, v) for k, v in nodes.items()], "level int, node int, features array<float>")
    itf = spark.createDataFrame([(*k, v) for k, v in items.items()], "level int, item_id int, features array<float>")
    got = {x.level: (x.rmse, x.n) for x in validation_rmse(validation, assignment, nf, itf, 4, 2).collect()}
    for lv in (0, 1):
        err = []
        for u in range(6):
            a = nodes[lv, 0 if lv == 0 else u % 3]
            err += [((u + i) % 5 - sum(x * y for x, y in zip(a, items[lv, i], strict=True))) ** 2 for i in range(4)]
        assert got[lv][1] == 24 and abs(got[lv][0] - (sum(err) / 24) ** 0.5) < 1e-6


def test_no_known_cell_is_lost_below_the_last_level_of_an_item(spark):
    pairs = spark.createDataFrame([(1, 7, 4.0, 2, 5), (1, 8, 3.0, 2, 5), (2, 8, 2.0, 0, 0)], "user_id int, item_id int, rating double, level int, node int")
    nf = spark.createDataFrame([(0, 0, [1.0]), (1, 1, [10.0]), (2, 5, [100.0])], "level int, node int, features array<float>")
    itf = spark.createDataFrame([(0, 7, [1.0]), (1, 7, [2.0]), (0, 8, [3.0]), (2, 8, [4.0])], "level int, item_id int, features array<float>")
    got = {(x.user_id, x.item_id): x.prediction for x in predict_pairs(pairs, nf, itf, 3, 1).collect()}
    assert got == {(1, 7): 20.0, (1, 8): 400.0, (2, 8): 3.0}


def test_saved_model_scores_alike(spark, sf_small, tmp_path):
    r = fx.ratings(spark, sf_small, "supp")
    train, test = r.filter("user_id < 100"), r.filter("user_id >= 100")
    validation = train.filter("(user_id * 31 + item_id * 17) % 10 = 0")
    model = fit(train, depth=2, k=50, rank=3, max_iter=2, validation=validation, lambdas=(0.01, 0.1))
    assert model.tree.residuals.join(validation, ["user_id", "item_id"], "left_semi").count() == 0
    save_model(model, str(tmp_path / "m"))
    back = load_model(spark, str(tmp_path / "m"))
    assert isinstance(back, ColdStartModel) and back.level_lambda.count() == model.level_lambda.count()
    key = lambda x: (x.user_id, x.item_id, x.level, x.node, round(x.prediction, 4))
    want = sorted(map(key, score(model, test).collect()))
    assert sorted(map(key, score(back, test).collect())) == want and want
    model.tree.release()
    assert sorted(map(key, score(back, test).collect())) == want


def test_a_grid_reads_the_assignment_once_and_equals_single_fits(spark, sf_small):
    r = fx.ratings(spark, sf_small, "supp")
    validation = r.filter("(user_id * 31 + item_id * 17) % 10 = 0")
    t = build_tree(probe_remove(r, validation), depth=2, k=50)
    p = pseudo_users(t)
    single, nfs, ifs = {}, [], []
    for lam in (0.01, 0.3):
        nf, itf = fit_levels(p.filter("level < 2") if lam == 0.3 else p, t.levels, rank=3, max_iter=2, reg=lam)
        nfs.append(nf.withColumn("lambda", F.lit(lam)))
        ifs.append(itf.withColumn("lambda", F.lit(lam)))
        single |= {(x.level, lam): (round(x.rmse, 9), x.n) for x in validation_rmse(validation, t.assignment, nf, itf, t.node_bound(), 3).collect()}
    grid = grid_rmse(validation, t.assignment, nfs[0].unionByName(nfs[1]), ifs[0].unionByName(ifs[1]), t.node_bound(), 3, 2)
    got = {(x.level, x["lambda"]): (round(x.rmse, 9), x.n) for x in grid.collect()}
    assert got == single and len(got) == 5
    # what is left to run after the one join of the assignment reads the written cells
    own = set(t.assignment.inputFiles())
    assert own and not own & set(grid.inputFiles())
