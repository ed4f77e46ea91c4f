"""Registry of queries: name -> (Spark callable(spark, sf_dir), DuckDB SQL | None).

Each Spark callable reads the driver's parquet tables (through the fixtures)
and returns a DataFrame; doubles are rounded after aggregation (6 digits; 4
for split errors) so both engines can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldsplit import sources
from coldsplit.functions import attitude_branch, attitude_letter, dot_product
from coldsplit.operators import evaluate, prepare, stats
from coldsplit.operators.factors import best_of_grid, fit_levels, grid_rmse, tune_levels
from coldsplit.operators.recommend import als_baseline, recommend_items, recommend_users, top_products
from coldsplit.operators.route import (
    answered_items,
    evaluation_pairs,
    predict_all_items,
    predict_node_mean,
    predict_pairs,
    route_answers,
    route_users,
    split_answers,
)
from coldsplit.operators.skew import salted_join
from coldsplit.operators.tree import build_tree, level_frames
from coldsplit.session import bounded_broadcast as _bcast
from coldsplit.plans import fixtures as fx
from coldsplit.plans.oracle import base_ctes, route_ctes, tree_ctes, with_, CELLS, RATINGS
from coldsplit.session import materialize, scratch_path, write_table

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

DEPTH = 3
K = 200


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


def r6(c):
    return F.round(c, 6)


def r4(c):
    return F.round(c, 4)


# --------------------------------------------------------------- shared state
_TREES: dict = {}


_RATINGS: dict = {}


def _session(spark) -> str:
    return spark.sparkContext.applicationId


def clear_caches(spark=None) -> None:
    """Forget the trees, ratings and factors kept for this session; with ``spark``,
    drop the scratch tables behind the trees too."""
    if spark is not None:
        for kept in _TREES.values():
            kept[0].release()
    _TREES.clear()
    _RATINGS.clear()
    _PSEUDO.clear()


def kept_ratings(spark, sf, which="supp"):
    """A stand-in ratings table, written once per session (it is read by every
    stage of the pipeline)."""
    key = (_session(spark), sf, which)
    if key not in _RATINGS:
        _RATINGS[key] = write_table(fx.ratings(spark, sf, which), f"ratings-{which}")
    return _RATINGS[key]


def split_data(spark, sf, which="supp", swap=False):
    """Train/test parts of a stand-in ratings table."""
    r = kept_ratings(spark, sf, which)
    if swap:
        r = prepare.swap_roles(r)
    train, test = prepare.prefix_split(r, fx.TRAIN_FRACTION)
    return prepare.drop_unrated(train), prepare.drop_unrated(test)


def _tree_key(spark, sf, which="supp", depth=DEPTH, k=K, order="most", score_items="all", swap=False):
    return (_session(spark), sf, which, depth, k, order, score_items, swap)


def tree_for(spark, sf, which="supp", depth=DEPTH, k=K, order="most", score_items="all", swap=False):
    key = _tree_key(spark, sf, which, depth, k, order, score_items, swap)
    if key not in _TREES:
        train, test = split_data(spark, sf, which, swap)
        t = build_tree(train, depth=depth, k=k, order=order, score_items=score_items)
        _TREES[key] = (t, train, test)
    return _TREES[key]


_PSEUDO: dict = {}


def pseudo_for(spark, sf, **kw):
    t, train, test = tree_for(spark, sf, **kw)
    key = _tree_key(spark, sf, **kw)
    if key not in _PSEUDO:
        _PSEUDO[key] = write_table(evaluate.pseudo_users(t), "pseudo")
    return _PSEUDO[key]


def _routed(spark, sf, max_questions=None, **kw):
    t, train, test = tree_for(spark, sf, **kw)
    return route_users(t, test, max_questions)


def _node_mean_preds(spark, sf, max_questions=None, answers=None, **kw):
    t, train, test = tree_for(spark, sf, **kw)
    if answers is None:
        routed = route_users(t, test, max_questions)
    else:
        routed = route_answers(t, answers, max_questions)
    pairs = evaluation_pairs(routed, test, prepare.rated_items(train))
    return predict_node_mean(pairs, pseudo_for(spark, sf, **kw))


TREE = tree_ctes("supp", DEPTH, K)
ROUTE = TREE + route_ctes(DEPTH)
BASE = base_ctes("supp")
PART = [CELLS, RATINGS["part"]]
SUPP = [CELLS, RATINGS["supp"]]

# =============================================================== tree (2.8)


@query(
    "build_tree",
    with_(TREE, "SELECT level, node, item_id, ROUND(error, 4) AS error, n_users, popularity FROM splits"),
)
def q_build_tree(spark, sf):
    t, _, _ = tree_for(spark, sf)
    return t.splits.select("level", "node", "item_id", r4(F.col("error")).alias("error"), "n_users", "popularity")


@query(
    "best_split",
    with_(TREE, "SELECT node, item_id, ROUND(error, 4) AS error, n_users FROM split0"),
)
def q_best_split(spark, sf):
    t, _, _ = tree_for(spark, sf)
    return t.splits.filter("level = 0").select("node", "item_id", r4(F.col("error")).alias("error"), "n_users")


@query(
    "build_tree_part",
    with_(tree_ctes("part", DEPTH, K), "SELECT level, node, item_id, ROUND(error, 4) AS error, n_users, popularity FROM splits"),
)
def q_build_tree_part(spark, sf):
    t, _, _ = tree_for(spark, sf, which="part")
    return t.splits.select("level", "node", "item_id", r4(F.col("error")).alias("error"), "n_users", "popularity")


DEEP = 7  # fixed value: depth of the published new-user runs


@query(
    "build_tree_deep",
    with_(tree_ctes("part", DEEP, K), "SELECT level, node, item_id, ROUND(error, 4) AS error, n_users, popularity FROM splits"),
)
def q_build_tree_deep(spark, sf):
    """Seven levels on sparse ratings: most users are unknown to most questions, and
    small nodes run out of candidates."""
    t, _, _ = tree_for(spark, sf, which="part", depth=DEEP)
    return t.splits.select("level", "node", "item_id", r4(F.col("error")).alias("error"), "n_users", "popularity")


@query(
    "candidate_scope_error",
    with_(
        tree_ctes("supp", DEPTH, K, score_items="candidates"),
        "SELECT level, node, item_id, ROUND(error, 4) AS error, n_users FROM splits",
    ),
)
def q_candidate_scope(spark, sf):
    t, _, _ = tree_for(spark, sf, score_items="candidates")
    return t.splits.select("level", "node", "item_id", r4(F.col("error")).alias("error"), "n_users")


@query(
    "build_tree_least",
    with_(
        tree_ctes("supp", DEPTH, K, order="least"),
        "SELECT level, node, item_id, ROUND(error, 4) AS error, n_users, popularity FROM splits",
    ),
)
def q_tree_least(spark, sf):
    t, _, _ = tree_for(spark, sf, order="least")
    return t.splits.select("level", "node", "item_id", r4(F.col("error")).alias("error"), "n_users", "popularity")


@query(
    "stop_rule",
    with_(tree_ctes("supp", DEPTH, 1), "SELECT level, node, item_id, n_users FROM splits"),
)
def q_stop_rule(spark, sf):
    """K=1 < depth: children whose single candidate is already on the path
    have nothing left to ask and become leaves."""
    t, _, _ = tree_for(spark, sf, k=1)
    return t.splits.select("level", "node", "item_id", "n_users")


@query("node_assignment", with_(TREE, "SELECT level, node, user_id FROM assignment"))
def q_node_assignment(spark, sf):
    t, _, _ = tree_for(spark, sf)
    return t.assignment


@query("user_node_index", with_(TREE, "SELECT user_id, level, node FROM assignment"))
def q_user_node_index(spark, sf):
    t, _, _ = tree_for(spark, sf)
    return t.assignment.select("user_id", "level", "node")


@query("partition_nodes", with_(TREE, "SELECT node, user_id FROM a1"))
def q_partition_nodes(spark, sf):
    t, _, _ = tree_for(spark, sf)
    return t.assignment.filter("level = 1").select("node", "user_id")


@query(
    "node_sizes",
    with_(TREE, "SELECT level, node, COUNT(*) AS n_users FROM assignment GROUP BY level, node"),
)
def q_node_sizes(spark, sf):
    t, _, _ = tree_for(spark, sf)
    return stats.node_sizes(t.assignment)


@query(
    "select_levels",
    with_(TREE, "SELECT level, node, user_id FROM assignment WHERE level >= 1 AND level <= 2"),
)
def q_select_levels(spark, sf):
    t, _, _ = tree_for(spark, sf)
    return prepare.select_levels(t.assignment, 1, 2)


@query(
    "node_item_stats",
    with_(
        TREE,
        "SELECT x.level, x.node, e.item_id, ROUND(SUM(e.e), 6) AS s, ROUND(SUM(e.e * e.e), 6) AS s2, COUNT(*) AS n"
        " FROM assignment x JOIN e ON x.user_id = e.user_id GROUP BY x.level, x.node, e.item_id",
    ),
)
def q_node_item_stats(spark, sf):
    t, train, _ = tree_for(spark, sf)
    out = stats.node_item_stats(train, t.bias, t.assignment)
    return out.select("level", "node", "item_id", r6(F.col("s")).alias("s"), r6(F.col("s2")).alias("s2"), "n")


@query(
    "node_item_popularity",
    with_(TREE, "SELECT x.level, x.node, e.item_id, COUNT(*) AS n FROM assignment x JOIN e ON x.user_id = e.user_id GROUP BY x.level, x.node, e.item_id"),
)
def q_node_item_popularity(spark, sf):
    t, _, _ = tree_for(spark, sf)
    j = t.residuals.join(t.salted_assignment, ["user_id", "salt"])
    return j.groupBy("level", "node", "item_id").agg(F.count(F.lit(1)).alias("n"))


@query("topk_candidates", with_(TREE, "SELECT node, item_id, popularity FROM cand0"))
def q_topk(spark, sf):
    t, _, _ = tree_for(spark, sf)
    return level_frames(t, 0)["cands"]


@query("exclude_chosen", with_(TREE, "SELECT node, item_id, popularity FROM cand1"))
def q_exclude_chosen(spark, sf):
    t, _, _ = tree_for(spark, sf)
    return level_frames(t, 1)["cands"]


@query(
    "corating_join",
    with_(
        TREE,
        "SELECT a.node, a.cand, COUNT(*) AS n_rows FROM ask0 a JOIN ea0 r ON a.user_id = r.user_id AND a.node = r.node"
        " GROUP BY a.node, a.cand",
    ),
)
def q_corating(spark, sf):
    t, _, _ = tree_for(spark, sf)
    b = level_frames(t, 0)["branches"]
    return b.groupBy("node", "cand").agg(F.sum(F.col("nL") + F.col("nD")).cast("long").alias("n_rows"))


@query(
    "branch_stats",
    with_(
        TREE,
        "SELECT node, cand, item_id, ROUND(sL, 6) AS sL, CAST(nL AS BIGINT) AS nL, ROUND(sD, 6) AS sD,"
        " CAST(nD AS BIGINT) AS nD FROM br1",
    ),
)
def q_branch_stats(spark, sf):
    t, _, _ = tree_for(spark, sf)
    b = level_frames(t, 1)["branches"]
    return b.select("node", "cand", "item_id", r6(F.col("sL")).alias("sL"), "nL", r6(F.col("sD")).alias("sD"), "nD")


@query(
    "unknown_stats",
    with_(
        TREE,
        "SELECT b.node, b.cand, b.item_id, ROUND(t.ts - b.sL - b.sD, 6) AS sU, CAST(t.tn - b.nL - b.nD AS BIGINT) AS nU"
        " FROM br0 b JOIN tot0 t ON b.node = t.node AND b.item_id = t.item_id",
    ),
)
def q_unknown_stats(spark, sf):
    t, _, _ = tree_for(spark, sf)
    fr = level_frames(t, 0)
    j = fr["branches"].join(fr["totals"], ["node", "item_id"])
    return j.select(
        "node",
        "cand",
        "item_id",
        r6(F.col("ts") - F.col("sL") - F.col("sD")).alias("sU"),
        (F.col("tn") - F.col("nL") - F.col("nD")).cast("long").alias("nU"),
    )


@query(
    "split_error",
    with_(TREE, "SELECT node, item_id, ROUND(error, 4) AS error, popularity FROM scored0"),
)
def q_split_error(spark, sf):
    t, _, _ = tree_for(spark, sf)
    s = level_frames(t, 0)["scored"]
    return s.select("node", "item_id", r4(F.col("error")).alias("error"), "popularity")


@query(
    "split_error_level2",
    with_(TREE, "SELECT node, item_id, ROUND(error, 4) AS error, popularity FROM scored2"),
)
def q_split_error2(spark, sf):
    t, _, _ = tree_for(spark, sf)
    s = level_frames(t, 2)["scored"]
    return s.select("node", "item_id", r4(F.col("error")).alias("error"), "popularity")


@query("next_question", with_(ROUTE, "SELECT r.user_id, r.level, r.node, s.item_id AS next_item FROM routed r LEFT JOIN splits s ON s.level = r.level AND s.node = r.node"))
def q_next_question(spark, sf):
    t, _, _ = tree_for(spark, sf)
    routed = _routed(spark, sf)
    s = t.splits.select("level", "node", F.col("item_id").alias("next_item"))
    return routed.join(_bcast(s, t.split_bound()), ["level", "node"], "left").select("user_id", "level", "node", "next_item")


def _asked_str(col):
    return F.array_join(F.transform(col, lambda x: F.concat(x.item_id.cast("string"), F.lit(":"), x.attitude)), ",")


@query("route_users", with_(ROUTE, "SELECT user_id, level, node, asked FROM routed"))
def q_route_users(spark, sf):
    r = _routed(spark, sf)
    return r.select("user_id", "level", "node", _asked_str(F.col("asked")).alias("asked"))


@query("attitude_trace", with_(ROUTE, "SELECT user_id, trace FROM routed"))
def q_attitude_trace(spark, sf):
    r = _routed(spark, sf)
    return r.select("user_id", F.array_join("trace", "").alias("trace"))


@query(
    "split_lookup",
    with_(
        ROUTE,
        "SELECT u.user_id, t.rating AS answer FROM (SELECT DISTINCT user_id FROM test) u"
        " LEFT JOIN test t ON t.user_id = u.user_id AND t.item_id = (SELECT item_id FROM split0)",
    ),
)
def q_split_lookup(spark, sf):
    t, _, test = tree_for(spark, sf)
    root = t.splits.filter("level = 0").select(F.col("item_id").alias("q"))
    users = test.select("user_id").distinct()
    ans = test.join(_bcast(root, 1), test.item_id == root.q).select("user_id", F.col("rating").alias("answer"))
    return users.join(ans, "user_id", "left")


@query(
    "classify_attitude",
    with_(
        SUPP,
        "SELECT user_id, item_id, CASE WHEN rating >= 4 THEN 'L' WHEN rating <= 3 THEN 'D' ELSE 'U' END AS attitude FROM ratings",
    ),
)
def q_classify(spark, sf):
    r = fx.ratings(spark, sf, "supp")
    return r.select("user_id", "item_id", attitude_letter(attitude_branch("rating")).alias("attitude"))


@query(
    "node_exists",
    with_(
        TREE,
        "SELECT s.level, s.node * 3 + b.b AS child, EXISTS (SELECT 1 FROM assignment x WHERE x.level = s.level + 1"
        " AND x.node = s.node * 3 + b.b) AS child_exists FROM splits s JOIN (SELECT 0 AS b UNION ALL SELECT 1 UNION ALL SELECT 2) b ON TRUE",
    ),
)
def q_node_exists(spark, sf):
    t, _, _ = tree_for(spark, sf)
    kids = t.splits.select("level", "node", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("b")).select(
        "level", (F.col("node") * 3 + F.col("b")).alias("child")
    )
    have = t.assignment.select((F.col("level") - 1).alias("level"), F.col("node").alias("child")).distinct().withColumn("child_exists", F.lit(True))
    return kids.join(have, ["level", "child"], "left").select(
        "level", "child", F.coalesce("child_exists", F.lit(False)).alias("child_exists")
    )


@query(
    "exclude_asked",
    with_(ROUTE, "SELECT user_id, COUNT(*) AS n_unasked FROM pairs GROUP BY user_id"),
)
def q_exclude_asked(spark, sf):
    t, train, test = tree_for(spark, sf)
    pairs = evaluation_pairs(_routed(spark, sf), test, prepare.rated_items(train))
    return pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_unasked"))


@query("unasked_items", with_(ROUTE, "SELECT user_id, item_id FROM pairs"))
def q_unasked(spark, sf):
    t, train, test = tree_for(spark, sf)
    return evaluation_pairs(_routed(spark, sf), test, prepare.rated_items(train)).select("user_id", "item_id")


@query("answered_items", with_(ROUTE, "SELECT user_id, item_id FROM answered"))
def q_answered(spark, sf):
    return answered_items(_routed(spark, sf))


@query(
    "known_item_filter",
    with_(BASE, "SELECT user_id, item_id, rating FROM test WHERE item_id IN (SELECT item_id FROM train)"),
)
def q_known(spark, sf):
    train, test = split_data(spark, sf)
    return prepare.known_item_filter(test, train)


@query(
    "pseudo_user_ratings",
    with_(TREE, "SELECT level, node, item_id, ROUND(rating, 6) AS rating FROM pseudo"),
)
def q_pseudo(spark, sf):
    return pseudo_for(spark, sf).select("level", "node", "item_id", r6(F.col("rating")).alias("rating"))


@query(
    "append_levels",
    with_(TREE, "SELECT level, COUNT(*) AS n_rows, ROUND(SUM(rating), 6) AS total FROM pseudo GROUP BY level"),
)
def q_append_levels(spark, sf):
    p = pseudo_for(spark, sf)
    return p.groupBy("level").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.sum("rating")).alias("total"))


@query(
    "pseudo_user_ratings_eps",
    with_(
        TREE,
        "SELECT level, node, item_id, ROUND(r, 6) AS rating FROM (SELECT x.level, x.node, e.item_id,"
        " SUM(e.rating) / (COUNT(*) + 1e-9) AS r FROM assignment x JOIN e ON x.user_id = e.user_id"
        " GROUP BY x.level, x.node, e.item_id) WHERE r <> 0",
    ),
)
def q_pseudo_eps(spark, sf):
    t, train, _ = tree_for(spark, sf)
    p = stats.pseudo_user_ratings(train, t.assignment, variant="eps")
    return p.select("level", "node", "item_id", r6(F.col("rating")).alias("rating"))


@query(
    "rater_intersection",
    with_(
        TREE,
        "SELECT s.level, s.node, COUNT(*) AS n_raters FROM splits s JOIN assignment x ON x.level = s.level AND x.node = s.node"
        " JOIN train t ON t.user_id = x.user_id AND t.item_id = s.item_id GROUP BY s.level, s.node",
    ),
)
def q_rater_intersection(spark, sf):
    t, train, _ = tree_for(spark, sf)
    members = t.assignment.join(_bcast(t.splits.select("level", "node", "item_id"), t.split_bound()), ["level", "node"])
    raters = members.join(train.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")
    return raters.groupBy("level", "node").agg(F.count(F.lit(1)).alias("n_raters"))


# --------------------------------------------------------------- evaluation

@query(
    "rmse_per_user",
    with_(ROUTE, "SELECT user_id, ROUND(rmse, 6) AS rmse, n FROM user_rmse"),
)
def q_rmse_per_user(spark, sf):
    p = stats.rmse_per_user(_node_mean_preds(spark, sf))
    return p.select("user_id", r6(F.col("rmse")).alias("rmse"), "n")


@query("rmse_macro", with_(ROUTE, "SELECT ROUND(AVG(rmse), 6) AS rmse, COUNT(*) AS n_users FROM user_rmse"))
def q_rmse_macro(spark, sf):
    m = stats.rmse_macro(stats.rmse_per_user(_node_mean_preds(spark, sf)))
    return m.select(r6(F.col("rmse")).alias("rmse"), "n_users")


@query(
    "rmse_micro",
    with_(ROUTE, "SELECT ROUND(SQRT(AVG((rating - prediction) * (rating - prediction))), 6) AS rmse, COUNT(*) AS n FROM pred"),
)
def q_rmse_micro(spark, sf):
    m = stats.rmse_micro(_node_mean_preds(spark, sf))
    return m.select(r6(F.col("rmse")).alias("rmse"), "n")


_EVAL_SELECT = (
    "SELECT ROUND(AVG(rmse), 6) AS rmse_macro, COUNT(*) AS n_users, SUM(n) AS n_pairs,"
    " (SELECT COUNT(DISTINCT user_id) FROM test) - COUNT(*) AS n_skipped FROM user_rmse"
)


def _model(spark, sf, **kw):
    return evaluate.ColdStartModel(tree_for(spark, sf, **kw)[0], pseudo_for(spark, sf, **kw))


def _eval_node_mean(spark, sf, swap=False):
    _, _, test = tree_for(spark, sf, swap=swap)
    out = evaluate.evaluate_model(_model(spark, sf, swap=swap), test)
    return out.withColumn("rmse_macro", r6(F.col("rmse_macro")))


@query("evaluate_new_users", with_(ROUTE, _EVAL_SELECT))
def q_eval_users(spark, sf):
    return _eval_node_mean(spark, sf)


@query(
    "evaluate_new_items",
    with_(tree_ctes("supp", DEPTH, K, swap=True) + route_ctes(DEPTH), _EVAL_SELECT),
)
def q_eval_items(spark, sf):
    return _eval_node_mean(spark, sf, swap=True)


def _interview_sql(lengths):
    parts = []
    for q in lengths:
        ctes = TREE + [c for c in route_ctes(DEPTH, q)]
        parts.append(with_(ctes, f"SELECT {q} AS questions, ROUND(AVG(rmse), 6) AS rmse, COUNT(*) AS n_users FROM user_rmse"))
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


@query("interview_length_eval", _interview_sql([0, 1, 2, 3]))
def q_interview(spark, sf):
    _, _, test = tree_for(spark, sf)
    out = evaluate.interview_length_eval(_model(spark, sf), test, None, [0, 1, 2, 3])
    return out.withColumn("rmse", r6(F.col("rmse")))


# ---------------------------------------------------- factors (no SQL oracle)

def _als_model(spark, sf, **kw):
    t, train, test = tree_for(spark, sf, **kw)
    key = (_tree_key(spark, sf, **kw), "als")
    if key not in _PSEUDO:
        nf, itf = fit_levels(pseudo_for(spark, sf, **kw), t.levels, rank=10, max_iter=15, reg=0.01, seed=10)
        _PSEUDO[key] = (write_table(nf, "als-nodes"), write_table(itf, "als-items"))
    return _PSEUDO[key]


_LEVEL_SQL = (
    "SELECT level, COUNT(DISTINCT node) AS n_nodes, 10 AS rank, COUNT(DISTINCT item_id) AS n_items FROM pseudo GROUP BY level"
)


def _level_shape(nf, itf):
    a = nf.groupBy("level").agg(F.count(F.lit(1)).alias("n_nodes"), F.max(F.size("features")).alias("rank"))
    return a.join(itf.groupBy("level").agg(F.count(F.lit(1)).alias("n_items")), "level")


@query("fit_levels", with_(TREE, _LEVEL_SQL))
def q_fit_levels(spark, sf):
    return _level_shape(*_als_model(spark, sf))


@query("fit_levels_fixed", with_(TREE, _LEVEL_SQL))
def q_fit_levels_fixed(spark, sf):
    """A value of its own for each level, as found by a former tuning."""
    t, _, _ = tree_for(spark, sf)
    reg = {lv: (0.02, 0.01, 0.05)[lv % 3] for lv in range(t.levels + 1)}
    return _level_shape(*fit_levels(pseudo_for(spark, sf), t.levels, rank=10, max_iter=15, reg=reg, seed=10))


@query(
    "factorize",
    with_(BASE, "SELECT DISTINCT 'user' AS side, user_id AS id, 10 AS rank FROM train UNION ALL SELECT DISTINCT 'item', item_id, 10 FROM train"),
)
def q_factorize(spark, sf):
    from coldsplit.operators.factors import factorize

    train, _ = split_data(spark, sf)
    _, uf, itf = factorize(train, rank=10, max_iter=15, reg=0.01, seed=10)
    return uf.select(F.lit("user").alias("side"), "id", F.size("features").alias("rank")).unionByName(
        itf.select(F.lit("item").alias("side"), "id", F.size("features").alias("rank"))
    )


# grids of their own for the root, the first and the deeper levels
GRIDS = {
    0: (0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 0.2, 0.5, 1.0),
    1: (0.005, 0.01, 0.02, 0.05, 0.1),
}
DEEP_GRID = (0.01, 0.05, 0.1)


def _tuning(spark, sf):
    """Tree and pseudo-users grown without the probe cells; the probe cells of
    training users, which validate; the training cells left."""
    key = (_session(spark), sf, "tuning")
    if key not in _TREES:
        train, _ = split_data(spark, sf)
        probe = fx.probe_pairs(spark, sf, "supp")
        validation = write_table(prepare.probe_extract(train, probe), "validation")
        left = write_table(prepare.probe_remove(train, probe), "tuning-train")
        t = build_tree(left, depth=DEPTH, k=K)
        _TREES[key] = (t, write_table(evaluate.pseudo_users(t), "tuning-pseudo"), validation, left)
    return _TREES[key]


def _tuned(spark, sf):
    key = (_session(spark), sf, "tuned")
    if key not in _PSEUDO:
        t, pseudo, validation, _ = _tuning(spark, sf)
        grids = {lv: GRIDS.get(lv, DEEP_GRID) for lv in range(t.levels + 1)}
        _PSEUDO[key] = tune_levels(pseudo, t.levels, validation, t.assignment, t.node_bound(), grids)[0]
    return _PSEUDO[key]


@query(
    "validation_held_out",
    with_(
        BASE + [fx.PROBE_SQL],
        "SELECT (SELECT COUNT(*) FROM train t JOIN probe p ON t.item_id = p.item_id AND t.user_id = p.user_id) AS n_validation,"
        " (SELECT COUNT(*) FROM train t WHERE NOT EXISTS (SELECT 1 FROM probe p WHERE t.item_id = p.item_id AND t.user_id = p.user_id)) AS n_train, 0 AS n_both",
    ),
)
def q_validation_held_out(spark, sf):
    _, _, validation, left = _tuning(spark, sf)
    both = validation.join(left.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")
    return validation.agg(F.count(F.lit(1)).alias("n_validation")).withColumns(
        {"n_train": F.lit(left.count()), "n_both": F.lit(both.count()).cast("int")}
    )


@query("tune_levels")
def q_tune_levels(spark, sf):
    return _tuned(spark, sf).select("level", "lambda", r6(F.col("rmse")).alias("rmse"), "n", "best")


@query("lambda_curve")
def q_lambda_curve(spark, sf):
    return q_tune_levels(spark, sf).select("level", "lambda", "rmse")


@query("best_lambda")
def q_best_lambda(spark, sf):
    return q_tune_levels(spark, sf).filter("best").select("level", "lambda")


def _eval_als(spark, sf, swap=False):
    _, _, test = tree_for(spark, sf, swap=swap)
    model = _model(spark, sf, swap=swap)
    model.node_factors, model.item_factors = _als_model(spark, sf, swap=swap)
    out = evaluate.evaluate_model(model, test)
    return out.withColumn("rmse_macro", r6(F.col("rmse_macro")))


@query("evaluate_new_users_als")
def q_eval_als(spark, sf):
    return _eval_als(spark, sf)


@query("evaluate_new_items_als")
def q_eval_items_als(spark, sf):
    return _eval_als(spark, sf, swap=True)


@query("sorted_factors", with_(TREE, "SELECT level, node, 10 AS rank, ROW_NUMBER() OVER (ORDER BY level, node) AS place FROM (SELECT DISTINCT level, node FROM pseudo)"))
def q_sorted_factors(spark, sf):
    nf, _ = _als_model(spark, sf)
    ordered = nf.orderBy("level", "node").select("level", "node", F.size("features").alias("rank"))
    # the place of each row in the sorted frame: one row per tree node
    return ordered.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)


# Deterministic substitute factors: embeddings keyed by node / item id.
_EMB = "emb AS (SELECT CAST(vec_id AS INT) AS vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _emb(spark, sf):
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("vec_id"), F.col("embedding").alias("v"))
    return e, e.count()


@query(
    "predict_pairs",
    with_(
        ROUTE + [_EMB, "ne AS (SELECT COUNT(*) AS n FROM emb)"],
        "SELECT p.user_id, p.item_id, ROUND(list_dot_product(a.v, b.v), 6) AS prediction FROM pairs p"
        " JOIN emb a ON a.vec_id = p.node % (SELECT n FROM ne) JOIN emb b ON b.vec_id = p.item_id % (SELECT n FROM ne)",
    ),
)
def q_predict_pairs(spark, sf):
    t, train, test = tree_for(spark, sf)
    emb, n = _emb(spark, sf)
    routed = route_users(t, test)
    pairs = evaluation_pairs(routed, test, prepare.rated_items(train))
    nodes = t.assignment.select("level", "node").distinct()
    node_f = nodes.join(_bcast(emb, n), (F.col("node") % n) == F.col("vec_id")).select("level", "node", F.col("v").alias("features"))
    item_f = (
        prepare.rated_items(train)
        .join(_bcast(emb, n), (F.col("item_id") % n) == F.col("vec_id"))
        .select(F.explode(F.sequence(F.lit(0), F.lit(t.levels))).alias("level"), "item_id", F.col("v").alias("features"))
    )
    preds = predict_pairs(pairs, node_f, item_f, t.node_bound())
    return preds.select("user_id", "item_id", r6(F.col("prediction")).alias("prediction"))


def _substitute_factors(spark, sf, t, train):
    """(level, node) and (level, item) vectors from the embeddings; another one at
    each level."""
    emb, n = _emb(spark, sf)
    nodes = t.nodes().select("level", "node")
    node_f = nodes.join(_bcast(emb, n), ((F.col("node") + 7 * F.col("level")) % n) == F.col("vec_id")).select("level", "node", F.col("v").alias("features"))
    items = prepare.rated_items(train).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(t.levels))))
    item_f = items.join(_bcast(emb, n), ((F.col("item_id") + 3 * F.col("level")) % n) == F.col("vec_id")).select("level", "item_id", F.col("v").alias("features"))
    return node_f, item_f


@query(
    "predict_all_items",
    with_(
        ROUTE
        + [
            _EMB,
            "ne AS (SELECT COUNT(*) AS n FROM emb)",
            "scored AS (SELECT x.level, x.node, i.item_id, ROUND(list_dot_product(a.v, b.v), 6) AS score FROM (SELECT DISTINCT level, node FROM routed) x"
            " JOIN emb a ON a.vec_id = (x.node + 7 * x.level) % (SELECT n FROM ne), (SELECT DISTINCT item_id FROM train) i"
            " JOIN emb b ON b.vec_id = (i.item_id + 3 * x.level) % (SELECT n FROM ne))",
        ],
        "SELECT user_id, CAST(rank AS INT) AS rank, item_id, score FROM (SELECT r.user_id, s.item_id, s.score,"
        " ROW_NUMBER() OVER (PARTITION BY r.user_id ORDER BY s.score DESC, s.item_id) AS rank FROM routed r"
        " JOIN scored s ON s.level = r.level AND s.node = r.node"
        " WHERE NOT EXISTS (SELECT 1 FROM answered a WHERE a.user_id = r.user_id AND a.item_id = s.item_id)) WHERE rank <= 10",
    ),
)
def q_predict_all_items(spark, sf):
    """The ten best items of every test user, from the ranking of their node."""
    t, train, test = tree_for(spark, sf)
    node_f, item_f = _substitute_factors(spark, sf, t, train)
    return predict_all_items(route_users(t, test), node_f, item_f, 10, rank=64)


_GRID_SQL = "grid AS (SELECT * FROM (VALUES " + ", ".join(
    f"({lv}, {place}, CAST({lam} AS DOUBLE))" for lv in range(DEPTH + 1) for place, lam in enumerate(GRIDS.get(lv, DEEP_GRID))
) + ") v(level, place, \"lambda\"))"


@query(
    "grid_rmse",
    with_(
        TREE
        + [
            fx.PROBE_SQL,
            _EMB,
            "ne AS (SELECT COUNT(*) AS n FROM emb)",
            _GRID_SQL,
            "valid AS (SELECT x.level, x.node, t.item_id, t.rating FROM train t JOIN probe p ON t.item_id = p.item_id AND t.user_id = p.user_id"
            " JOIN assignment x ON x.user_id = t.user_id)",
            "curve AS (SELECT c.level, g.place, g.\"lambda\", SQRT(AVG(POW(c.rating - list_dot_product(a.v, b.v), 2))) AS rmse, COUNT(*) AS n FROM valid c"
            " JOIN grid g ON g.level = c.level JOIN emb a ON a.vec_id = (c.node + 7 * c.level + 11 * g.place) % (SELECT n FROM ne)"
            " JOIN emb b ON b.vec_id = (c.item_id + 3 * c.level + 11 * g.place) % (SELECT n FROM ne) GROUP BY c.level, g.place, g.\"lambda\")",
        ],
        "SELECT level, \"lambda\", ROUND(rmse, 6) AS rmse, n, ROW_NUMBER() OVER (PARTITION BY level ORDER BY rmse, place) = 1 AS best FROM curve",
    ),
)
def q_grid_rmse(spark, sf):
    """The choice of a lambda per level with substitute vectors in place of the fits."""
    t, train, _ = tree_for(spark, sf)
    grids = {lv: GRIDS.get(lv, DEEP_GRID) for lv in range(t.levels + 1)}
    validation = prepare.probe_extract(train, fx.probe_pairs(spark, sf, "supp"))
    emb, n = _emb(spark, sf)
    emb = _bcast(emb, n)
    places = F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), F.lit(p).alias("place"), F.lit(lam).alias("lambda")) for lv, g in grids.items() for p, lam in enumerate(g)]))
    node_f = t.nodes().select("level", "node").join(spark.range(1).select(places.alias("g")).select("g.*"), "level")
    node_f = node_f.join(emb, ((F.col("node") + 7 * F.col("level") + 11 * F.col("place")) % n) == F.col("vec_id"))
    item_f = prepare.rated_items(train).select("item_id", places.alias("g")).select("item_id", "g.*")
    item_f = item_f.join(emb, ((F.col("item_id") + 3 * F.col("level") + 11 * F.col("place")) % n) == F.col("vec_id"))
    node_f, item_f = node_f.select("level", "node", "lambda", F.col("v").alias("features")), item_f.select("level", "item_id", "lambda", F.col("v").alias("features"))
    curves = grid_rmse(validation, t.assignment, node_f, item_f, t.node_bound(), rank=64, grid=max(map(len, grids.values())))
    return best_of_grid(write_table(curves, "grid-curves"), grids).withColumn("rmse", r6(F.col("rmse")))


@query(
    "dot_product",
    with_(
        [_EMB, "ne AS (SELECT COUNT(*) AS n FROM emb)"],
        "SELECT a.vec_id, ROUND(list_dot_product(a.v, b.v), 6) AS dot FROM emb a JOIN emb b ON b.vec_id = (a.vec_id + 1) % (SELECT n FROM ne)",
    ),
)
def q_dot(spark, sf):
    emb, n = _emb(spark, sf)
    b = emb.select(F.col("vec_id").alias("b_id"), F.col("v").alias("w"))
    return emb.join(b, ((emb.vec_id + 1) % n) == b.b_id).select("vec_id", r6(dot_product("v", "w")).alias("dot"))


# ---------------------------------------------------------- baseline (2.8)

def _baseline(spark, sf):
    r = fx.ratings(spark, sf, "supp")
    return als_baseline(r, seed=42, max_iter=5, reg=0.01)


@query("als_baseline")
def q_als_baseline(spark, sf):
    model, preds = _baseline(spark, sf)
    return preds.select("user_id", "item_id", "rating", r6(F.col("prediction")).alias("prediction"))


@query("regression_rmse")
def q_regression_rmse(spark, sf):
    from coldsplit.operators.recommend import regression_rmse

    model, preds = _baseline(spark, sf)
    preds = write_table(preds.select("user_id", "item_id", F.col("rating").cast("double").alias("rating"), "prediction"), "baseline-preds")
    evaluator = regression_rmse(preds)  # RegressionEvaluator: one scalar to the driver
    return stats.rmse_micro(preds).select(
        r6(F.col("rmse")).alias("rmse"), "n", F.lit(round(evaluator, 6)).alias("evaluator_rmse")
    )


@query("recommend_items_als")
def q_recommend_items_als(spark, sf):
    model, _ = _baseline(spark, sf)
    return recommend_items(model, 10).select("user_id", "rank", "item_id")


@query("recommend_users_als")
def q_recommend_users_als(spark, sf):
    model, _ = _baseline(spark, sf)
    return recommend_users(model, 10).select("item_id", "rank", "user_id")


# Vectors of all users and items of the ratings: embeddings, longer for some ids
# than for others, as popular items have longer factors. Whole numbers, so that
# sums are exact in both engines.
_VECTORS_SQL = [
    _EMB,
    "ne AS (SELECT COUNT(*) AS n FROM emb)",
    "whole AS (SELECT vec_id, list_transform(v, lambda x: CAST(round(x * 1000) AS DOUBLE)) AS v FROM emb)",
    "us AS (SELECT u.user_id, w.v FROM (SELECT DISTINCT user_id FROM ratings) u JOIN whole w ON w.vec_id = u.user_id % (SELECT n FROM ne))",
    "its AS (SELECT i.item_id, list_transform(w.v, lambda x: x * (1 + i.item_id % 13)) AS v FROM (SELECT DISTINCT item_id FROM ratings) i"
    " JOIN whole w ON w.vec_id = i.item_id % (SELECT n FROM ne))",
    "pairs AS (SELECT us.user_id, its.item_id, CAST(list_dot_product(us.v, its.v) AS BIGINT) AS score FROM us, its)",
]


def _rating_vectors(spark, sf):
    emb, n = _emb(spark, sf)
    whole = emb.select("vec_id", F.transform("v", lambda x: F.round(x.cast("double") * 1000)).alias("w"))
    r = kept_ratings(spark, sf)

    def vectors(name, longer):
        ids = r.select(name).distinct()
        return ids.join(_bcast(whole, n), (F.col(name) % n) == F.col("vec_id")).select(name, F.transform("w", lambda x: x * longer).alias("features"))

    return vectors("user_id", F.lit(1.0)), vectors("item_id", (1 + F.col("item_id") % 13).cast("double"))


def _best_sql(key: str, other: str) -> str:
    return with_(
        SUPP + _VECTORS_SQL,
        f"SELECT {key}, CAST(rank AS INT) AS rank, {other}, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY score DESC, {other}) AS rank FROM pairs) WHERE rank <= 10",
    )


@query("recommend_items", _best_sql("user_id", "item_id"))
def q_recommend_items(spark, sf):
    """The ten best items of every user by inner product, on substitute factors."""
    users, items = _rating_vectors(spark, sf)
    return top_products(users, items, 10).withColumn("score", F.col("score").cast("long"))


@query("recommend_users", _best_sql("item_id", "user_id"))
def q_recommend_users(spark, sf):
    users, items = _rating_vectors(spark, sf)
    return top_products(items, users, 10).withColumn("score", F.col("score").cast("long"))


@query(
    "random_split",
    with_(
        SUPP,
        "SELECT CASE WHEN CAST(('0x' || substr(md5('7:' || user_id || ':' || item_id), 1, 8)) AS BIGINT) / 4294967296.0 < 0.8 THEN 'train' ELSE 'test' END AS part,"
        " user_id, item_id FROM ratings",
    ),
)
def q_random_split(spark, sf):
    r = fx.ratings(spark, sf, "supp")
    a, b = prepare.random_split(r, (0.8, 0.2), seed=7)
    return a.select(F.lit("train").alias("part"), "user_id", "item_id").unionByName(
        b.select(F.lit("test").alias("part"), "user_id", "item_id")
    )


def _saved_model(spark, sf):
    model = _model(spark, sf)
    model.node_factors, model.item_factors = _als_model(spark, sf)
    path = scratch_path(spark, "model")
    evaluate.save_model(model, path)
    return evaluate.load_model(spark, path)


@query("save_model", with_(TREE, _LEVEL_SQL))
def q_save_model(spark, sf):
    back = _saved_model(spark, sf)
    return _level_shape(back.node_factors, back.item_factors)


@query("load_model", with_(ROUTE, "SELECT user_id, item_id, level, node FROM pairs"))
def q_load_model(spark, sf):
    """Routing and scoring on the model that came back from disk."""
    _, _, test = tree_for(spark, sf)
    preds = evaluate.score(_saved_model(spark, sf), test)
    return preds.filter("prediction is not null").select("user_id", "item_id", "level", "node")


def _lookup(pairs, node_f, item_f, n_nodes):
    """Pairs with the vectors of their node and item. They travel thin: the item's
    vector is met first, the node's where that one is."""
    j = salted_join(pairs, item_f, ["level", "item_id"], ["user_id"])
    return j.join(_bcast(node_f, n_nodes), ["level", "node"])


@query(
    "factor_lookup",
    with_(
        ROUTE + [_EMB, "ne AS (SELECT COUNT(*) AS n FROM emb)"],
        "SELECT p.user_id, p.item_id, p.level, p.node, len(a.v) AS rank_u, len(b.v) AS rank_v FROM pairs p"
        " JOIN emb a ON a.vec_id = p.node % (SELECT n FROM ne) JOIN emb b ON b.vec_id = p.item_id % (SELECT n FROM ne)",
    ),
)
def q_factor_lookup(spark, sf):
    t, train, test = tree_for(spark, sf)
    emb, n = _emb(spark, sf)
    pairs = evaluation_pairs(route_users(t, test), test, prepare.rated_items(train))
    nodes = t.assignment.select("level", "node").distinct()
    node_f = nodes.join(_bcast(emb, n), (F.col("node") % n) == F.col("vec_id")).select("level", "node", F.col("v").alias("u"))
    item_f = (
        prepare.rated_items(train)
        .join(_bcast(emb, n), (F.col("item_id") % n) == F.col("vec_id"))
        .select(F.explode(F.sequence(F.lit(0), F.lit(t.levels))).alias("level"), "item_id", F.col("v").alias("w"))
    )
    j = _lookup(pairs, node_f, item_f, t.node_bound())
    return j.select("user_id", "item_id", "level", "node", F.size("u").alias("rank_u"), F.size("w").alias("rank_v"))
