"""Routing unseen users down the interview tree and scoring them.

Routing is stateless per user. The answers a user can give are the ratings of
split items only, so they are gathered once per user into a small map (at most
one entry per distinct split item). The walk is then one broadcast join per
level against that level's split table and node set, both bounded by the
number of tree nodes; no per-level shuffle of the ratings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coldsplit.functions import LIKE, DISLIKE, UNKNOWN, attitude_branch, attitude_letter, dot_product
from coldsplit.operators.skew import salted_join
from coldsplit.operators.tree import InterviewTree
from coldsplit.session import bounded_broadcast as _bcast
from coldsplit.session import write_table

ASKED_TYPE = "array<struct<item_id:int,attitude:string>>"


def split_answers(tree: InterviewTree, ratings: DataFrame) -> DataFrame:
    """(user_id, answers map<int,double>) for every user in ``ratings``."""
    split_items = tree.splits.select("item_id").distinct()
    n_items = tree.split_bound()  # distinct split items <= splits
    rated = ratings.join(_bcast(split_items, n_items), "item_id")
    answers = rated.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("item_id", "rating"))).alias("answers")
    )
    users = ratings.select("user_id").distinct()
    return users.join(answers, "user_id", "left").select(
        "user_id",
        F.coalesce(F.col("answers"), F.create_map().cast("map<int,double>")).alias("answers"),
    )


def route_users(
    tree: InterviewTree, ratings: DataFrame, max_questions: int | None = None
) -> DataFrame:
    """Walk every user of ``ratings`` down the tree on their own answers.

    Returns (user_id, level, node, asked, trace):
      asked  questions whose answer moved the user down, with attitude L/D/U;
      trace  every answer given, including the one after which the child was
             empty and the descent stopped.
    A user stops where the node has no question or the child has no training
    users.
    """
    return route_answers(tree, split_answers(tree, ratings), max_questions)


def route_answers(tree: InterviewTree, answers: DataFrame, max_questions: int | None = None) -> DataFrame:
    """Walk users given as (user_id, answers map<int,double>) down the tree.

    Only static, node-bounded tables are joined (broadcast), so ``answers``
    may also be a streaming DataFrame (one row per user).
    """
    state = answers.select(
        "user_id",
        "answers",
        F.lit(0).alias("level"),
        F.lit(0).alias("node"),
        F.lit(True).alias("alive"),
        F.array().cast(ASKED_TYPE).alias("asked"),
        F.array().cast("array<string>").alias("trace"),
    )
    levels = tree.levels if max_questions is None else min(tree.levels, max_questions)
    nodes = tree.nodes()
    for level in range(levels):
        sp = tree.splits.filter(F.col("level") == level).select(
            F.col("node").alias("q_node"), F.col("item_id").alias("q_item")
        )
        n_sp = tree.split_bound(level)
        nxt = nodes.filter(F.col("level") == level + 1).select(
            F.col("node").alias("c_node"), F.lit(True).alias("c_exists")
        )
        n_nxt = 3 * tree.split_bound(level)  # children of this level's splits
        here = F.col("alive") & (F.col("level") == level)
        s = state.join(_bcast(sp, n_sp), (F.col("node") == F.col("q_node")) & here, "left")
        ans = F.try_element_at(F.col("answers"), F.col("q_item"))
        s = s.withColumn("branch", attitude_branch(ans)).withColumn(
            "child", F.col("node") * 3 + F.col("branch")
        )
        s = s.join(_bcast(nxt, n_nxt), F.col("child") == F.col("c_node"), "left")
        asked_now = F.col("q_item").isNotNull()
        moves = asked_now & F.col("c_exists").isNotNull()
        entry = F.struct(F.col("q_item").alias("item_id"), attitude_letter(F.col("branch")).alias("attitude"))
        state = s.select(
            "user_id",
            "answers",
            F.when(moves, F.lit(level + 1)).otherwise(F.col("level")).alias("level"),
            F.when(moves, F.col("child")).otherwise(F.col("node")).cast("int").alias("node"),
            (F.col("alive") & moves).alias("alive"),
            F.when(moves, F.concat(F.col("asked"), F.array(entry))).otherwise(F.col("asked")).alias("asked"),
            F.when(asked_now, F.concat(F.col("trace"), F.array(attitude_letter(F.col("branch")))))
            .otherwise(F.col("trace"))
            .alias("trace"),
        )
    return state.select("user_id", "level", "node", "asked", "trace")


def attitude_trace(routed: DataFrame) -> DataFrame:
    return routed.select("user_id", F.array_join("trace", "").alias("trace"))


def answered_items(routed: DataFrame) -> DataFrame:
    """(user_id, item_id) asked-and-answered (like/dislike) on the way down."""
    return (
        routed.select("user_id", F.explode("asked").alias("a"))
        .filter(F.col("a.attitude") != "U")
        .select("user_id", F.col("a.item_id").alias("item_id"))
    )


def evaluation_pairs(routed: DataFrame, ratings: DataFrame, known_items: DataFrame) -> DataFrame:
    """Test cells to score: known items only, minus the asked-and-answered ones."""
    known = salted_join(ratings, known_items.select("item_id").distinct(), ["item_id"], ["user_id"], "left_semi")
    unasked = known.join(answered_items(routed), ["user_id", "item_id"], "left_anti")
    # one routed row per user; a heavy test user is spread by item
    return salted_join(unasked, routed.select("user_id", "level", "node"), ["user_id"], ["item_id"])


def predict_node_mean(pairs: DataFrame, pseudo: DataFrame) -> DataFrame:
    """Prediction = pseudo-user rating of the final node, else the item's
    root mean (always present for a known item)."""
    node = pseudo.select("level", "node", "item_id", F.col("rating").alias("node_mean"))
    root = pseudo.filter(F.col("level") == 0).select("item_id", F.col("rating").alias("root_mean"))
    # one pseudo row per key; a hot item is spread by user
    j = salted_join(pairs, node, ["level", "node", "item_id"], ["user_id"], "left")
    j = salted_join(j, root, ["item_id"], ["user_id"], "left")
    return j.withColumn("prediction", F.coalesce("node_mean", "root_mean")).drop("node_mean", "root_mean")


def item_levels(item_factors: DataFrame) -> DataFrame:
    """(level, item_id, at, v): for each item and level the deepest level ``at`` at or
    above it that has the item, and its vector there."""
    levels = item_factors.select("item_id", "level")
    deepest = levels.agg(F.max("level")).first()[0] or 0
    have = levels.groupBy("item_id").agg(F.collect_set("level").alias("have"))  # one entry a level
    best = have.select("item_id", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("level"), "have").select(
        "item_id", "level", F.array_max(F.filter("have", lambda x: x <= F.col("level"))).alias("at")
    )
    return best.filter("at is not null").join(
        item_factors.select("item_id", F.col("level").alias("at"), F.col("features").alias("v")), ["item_id", "at"]
    )


def _ancestor(node, level, at):
    return F.floor(node / F.pow(F.lit(3.0), level - at)).cast("int")


def predict_pairs(pairs: DataFrame, node_factors: DataFrame, item_factors: DataFrame, n_nodes: int, rank: int = 10) -> DataFrame:
    """Score (user, item) pairs with the factors of the user's own node, or where
    the item has none at that level (users of a leaf leave the loop, so an item
    may be rated above only), of the nearest ancestor whose level has the item.
    An item of the root is known, so no pair is lost."""
    j = salted_join(pairs, item_levels(item_factors), ["level", "item_id"], ["user_id"], array_items=rank)
    return _with_node_vector(j, node_factors, n_nodes, rank).withColumn("prediction", dot_product("u", "v")).drop("u", "v", "at", "at_node")


def _with_node_vector(rows: DataFrame, node_factors: DataFrame, n_nodes: int, rank: int) -> DataFrame:
    """Adds ``u``: the vector of the node's ancestor at level ``at``."""
    nf = _bcast(node_factors.select(F.col("level").alias("at"), F.col("node").alias("at_node"), F.col("features").alias("u")), n_nodes, rank)
    return rows.withColumn("at_node", _ancestor(F.col("node"), F.col("level"), F.col("at"))).join(nf, ["at", "at_node"])


NODE_BYTES = 64 << 20  # node vectors sent to the executors at a time
SCORE_DIGITS = 6  # scores are ranked after rounding; equal ones go by item id


def node_rankings(nodes: DataFrame, node_factors: DataFrame, item_factors: DataFrame, length: int, rank: int = 10, node_bytes: int = NODE_BYTES) -> DataFrame:
    """(level, node, ranking array<struct<item_id, score>>): the ``length`` best items of
    each of ``nodes`` (level, node), best first.

    All users of a node share its vector, so an item is scored once a node. The
    nodes, each with the vectors of its ancestors, are broadcast to the items in
    blocks of ``node_bytes``; a partial top-k runs before the one shuffle by node."""
    nodes = write_table(nodes.select("level", "node").distinct(), "ranked-nodes")
    n_nodes, deepest = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max("level"), F.lit(0))).first()
    items = write_table(item_levels(item_factors), "item-levels")
    blocks = max(1, -(-n_nodes * (deepest + 1) * (8 * rank + 64) // node_bytes))
    above = nodes.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("level"))))
    above = above.withColumn("at_node", _ancestor(F.col("node"), F.col("level"), F.col("at"))).join(
        node_factors.select(F.col("level").alias("at"), F.col("node").alias("at_node"), F.col("features").alias("u")), ["at", "at_node"]
    )
    above = write_table(above.select("level", "node", "at", "u"), "node-vectors")
    best = Window.partitionBy("level", "node").orderBy(F.desc("score"), "item_id")
    out = None
    for block in range(blocks):
        mine = above.filter(F.pmod(F.xxhash64("level", "node"), F.lit(blocks)) == block) if blocks > 1 else above
        # a block has at most about node_bytes: counted above
        scored = items.join(F.broadcast(mine), ["level", "at"]).select("level", "node", "item_id", F.round(dot_product("u", "v"), SCORE_DIGITS).alias("score"))
        top = scored.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= length)
        out = top if out is None else out.unionByName(top)
    lists = out.groupBy("level", "node").agg(F.sort_array(F.collect_list(F.struct("place", "item_id", "score"))).alias("r"))  # ``length`` entries
    return lists.select("level", "node", F.transform("r", lambda x: F.struct(x["item_id"].alias("item_id"), x["score"].alias("score"))).alias("ranking"))


def predict_all_items(routed: DataFrame, node_factors: DataFrame, item_factors: DataFrame, n: int = 10, rank: int = 10, node_bytes: int = NODE_BYTES) -> DataFrame:
    """(user_id, rank, item_id, score): for each routed user the ``n`` best of all known
    items, but for those the user was asked about and answered.

    No user is scored against the items: a user takes the first n entries of the
    ranking of their node that they did not answer. They answered at most one item
    a level, so rankings of n + depth entries hold enough. Users of one node are
    spread over tasks however many they are."""
    routed = write_table(routed.select("user_id", "level", "node", F.transform(F.filter("asked", lambda a: a["attitude"] != "U"), lambda a: a["item_id"]).alias("answered")), "routed")
    most = routed.agg(F.coalesce(F.max(F.size("answered")), F.lit(0))).first()[0]
    lists = write_table(node_rankings(routed, node_factors, item_factors, n + most, rank, node_bytes), "rankings")
    rows = salted_join(routed, lists, ["level", "node"], ["user_id"], array_items=n + most)
    kept = F.slice(F.filter("ranking", lambda x: ~F.array_contains("answered", x["item_id"])), 1, n)
    return rows.select("user_id", F.posexplode(kept).alias("place", "x")).select("user_id", (F.col("place") + 1).alias("rank"), "x.item_id", "x.score")


__all__ = [
    "LIKE",
    "DISLIKE",
    "UNKNOWN",
    "answered_items",
    "attitude_trace",
    "evaluation_pairs",
    "node_rankings",
    "predict_all_items",
    "predict_node_mean",
    "predict_pairs",
    "route_users",
    "split_answers",
]
