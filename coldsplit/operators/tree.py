"""Breadth-first growth of the ternary interview tree.

One driver iteration per level; every node of the level is split in the same
Spark jobs. Only the per-level split table (at most one row per node) and a
few counts reach the driver.

Data layout (the reason the level loop shuffles little):

* ``E``  one row per ``(user_id, salt)``: the user's items, ratings, residuals,
  and the ids of liked and of disliked items as arrays, bucketed by ``(user_id,
  salt)`` and written once. ``salt`` spreads the ratings of a heavy user over
  ``nsalt`` rows (``nsalt = ceil(n_ratings / salt_rows)``, 1 for ordinary users),
  so no array outgrows ``salt_rows`` and a user holding a third of all rows is
  still cut into bounded tasks.
* ``A``  salted assignment ``(user_id, salt, node)``: one row per user and
  salt, bucketed like ``E``. ``E JOIN A`` is a shuffle-free join every level.

A level reads the ratings once: a row's liked and disliked items are intersected
with the candidates of its node, and each hit meets the row's own items, so the
co-rating join needs no second scan and no shuffle but for the rows of heavy
users. Item totals of the children come from the totals of the parent and the
sums of the chosen candidate (unknown = parent - like - dislike); the answers
that move users down read the two id columns only.

Sums are order-free: residuals and gains are whole multiples of ``1 / SCALE``,
added as integers, so a split does not depend on partitions or retries.

Split score (sparse form). For node t with per-item totals ``ts_i, tn_i`` and
for a candidate c that splits the raters of c into like/dislike groups with
sums ``sL, nL, sD, nD`` (unknown by subtraction):

    error(c) = base(t) - gain(c)
    base(t)  = sum_i s2_i - ts_i^2 / (tn_i + eps)
    gain(c)  = sum_{i co-rated with c}  sL^2/(nL+eps) + sD^2/(nD+eps)
               + sU^2/(nU+eps) - ts_i^2/(tn_i+eps)

so only (candidate, item) pairs co-rated inside the node are materialised.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coldsplit.functions import DISLIKE, LIKE, UNKNOWN, attitude_branch
from coldsplit.session import (
    Scratch,
    bounded_broadcast,
    bucket_count,
    ensure_checkpoint_dir,
    materialize,
    scratch_tables,
    session_conf,
    drop_scratch_tables,
    write_table,
    write_bucketed,
)

EPS = 1e-9  # fixed value: denominator guard of the split error
SCALE = 2.0**40  # residuals, squares and gains are summed as whole multiples of 1 / SCALE
LONG_MAX = 2**62
GAIN_FORMAT = "%.8e"  # ties of the split score are broken after rounding to 9 significant digits
DEFAULT_SALT_ROWS = 200_000
SPLIT_SCHEMA = "level int, node int, item_id int, error double, gain double, n_users bigint, popularity bigint"


@dataclass
class InterviewTree:
    """Result of :func:`build_tree`. All members are checkpointed DataFrames."""

    splits: DataFrame  # level, node, item_id, error, gain, n_users, popularity
    assignment: DataFrame  # level, node, user_id
    bias: DataFrame  # user_id, bias, n, nsalt
    user_rows: DataFrame  # user_id, salt, nsalt, bias, items, ratings, residuals, square, likes, dislikes
    salted_assignment: DataFrame  # level, user_id, salt, node
    salted_by_level: list  # per level: bucketed (user_id, salt, node)
    mean: float
    levels: int  # number of split levels built (deepest node level)
    params: dict = field(default_factory=dict)
    split_counts: list = field(default_factory=list)  # splits per level (row bounds)
    node_table: DataFrame | None = None  # level, node, n_users: written when first asked for
    tables: set = field(default_factory=set)  # scratch tables behind the frames above
    buckets: int = 0  # of user_rows and salted_assignment (0: read from elsewhere)

    @property
    def residuals(self) -> DataFrame:
        """(user_id, salt, item_id, rating, e, nsalt): one row per rating."""
        return rating_rows(self.user_rows).select("user_id", "salt", "item_id", "rating", "e", "nsalt")

    def nodes(self) -> DataFrame:
        """(level, node, n_users): one row per node that has training users."""
        if self.node_table is None:
            sizes = self.assignment.groupBy("level", "node").agg(F.count(F.lit(1)).alias("n_users"))
            self.node_table = write_table(sizes, "tree-nodes")
        return self.node_table

    def release(self) -> None:
        """Drop the scratch tables and their files. Splits, and the node table if it
        was asked for, stay; the other frames can't be read any more."""
        drop_scratch_tables(self.splits.sparkSession, self.tables)
        self.tables = set()

    def node_bound(self) -> int:
        """Nodes of all levels: the root plus three children per split."""
        return 1 + 3 * self.split_bound()

    def split_bound(self, level: int | None = None) -> int:
        """Rows of the split table of ``level`` (all levels if None)."""
        if not self.split_counts:
            return self.splits.count()
        return sum(self.split_counts) if level is None else self.split_counts[level]

    def node_levels(self) -> list[int]:
        return list(range(self.levels + 1))


_bcast = bounded_broadcast


def prepare_residuals(ratings: DataFrame, lam: float = 7.0, salt_rows: int = DEFAULT_SALT_ROWS):
    """(user rows, bias, mean, buckets): see :func:`_prepare`."""
    return _prepare(ratings, lam, salt_rows)[:4]


def _prepare(ratings: DataFrame, lam: float, salt_rows: int):
    """Bias per user and salted residuals, materialised once.

    One pass over the source builds the per-user sums (partial aggregation,
    so a heavy user costs nothing extra); the global mean comes from that
    small table. The residual join keys on (user_id, salt): heavy users (at
    most rows / salt_rows of them, counted before any broadcast) get their
    salt from a broadcast lookup, every other user has salt 0, so even a user
    holding a third of the rows is spread over many tasks.
    """
    spark = ratings.sparkSession
    ensure_checkpoint_dir(spark)
    r = ratings.select(
        F.col("user_id").cast("int").alias("user_id"),
        F.col("item_id").cast("int").alias("item_id"),
        F.col("rating").cast("double").alias("rating"),
    ).filter(F.col("rating") != 0)
    # the source is scanned twice (per-user sums, then the salted residuals): pass
    # a table, not a plan that is dear to repeat
    per_user = materialize(
        r.groupBy("user_id").agg(F.sum("rating").alias("s"), F.count(F.lit(1)).alias("n"), F.max(F.abs("rating")).alias("most"))
    )
    # one small job: global mean and the number of heavy users (the bound
    # that decides whether their salt table may be broadcast)
    tot = per_user.agg(
        F.sum("s"), F.sum("n"), F.count_if(F.col("n") > F.lit(salt_rows)), F.max("most"), F.max("n")
    ).first()
    if not tot[1]:
        raise ValueError("no ratings")
    mean = tot[0] / tot[1]
    n_heavy = tot[2]
    p = bucket_count(spark, tot[1])
    bias = per_user.select(
        "user_id",
        ((F.col("s") + F.lit(lam * mean)) / (F.lit(lam) + F.col("n"))).alias("bias"),
        "n",
        F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(salt_rows))).cast("int").alias("nsalt"),
    )
    heavy = bias.filter(F.col("nsalt") > 1).select("user_id", F.col("nsalt").alias("hs"))
    salted_r = r.join(_bcast(heavy, n_heavy), "user_id", "left").select(
        "user_id",
        F.pmod(F.xxhash64("item_id"), F.coalesce(F.col("hs"), F.lit(1))).cast("int").alias("salt"),
        F.struct("item_id", "rating").alias("cell"),
    )
    bias_salted = bias.select(
        "user_id", "bias", "nsalt", F.explode(F.sequence(F.lit(0), F.col("nsalt") - 1)).alias("salt")
    )
    # no residual exceeds twice the largest rating: longs where every square is exact as a
    # double and no sum of a user's squares overflows
    square = (2 * tot[3]) ** 2 * SCALE
    kind = "long" if square < 2**53 and square * tot[4] < LONG_MAX else "decimal(38,0)"
    # at most about salt_rows cells in an array
    rows = salted_r.groupBy("user_id", "salt").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    whole = F.transform("cells", lambda c: F.round((c["rating"] - F.col("bias")) * SCALE).cast("long"))
    e = rows.join(bias_salted.hint("shuffle_hash"), ["user_id", "salt"]).select("user_id", "salt", "nsalt", "bias", "cells", whole.alias("residuals")).select(
        "user_id",
        "salt",
        "nsalt",
        "bias",
        F.transform("cells", lambda c: c["item_id"]).alias("items"),
        F.transform("cells", lambda c: c["rating"]).alias("ratings"),
        "residuals",
        F.aggregate("residuals", F.lit(0).cast(kind), lambda t, x: (t + F.round(_real(x) * _real(x) * F.lit(SCALE)).cast(kind)).cast(kind)).cast("decimal(38,0)").alias("square"),
        *[
            F.transform(F.filter("cells", lambda c: attitude_branch(c["rating"]) == branch), lambda c: c["item_id"]).alias(name)
            for branch, name in ((LIKE, "likes"), (DISLIKE, "dislikes"))
        ],
    )
    # the shuffle that gathers the cells deals the buckets too: the rows move once
    one = {"spark__sql__shuffle__partitions": str(p), "spark__sql__adaptive__coalescePartitions__enabled": "false"}
    with session_conf(spark, **one):
        e = write_bucketed(e, "residuals", ["user_id", "salt"], p, dealt=True)
    return e, bias, mean, p, n_heavy > 0, tot[3]


def _whole(x):
    """A double as a whole multiple of 1 / SCALE: sums of these are exact."""
    return F.round(x * F.lit(SCALE)).cast("decimal(38,0)")


def _real(x):
    return x.cast("double") / F.lit(SCALE)


def rating_rows(rows: DataFrame) -> DataFrame:
    """One row per rating of ``rows`` (user rows, maybe with a node): item_id, rating,
    e, and the residual as a whole number ``q``."""
    keep = [c for c in rows.columns if c in ("user_id", "salt", "nsalt", "node", "level")]
    cells = rows.select(*keep, "bias", F.explode(F.arrays_zip("items", "ratings", "residuals")).alias("c"))
    return cells.select(
        *keep,
        F.col("c.items").alias("item_id"),
        F.col("c.ratings").alias("rating"),
        (F.col("c.ratings") - F.col("bias")).alias("e"),
        F.col("c.residuals").alias("q"),
    )


def _salted_root(bias: DataFrame, p: int) -> DataFrame:
    return (
        bias.select(
            "user_id",
            F.explode(F.sequence(F.lit(0), F.col("nsalt") - 1)).alias("salt"),
            F.lit(0).alias("node"),
        )
    )


def _long_sum(q):
    """The exact sum of longs: the upper and the lower halves are summed as longs, which
    2^30 rows can't overflow, and meet as decimals."""
    high, low = F.sum(F.shiftright(q, 30)), F.sum(q.bitwiseAND(F.lit(2**30 - 1)))
    return (high.cast("decimal(20,0)") * F.lit(2**30).cast("decimal(10,0)") + low.cast("decimal(20,0)")).cast("decimal(38,0)")


def node_item_totals(ea: DataFrame, squares: bool = True) -> DataFrame:
    """(node, item_id, ts, s2, tn) over the residuals of the node's users; sums whole.
    ``squares=False`` leaves out s2, which only the base over candidates needs."""
    s2 = [F.sum(_whole(_real(F.col("q")) * _real(F.col("q")))).cast("decimal(38,0)").alias("s2")] if squares else []
    return ea.groupBy("node", "item_id").agg(_long_sum(F.col("q")).alias("ts"), *s2, F.count(F.lit(1)).alias("tn"))


def child_totals(totals: DataFrame, sums: DataFrame, splits: DataFrame, n_splits: int) -> DataFrame:
    """Totals (node, item_id, ts, tn) of the children of the split nodes, without reading
    a rating: like and dislike are the sums of the chosen candidate, unknown is what
    they leave of the parent."""
    s = _bcast(splits.select("node", F.col("item_id").alias("cand")), n_splits)
    chosen = sums.join(s, ["node", "cand"]).drop("cand")
    j = totals.select("node", "item_id", "ts", "tn").join(_bcast(splits.select("node"), n_splits), "node", "left_semi").join(chosen, ["node", "item_id"], "left")
    sl, nl, sd, nd = (F.coalesce(F.col(c), F.lit(0).cast(t)) for c, t in (("sL", "decimal(38,0)"), ("nL", "long"), ("sD", "decimal(38,0)"), ("nD", "long")))
    parts = [(LIKE, sl, nl), (DISLIKE, sd, nd), (UNKNOWN, F.col("ts") - sl - sd, F.col("tn") - nl - nd)]
    child = F.explode(F.array(*[F.struct((F.col("node") * 3 + b).cast("int").alias("node"), ts.cast("decimal(38,0)").alias("ts"), tn.alias("tn")) for b, ts, tn in parts]))
    return j.select("item_id", child.alias("c")).select("c.node", "item_id", "c.ts", "c.tn").filter("tn > 0")


def topk_candidates(totals: DataFrame, k: int, order: str = "most") -> DataFrame:
    """K most (or least) rated items per node; ties by item id.

    Catalyst plans the ``row_number <= k`` filter as a WindowGroupLimit, so
    each map task keeps only k rows per node before the shuffle.
    """
    pop = F.col("tn").desc() if order == "most" else F.col("tn").asc()
    w = Window.partitionBy("node").orderBy(pop, F.col("item_id").asc())
    return (
        totals.select("node", "item_id", "tn")
        .withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= k)
        .select("node", "item_id", F.col("tn").alias("popularity"))
    )


def exclude_chosen(cands: DataFrame, paths: DataFrame | None) -> DataFrame:
    """Drop candidates already asked on the node's path (after the top-K cut)."""
    if paths is None:
        return cands
    return cands.join(paths, ["node", "item_id"], "left_anti")


def branch_sums(rows: DataFrame, cands: DataFrame, n_nodes: int, k: int, score_items: str = "all", heavy: bool = True, wide: bool = True) -> DataFrame:
    """Per (node, cand, item): whole sums and counts of the co-raters that like or
    dislike the candidate.

    The one heavy step: every rating of every user in the node who rated the
    candidate. A row finds its own hits among the candidates of its node (at most K,
    broadcast), and pairs them with its own items. Only hits of heavy users
    (``heavy``) go by shuffle to the user's other rows. ``wide`` sums decimals, where
    the ratings of an item are too many for long sums.
    """
    lists = cands.groupBy("node").agg(F.sort_array(F.collect_list("item_id")).alias("cands"))  # K items
    r = rows.join(_bcast(lists, n_nodes, k), "node")

    def hits(name, branch):
        return F.transform(F.array_intersect(name, "cands"), lambda x: F.struct(x.alias("cand"), F.lit(branch).alias("branch")))

    cells = F.arrays_zip("items", "residuals")
    if score_items == "candidates":
        cells = F.filter(cells, lambda c: F.array_contains("cands", c["items"]))
    r = r.select("user_id", "salt", "nsalt", "node", cells.alias("cells"), F.concat(hits("likes", LIKE), hits("dislikes", DISLIKE)).alias("hits"))
    own = (r.filter("nsalt = 1") if heavy else r).filter("size(hits) > 0").select("node", "cells", F.explode("hits").alias("h"))
    own = own.select("node", "h.cand", "h.branch", "cells")
    if heavy:
        many = r.filter("nsalt > 1")
        asked = many.select("user_id", "node", "nsalt", F.explode("hits").alias("h")).select(
            "user_id", "node", "h.cand", "h.branch", F.explode(F.sequence(F.lit(0), F.col("nsalt") - 1)).alias("salt")
        )
        met = asked.hint("shuffle_hash").join(many.select("user_id", "salt", "cells"), ["user_id", "salt"])
        own = own.unionByName(met.select("node", "cand", "branch", "cells"))
    pairs = own.select("node", "cand", "branch", F.explode("cells").alias("c")).select(
        "node", "cand", "branch", F.col("c.items").alias("item_id"), F.col("c.residuals").alias("q")
    )
    like, dis = F.col("branch") == LIKE, F.col("branch") == DISLIKE
    q = F.col("q").cast("decimal(18,0)") if wide else F.col("q")
    zero = F.lit(0).cast("decimal(18,0)") if wide else F.lit(0).cast("long")
    return pairs.groupBy("node", "cand", "item_id").agg(
        F.sum(F.when(like, q).otherwise(zero)).cast("decimal(38,0)").alias("sL"),
        F.count_if(like).alias("nL"),
        F.sum(F.when(dis, q).otherwise(zero)).cast("decimal(38,0)").alias("sD"),
        F.count_if(dis).alias("nD"),
    )


def branch_stats(sums: DataFrame) -> DataFrame:
    """:func:`branch_sums` in the unit of the ratings."""
    return sums.withColumns({"sL": _real(F.col("sL")), "sD": _real(F.col("sD"))})


def _square(s, n):
    return _real(s) * _real(s) / (n + F.lit(EPS))


def node_base(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """(node, base): the squares of the users' residuals less what the items' means
    explain, as a whole number."""
    squares = rows.groupBy("node").agg(F.sum("square").cast("decimal(38,0)").alias("s2"))
    means = totals.groupBy("node").agg(F.sum(_whole(_square(F.col("ts"), F.col("tn")))).cast("decimal(38,0)").alias("explained"))
    return squares.join(means, "node").select("node", (F.col("s2") - F.col("explained")).cast("decimal(38,0)").alias("base"))


def candidate_base(totals: DataFrame, cands: DataFrame, cand_bound: int) -> DataFrame:
    """(node, base) over the candidate items only; ``totals`` with ``s2``."""
    own = totals.join(_bcast(cands.select("node", "item_id"), cand_bound), ["node", "item_id"], "left_semi")
    return own.groupBy("node").agg(F.sum((F.col("s2") - _whole(_square(F.col("ts"), F.col("tn")))).cast("decimal(38,0)")).cast("decimal(38,0)").alias("base"))


def split_gain(sums: DataFrame, totals: DataFrame, totals_rows: int | None = None) -> DataFrame:
    """gain(node, cand) = sum over co-rated items of the variance reduction, a whole
    number.

    With a counted, small ``totals`` (one row per rated (node, item)) the
    join is a broadcast and the branch sums are not shuffled a second time.
    """
    t = totals.select("node", "item_id", "ts", "tn")
    if totals_rows is not None:
        t = _bcast(t, totals_rows)
    j = sums.join(t, ["node", "item_id"])
    s_u = F.col("ts") - F.col("sL") - F.col("sD")
    n_u = F.col("tn") - F.col("nL") - F.col("nD")
    term = (
        _square(F.col("sL"), F.col("nL"))
        + _square(F.col("sD"), F.col("nD"))
        + _square(s_u, n_u)
        - _square(F.col("ts"), F.col("tn"))
    )
    return j.groupBy("node", "cand").agg(F.sum(_whole(term)).cast("decimal(38,0)").alias("gain"))


def best_split(scored: DataFrame, order: str = "most") -> DataFrame:
    """Argmin of error per node: rounded gain desc, popularity, item id."""
    pop = F.col("popularity").desc() if order == "most" else F.col("popularity").asc()
    w = Window.partitionBy("node").orderBy(
        F.format_string(GAIN_FORMAT, F.col("gain")).cast("double").desc(), pop, F.col("item_id").asc()
    )
    return scored.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") == 1).drop("rn")


def partition_nodes(rows: DataFrame, splits: DataFrame, n_splits: int, heavy: bool = True) -> DataFrame:
    """Children assignment: like -> 3p, dislike -> 3p+1, unknown -> 3p+2. Reads the
    ids of liked and disliked items only.

    Users of nodes without a split (leaves) leave the loop.
    """
    s = _bcast(splits.select("node", F.col("item_id").alias("asked")), n_splits)
    answer = F.when(F.array_contains("likes", F.col("asked")), LIKE).when(F.array_contains("dislikes", F.col("asked")), DISLIKE).otherwise(UNKNOWN)
    live = rows.select("user_id", "salt", "nsalt", "node", "likes", "dislikes").join(s, "node").select("user_id", "salt", "nsalt", "node", answer.alias("answer"))
    moved = live.filter("nsalt = 1") if heavy else live
    if heavy:  # the answer lies in one of the user's rows
        many = live.filter("nsalt > 1")
        found = many.groupBy("user_id").agg(F.min("answer").alias("answer"))
        moved = moved.unionByName(many.drop("answer").join(found, "user_id"))
    return moved.select("user_id", "salt", (F.col("node") * 3 + F.col("answer")).cast("int").alias("node"))


def level_rows(e: DataFrame, salted: DataFrame) -> DataFrame:
    """The user rows of a level with their node: a join of two bucketed tables."""
    return e.join(salted.select("user_id", "salt", "node").hint("shuffle_hash"), ["user_id", "salt"])


def score_level(rows: DataFrame, totals: DataFrame, sums: DataFrame, cands: DataFrame, cand_bound: int, node_bound: int, order: str, base: DataFrame, totals_rows: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored, best, sizes) of the split search for the nodes in ``rows``."""
    sizes = rows.filter(F.col("salt") == 0).groupBy("node").agg(F.count(F.lit(1)).alias("n_users"))
    scored = (
        split_gain(sums, totals, totals_rows)
        .join(_bcast(cands.withColumnRenamed("item_id", "cand"), cand_bound), ["node", "cand"])
        .join(_bcast(base, node_bound), "node")
        .select(
            "node",
            F.col("cand").alias("item_id"),
            _real(F.col("base") - F.col("gain")).alias("error"),
            _real(F.col("gain")).alias("gain"),
            "popularity",
        )
    )
    return scored, best_split(scored, order).join(_bcast(sizes, node_bound), "node"), sizes


def tree_paths(tree: "InterviewTree", level: int) -> DataFrame | None:
    """(node, item_id): items asked on the path to every node of ``level``."""
    if level == 0:
        return None
    nodes = tree.assignment.filter(F.col("level") == level).select("node").distinct()
    out = None
    for anc_level in range(level):
        sp = tree.splits.filter(F.col("level") == anc_level).select(
            F.col("node").alias("anc"), "item_id"
        )
        part = nodes.withColumn(
            "anc", F.floor(F.col("node") / F.lit(3 ** (level - anc_level))).cast("int")
        ).join(sp, "anc").select("node", "item_id")
        out = part if out is None else out.unionByName(part)
    return out


def level_frames(tree: "InterviewTree", level: int) -> dict[str, DataFrame]:
    """Recompute the split-search frames of one level of a built tree, all from the
    ratings."""
    prm = tree.params
    rows = level_rows(tree.user_rows, tree.salted_by_level[level])
    n_nodes = max(1 if level == 0 else 3 * tree.split_bound(level - 1), 1)
    bound = prm["k"] * n_nodes
    ea = rating_rows(rows)
    totals = node_item_totals(ea)
    cands = exclude_chosen(topk_candidates(totals, prm["k"], prm["order"]), tree_paths(tree, level))
    sums = branch_sums(rows, cands, n_nodes, prm["k"], prm["score_items"])
    base = candidate_base(totals, cands, bound) if prm["score_items"] == "candidates" else node_base(rows, totals)
    scored, best, sizes = score_level(rows, totals, sums, cands, bound, n_nodes, prm["order"], base, None)
    real = totals.withColumns({"ts": _real(F.col("ts")), "s2": _real(F.col("s2"))})
    return dict(ea=ea, totals=real, cands=cands, branches=branch_stats(sums), scored=scored, best=best, sizes=sizes)


def _paths_below(split_levels: list[DataFrame], counts: list[int], level: int) -> DataFrame:
    """(node, item_id) asked on the path to every child node at ``level``,
    derived from the (checkpointed) split tables of the levels above: the
    ancestor at level l of node n is floor(n / 3^(level - l))."""
    parent = split_levels[level - 1].select("node")
    children = parent.select(
        F.col("node").alias("p"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("b")
    ).select((F.col("p") * 3 + F.col("b")).cast("int").alias("node"))
    out = None
    for anc_level, sp in enumerate(split_levels[:level]):
        part = children.withColumn(
            "anc", F.floor(F.col("node") / F.lit(3 ** (level - anc_level))).cast("int")
        ).join(_bcast(sp.select(F.col("node").alias("anc"), "item_id"), counts[anc_level]), "anc").select(
            "node", "item_id"
        )
        out = part if out is None else out.unionByName(part)
    return out


def build_tree(
    ratings: DataFrame,
    depth: int = 6,
    lam: float = 7.0,
    k: int = 200,
    order: str = "most",
    score_items: str = "all",
    salt_rows: int = DEFAULT_SALT_ROWS,
) -> InterviewTree:
    """Grow the interview tree breadth-first, ``depth`` split levels at most.

    ratings: (user_id, item_id, rating) training cells; zeros mean unrated.
    """
    if order not in ("most", "least"):
        raise ValueError("order must be 'most' or 'least'")
    if score_items not in ("all", "candidates"):
        raise ValueError("score_items must be 'all' or 'candidates'")
    spark = ratings.sparkSession
    before = scratch_tables()
    e, bias, mean, p, heavy, largest = _prepare(ratings, lam, salt_rows)
    salted = write_bucketed(_salted_root(bias, p), "assign0", ["user_id", "salt"], p)
    by_level = [salted]
    salted_levels = [salted.withColumn("level", F.lit(0))]
    split_levels: list[DataFrame] = []
    split_counts: list[int] = []
    paths: DataFrame | None = None
    nodes_bound = 1
    built = 0
    with Scratch(spark) as tmp:
        totals, wide = None, True
        for level in range(depth):
            rows = level_rows(e, salted)
            bound = k * nodes_bound
            if totals is None or score_items == "candidates":
                totals = tmp.write(node_item_totals(rating_rows(rows), score_items == "candidates"), "totals")
            n_totals, most = totals.agg(F.count(F.lit(1)), F.max("tn")).first()
            if level == 0:  # no sum has more terms than the root's busiest item
                wide = most * 2 * largest * SCALE >= LONG_MAX
            cands = tmp.write(exclude_chosen(topk_candidates(totals, k, order), paths), "candidates")
            sums = tmp.write(branch_sums(rows, cands, nodes_bound, k, score_items, heavy, wide), "branches")
            base = candidate_base(totals, cands, bound) if score_items == "candidates" else node_base(rows, totals)
            _, best, _ = score_level(rows, totals, sums, cands, bound, nodes_bound, order, base, n_totals)
            splits = best.select(
                F.lit(level).alias("level"), "node", "item_id", "error", "gain", "n_users", "popularity"
            )
            # at most one row per node: cut lineage by bringing the split table to
            # the driver and back as a local relation (no checkpoint files)
            found = splits.collect()
            n_splits = len(found)
            splits = spark.createDataFrame(found, SPLIT_SCHEMA)
            if n_splits == 0:
                break
            split_levels.append(splits)
            built = level + 1
            salted = write_bucketed(partition_nodes(rows, splits, n_splits, heavy), f"assign{level + 1}", ["user_id", "salt"], p)
            by_level.append(salted)
            salted_levels.append(salted.withColumn("level", F.lit(level + 1)))
            split_counts.append(n_splits)
            if level + 1 < depth and score_items == "all":
                parent, totals = totals, tmp.write(child_totals(totals, sums, splits, n_splits), "totals")
                tmp.drop(parent)
            tmp.drop(sums)
            tmp.drop(cands)
            paths = _paths_below(split_levels, split_counts, level + 1)
            nodes_bound = 3 * n_splits

    schema = SPLIT_SCHEMA
    if split_levels:
        all_splits = split_levels[0]
        for s in split_levels[1:]:
            all_splits = all_splits.unionByName(s)
    else:
        all_splits = spark.createDataFrame([], schema)
    salted_all = salted_levels[0]
    for s in salted_levels[1:]:
        salted_all = salted_all.unionByName(s)
    salted_all = salted_all.select("level", "user_id", "salt", "node")
    assignment = salted_all.filter(F.col("salt") == 0).select("level", "node", "user_id")
    return InterviewTree(
        splits=all_splits,
        assignment=assignment,
        bias=bias,
        user_rows=e,
        salted_assignment=salted_all,
        salted_by_level=by_level,
        mean=mean,
        levels=built,
        split_counts=list(split_counts),
        tables=scratch_tables() - before,
        buckets=p,
        params=dict(depth=depth, lam=lam, k=k, order=order, score_items=score_items, salt_rows=salt_rows),
    )


def next_question(tree: InterviewTree, level: int, node: int) -> DataFrame:
    """The item asked at (level, node) (empty if the node is a leaf)."""
    return tree.splits.filter((F.col("level") == level) & (F.col("node") == node)).select(
        "level", "node", "item_id"
    )
