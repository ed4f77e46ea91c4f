"""Registry entries for sources, preparation, statistics, joins, set
operations and COO algebra (the non-tree part of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from coldsplit import sources
from coldsplit.functions import pad_item_code
from coldsplit.operators import prepare, sparse, stats
from coldsplit.operators.route import attitude_trace, route_users
from coldsplit.operators.skew import salted_join
from coldsplit.plans import fixtures as fx
from coldsplit.plans.oracle import CELLS, RATINGS, base_ctes, with_
from coldsplit.plans.queries import DEPTH, ROUTE, TREE, query, r6, split_data, tree_for
from coldsplit.session import bucket_count, scratch_path, write_table

PART = [CELLS, RATINGS["part"]]
SUPP = [CELLS, RATINGS["supp"]]
BASE = base_ctes("supp")

# ================================================================ sources


@query("read_ratings_csv", with_(PART, "SELECT user_id, item_id, rating FROM ratings"))
def q_read_ratings_csv(spark, sf):
    path = scratch_path(spark, "ratings-csv")
    sources.write_ratings_csv(fx.ratings(spark, sf, "part"), path)
    return sources.read_ratings_csv(spark, path)


@query("write_ratings_csv", with_(SUPP, "SELECT user_id, item_id, rating FROM ratings"))
def q_write_ratings_csv(spark, sf):
    path = scratch_path(spark, "ratings-csv")
    sources.write_ratings_csv(fx.ratings(spark, sf, "supp"), path)
    return spark.read.text(path).select(
        F.split("value", ",").getItem(0).cast("int").alias("user_id"),
        F.split("value", ",").getItem(1).cast("int").alias("item_id"),
        F.split("value", ",").getItem(2).cast("double").alias("rating"),
    )


_ITEMS_SQL = (
    "SELECT CAST(p_partkey AS INT) AS asin, p_type AS description, p_name AS title, p_retailprice AS price FROM part"
)


@query("read_items_csv", "WITH x AS (" + _ITEMS_SQL + ") SELECT asin, description, title, price FROM x")
def q_read_items_csv(spark, sf):
    path = scratch_path(spark, "items-csv")
    items = fx.item_metadata(spark, sf).withColumn(
        # free text with embedded quotes, commas and line breaks
        "description", F.concat(F.col("description"), F.lit(', "x"\nline'))
    )
    sources.write_items_csv(items, path)
    back = sources.read_items_csv(spark, path)
    return back.withColumn("description", F.regexp_replace("description", r', "x"\nline$', ""))


@query("write_items_csv", "WITH x AS (" + _ITEMS_SQL + ") SELECT asin, title FROM x")
def q_write_items_csv(spark, sf):
    path = scratch_path(spark, "items-csv")
    sources.write_items_csv(fx.item_metadata(spark, sf), path)
    return sources.read_items_csv(spark, path).select("asin", "title")


_REVIEWS_SQL = (
    "SELECT 'A' || CAST(o_custkey AS VARCHAR) AS reviewerID,"
    " CASE WHEN l_partkey % 3 = 0 THEN lpad(CAST(l_partkey AS VARCHAR), 9, '0')"
    " WHEN l_partkey % 3 = 1 THEN lpad(CAST(l_partkey AS VARCHAR), 10, '0')"
    " ELSE 'B' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') END AS asin,"
    " CAST(FLOOR((l_quantity - 1) / 10) + 1 AS DOUBLE) AS overall"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
)


def _write_reviews(spark, sf):
    """Dict-literal lines with single quotes, plus one malformed line per file."""
    path = scratch_path(spark, "reviews")
    r = fx.coded_reviews(spark, sf)
    lines = r.select(
        F.format_string("{'reviewerID': '%s', 'asin': '%s', 'overall': %s, 'helpful': [0, 0]}",
                        "reviewerID", "asin", F.col("overall").cast("string")).alias("value")
    )
    lines.write.text(path)
    spark.createDataFrame([("{'reviewerID': 'A1', 'asin': 'X', 'overall': None, 'x': (1,2)}",)], "value string").write.mode(
        "append"
    ).text(path)
    return path


@query("read_reviews_json", "WITH x AS (" + _REVIEWS_SQL + ") SELECT reviewerID, asin, overall FROM x")
def q_read_reviews(spark, sf):
    back = sources.read_reviews_json(spark, _write_reviews(spark, sf))
    return back.filter(F.col("_corrupt_record").isNull()).select("reviewerID", "asin", "overall")


@query(
    "read_ratings_delimited",
    with_(PART, "SELECT user_id, item_id, rating FROM ratings"),
)
def q_read_delimited(spark, sf):
    path = scratch_path(spark, "ml")
    r = fx.ratings(spark, sf, "part")
    r.select(
        F.concat_ws("::", "user_id", "item_id", F.col("rating").cast("int"), (F.col("user_id") * 1000 + 978300760).cast("string")).alias("value")
    ).write.text(path)
    return sources.read_ratings_delimited(spark, path).select("user_id", "item_id", "rating")


def _write_sectioned(spark, sf, which="supp"):
    """One folder per item with a file whose first line is '<item>:'."""
    path = scratch_path(spark, "sectioned")
    r = write_table(fx.ratings(spark, sf, which), "sectioned-ratings")  # read for headers and lines
    # the time goes by files, not by bytes: a few tasks a core even them out
    tasks = max(4 * spark.sparkContext.defaultParallelism, bucket_count(spark, r.count(), fx.ROWS_PER_TASK))
    head = r.select("item_id").distinct().select(
        "item_id", F.lit(0).alias("ord"), F.concat(F.col("item_id").cast("string"), F.lit(":")).alias("value")
    )
    body = r.select(
        "item_id",
        F.lit(1).alias("ord"),
        F.concat_ws(",", F.col("user_id").cast("string"), F.col("rating").cast("int").cast("string"), F.lit("2005-09-06")).alias("value"),
    )
    (
        head.unionByName(body)
        .repartition(tasks, "item_id")
        .sortWithinPartitions("item_id", "ord")
        .select("item_id", "value")
        .write.partitionBy("item_id")
        .text(path)
    )
    return path


@query("read_sectioned_ratings", with_(SUPP, "SELECT user_id, item_id, rating FROM ratings"))
def q_read_sectioned(spark, sf):
    path = _write_sectioned(spark, sf)
    return sources.read_sectioned_ratings(spark, path, id_pattern=r"item_id=(\d+)").select("user_id", "item_id", "rating")


@query("stack_ratings", with_(SUPP, "SELECT COUNT(*) AS n, COUNT(DISTINCT item_id) AS n_items FROM ratings"))
def q_stack(spark, sf):
    path = _write_sectioned(spark, sf)
    r = sources.read_sectioned_ratings(spark, path, id_pattern=r"item_id=(\d+)")
    return r.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("n_items"))


@query("read_sectioned_pairs", with_(SUPP + [fx.PROBE_SQL], "SELECT item_id, user_id FROM probe"))
def q_read_pairs(spark, sf):
    path = scratch_path(spark, "probe")
    probe = fx.probe_pairs(spark, sf, "supp").distinct()
    head = probe.select("item_id").distinct().select(
        "item_id", F.lit(0).alias("ord"), F.lit(0).alias("user_id"), F.concat(F.col("item_id").cast("string"), F.lit(":")).alias("value")
    )
    body = probe.select("item_id", F.lit(1).alias("ord"), "user_id", F.col("user_id").cast("string").alias("value"))
    (
        head.unionByName(body)
        .repartition(4, "item_id")
        .sortWithinPartitions("item_id", "ord", "user_id")
        .select("value")
        .write.text(path)
    )
    return sources.read_sectioned_pairs(spark, path)


@query("probe_extract", with_(SUPP + [fx.PROBE_SQL], "SELECT r.user_id, r.item_id, r.rating FROM ratings r JOIN probe p ON p.item_id = r.item_id AND p.user_id = r.user_id"))
def q_probe_extract(spark, sf):
    return prepare.probe_extract(fx.ratings(spark, sf, "supp"), fx.probe_pairs(spark, sf, "supp")).select("user_id", "item_id", "rating")


@query("probe_remove", with_(SUPP + [fx.PROBE_SQL], "SELECT r.user_id, r.item_id, r.rating FROM ratings r WHERE NOT EXISTS (SELECT 1 FROM probe p WHERE p.item_id = r.item_id AND p.user_id = r.user_id)"))
def q_probe_remove(spark, sf):
    return prepare.probe_remove(fx.ratings(spark, sf, "supp"), fx.probe_pairs(spark, sf, "supp")).select("user_id", "item_id", "rating")


@query(
    "validation_restrict",
    with_(
        SUPP + [fx.PROBE_SQL],
        "SELECT r.user_id, r.item_id, r.rating FROM ratings r JOIN probe p ON p.item_id = r.item_id AND p.user_id = r.user_id"
        " WHERE r.user_id < (SELECT FLOOR((MAX(user_id) + 1) * 0.75) FROM ratings)",
    ),
)
def q_validation_restrict(spark, sf):
    r = fx.ratings(spark, sf, "supp")
    cut = prepare.split_point(r, 0.75)
    v = prepare.probe_extract(r, fx.probe_pairs(spark, sf, "supp"))
    return v.filter(F.col("user_id") < cut).select("user_id", "item_id", "rating")


@query("save_ratings", with_(SUPP, "SELECT user_id, item_id, rating FROM ratings"))
def q_save_ratings(spark, sf):
    path = scratch_path(spark, "coo")
    sources.save_ratings(fx.ratings(spark, sf, "supp"), path)
    return sources.load_ratings(spark, path)


@query("load_user_shards", with_(SUPP, "SELECT user_id // 24 AS shard, COUNT(*) AS n, SUM(rating) AS total FROM ratings GROUP BY 1"))
def q_shards(spark, sf):
    path = scratch_path(spark, "shards")
    sources.save_user_shards(fx.ratings(spark, sf, "supp"), path, 24)
    # every shard, read by a table of their numbers
    shards = spark.read.parquet(path).select("shard")
    back = sources.load_user_shards(spark, path, shards=shards)
    return back.groupBy(F.floor(F.col("user_id") / 24).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("total"))


@query("merge_shards", with_(SUPP, "SELECT user_id, item_id, rating FROM ratings"))
def q_merge_shards(spark, sf):
    path = scratch_path(spark, "shards")
    sources.save_user_shards(fx.ratings(spark, sf, "supp"), path, 24)
    return sources.load_user_shards(spark, path).select("user_id", "item_id", "rating")


@query("save_tree", with_(TREE, "SELECT level, node, item_id, n_users FROM splits"))
def q_save_tree(spark, sf):
    t, _, _ = tree_for(spark, sf)
    path = scratch_path(spark, "tree")
    sources.save_tree(t, path)
    return sources.load_tree(spark, path).splits.select("level", "node", "item_id", "n_users")


@query("load_tree", with_(ROUTE, "SELECT user_id, trace FROM routed"))
def q_load_tree(spark, sf):
    # routing on the tree that came back from disk
    t, _, test = tree_for(spark, sf)
    path = scratch_path(spark, "tree")
    sources.save_tree(t, path)
    return attitude_trace(route_users(sources.load_tree(spark, path), test))


# ================================================== projections & expressions


@query("project_columns", with_(PART, "SELECT user_id, rating FROM ratings"))
def q_project(spark, sf):
    return prepare.project_columns(fx.ratings(spark, sf, "part"), ["user_id", "rating"])


@query("cast_columns", with_(PART, "SELECT user_id, item_id, rating FROM ratings"))
def q_cast(spark, sf):
    return prepare.cast_columns(fx.ratings(spark, sf, "part"))


_ZERO_SQL = (
    "SELECT CAST(o_custkey AS INT) AS user_id, CAST(l_partkey AS INT) AS item_id,"
    " CASE WHEN l_discount = 0 THEN 0.0 ELSE CAST(FLOOR((l_quantity - 1) / 10) + 1 AS DOUBLE) END AS rating"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
)


@query("drop_unrated", "WITH z AS (" + _ZERO_SQL + ") SELECT user_id, item_id, rating FROM z WHERE rating <> 0")
def q_drop_unrated(spark, sf):
    c = fx.raw_cells(spark, sf)
    li = fx.table(spark, sf, "lineitem")
    od = fx.table(spark, sf, "orders")
    z = li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.col("o_custkey").cast("int").alias("user_id"),
        F.col("l_partkey").cast("int").alias("item_id"),
        F.when(F.col("l_discount") == 0, F.lit(0.0)).otherwise(F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("double").alias("rating"),
    )
    del c
    return prepare.drop_unrated(z)


@query(
    "pad_item_code",
    "WITH x AS (" + _REVIEWS_SQL + ") SELECT DISTINCT asin AS code,"
    " CASE WHEN regexp_matches(asin, '^[0-9]') AND length(asin) < 10 THEN '0' || asin ELSE asin END AS padded FROM x",
)
def q_pad(spark, sf):
    r = fx.coded_reviews(spark, sf)
    return r.select(F.col("asin").alias("code")).distinct().select("code", pad_item_code(F.col("code")).alias("padded"))


@query(
    "prefix_split",
    with_(SUPP, "SELECT user_id, item_id, rating FROM ratings WHERE user_id < (SELECT FLOOR((MAX(user_id) + 1) * 0.7) FROM ratings)"),
)
def q_prefix_split(spark, sf):
    train, _ = prepare.prefix_split(fx.ratings(spark, sf, "supp"), 0.7)
    return train


@query("sub_rectangle", with_(PART, "SELECT user_id, item_id, rating FROM ratings WHERE item_id < 100 AND user_id < 1000"))
def q_sub_rectangle(spark, sf):
    return prepare.sub_rectangle(fx.ratings(spark, sf, "part"), 100, 1000)


@query("residual", with_(BASE, "SELECT user_id, item_id, ROUND(e, 6) AS e FROM e"))
def q_residual(spark, sf):
    train, _ = split_data(spark, sf)
    b = stats.user_bias(train, 7.0)
    return stats.residuals(train, b).select("user_id", "item_id", r6(F.col("e")).alias("e"))


@query("join_bias", with_(BASE, "SELECT t.user_id, t.item_id, ROUND(b.bias, 6) AS bias FROM train t JOIN bias b ON t.user_id = b.user_id"))
def q_join_bias(spark, sf):
    train, _ = split_data(spark, sf)
    b = stats.user_bias(train, 7.0)
    return salted_join(train, b.select("user_id", "bias"), ["user_id"], ["item_id"]).select("user_id", "item_id", r6(F.col("bias")).alias("bias"))


@query(
    "join_assignment",
    with_(TREE, "SELECT x.level, x.node, e.user_id, e.item_id FROM (" + " UNION ALL ".join(f"SELECT {lv} AS level, node, user_id FROM a{lv}" for lv in range(DEPTH + 1)) + ") x JOIN e ON x.user_id = e.user_id"),
)
def q_join_assignment(spark, sf):
    t, train, _ = tree_for(spark, sf)
    # a user has one assignment row a level
    return salted_join(train, t.assignment, ["user_id"], ["item_id"]).select("level", "node", "user_id", "item_id")


# ============================================================ reshaping


@query("swap_roles", with_(SUPP, "SELECT item_id AS user_id, user_id AS item_id, rating FROM ratings"))
def q_swap(spark, sf):
    return prepare.swap_roles(fx.ratings(spark, sf, "supp"))


@query("coo_build", with_(PART, "SELECT user_id, item_id, SUM(rating) AS rating FROM cells GROUP BY user_id, item_id"))
def q_coo(spark, sf):
    return prepare.coo_build(fx.raw_cells(spark, sf).select("user_id", "item_id", "rating"), "sum")


@query("coo_build_mean", with_(PART, "SELECT user_id, item_id, ROUND(AVG(rating), 6) AS rating FROM cells GROUP BY user_id, item_id"))
def q_coo_mean(spark, sf):
    c = prepare.coo_build(fx.raw_cells(spark, sf).select("user_id", "item_id", "rating"), "mean")
    return c.select("user_id", "item_id", r6(F.col("rating")).alias("rating"))


@query("rated_items", with_(SUPP, "SELECT DISTINCT item_id FROM ratings"))
def q_rated_items(spark, sf):
    return prepare.rated_items(fx.ratings(spark, sf, "supp"))


@query(
    "user_rating_map",
    # parts: several blocks of item ids a user
    with_(PART, "SELECT user_id, CAST(item_id // 1000 AS INT) AS block, string_agg(CAST(item_id AS VARCHAR) || ':' || CAST(CAST(rating AS INT) AS VARCHAR), ',' ORDER BY item_id) AS ratings FROM ratings GROUP BY 1, 2"),
)
def q_user_map(spark, sf):
    m = prepare.user_rating_map(fx.ratings(spark, sf, "part"))
    entries = F.array_sort(F.map_entries("ratings"))
    return m.select(
        "user_id",
        "block",
        F.array_join(F.transform(entries, lambda e: F.concat(e.key.cast("string"), F.lit(":"), e.value.cast("int").cast("string"))), ",").alias("ratings"),
    )


@query(
    "index_users",
    "WITH x AS (" + _REVIEWS_SQL + ") SELECT reviewerID, CAST(DENSE_RANK() OVER (ORDER BY reviewerID) - 1 AS INT) AS user_id FROM (SELECT DISTINCT reviewerID FROM x)",
)
def q_index_users(spark, sf):
    return prepare.index_users(fx.coded_reviews(spark, sf))


_PADDED = (
    "p AS (SELECT DISTINCT CASE WHEN regexp_matches(asin, '^[0-9]') AND length(asin) < 10 THEN '0' || asin ELSE asin END AS asin FROM x)"
)


@query(
    "index_items",
    "WITH x AS (" + _REVIEWS_SQL + "), " + _PADDED + " SELECT asin, CAST(DENSE_RANK() OVER (ORDER BY asin) - 1 AS INT) AS item_id FROM p",
)
def q_index_items(spark, sf):
    return prepare.index_items(fx.coded_reviews(spark, sf))


@query(
    "restrict_items_to_rated",
    "WITH x AS (" + _REVIEWS_SQL + "), " + _PADDED + ", idx AS (SELECT asin, CAST(DENSE_RANK() OVER (ORDER BY asin) - 1 AS INT) AS item_id FROM p),"
    " meta AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN '0' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')"
    " WHEN p_partkey % 3 = 1 THEN lpad(CAST(p_partkey AS VARCHAR), 10, '0') ELSE 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS asin,"
    " p_type AS description, p_name AS title, p_retailprice AS price FROM part)"
    " SELECT i.item_id AS asin, m.description, m.title, m.price FROM meta m JOIN idx i ON i.asin = m.asin",
)
def q_restrict(spark, sf):
    idx = prepare.index_items(fx.coded_reviews(spark, sf))
    p = fx.table(spark, sf, "part")
    k = F.col("p_partkey")
    code = (
        F.when(k % 3 == 0, F.lpad(k.cast("string"), 9, "0"))
        .when(k % 3 == 1, F.lpad(k.cast("string"), 10, "0"))
        .otherwise(F.concat(F.lit("B"), F.lpad(k.cast("string"), 9, "0")))
    )
    meta = p.select(pad_item_code(code).alias("asin"), F.col("p_type").alias("description"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"))
    return prepare.restrict_items_to_rated(meta, idx)


@query(
    "compact_users",
    with_(SUPP, "SELECT user_id, CAST(DENSE_RANK() OVER (ORDER BY user_id) AS INT) AS new_user_id FROM (SELECT DISTINCT user_id FROM ratings)"),
)
def q_compact(spark, sf):
    return prepare.compact_users(fx.ratings(spark, sf, "supp"))


# ============================================================ aggregations


@query("global_mean", with_(BASE, "SELECT ROUND(mu, 6) AS mean FROM mu"))
def q_global_mean(spark, sf):
    train, _ = split_data(spark, sf)
    return train.agg(r6(F.avg("rating")).alias("mean"))


@query("user_bias", with_(BASE, "SELECT user_id, ROUND(bias, 6) AS bias, n FROM bias"))
def q_user_bias(spark, sf):
    train, _ = split_data(spark, sf)
    return stats.user_bias(train, 7.0).select("user_id", r6(F.col("bias")).alias("bias"), "n")


@query(
    "item_stats",
    with_(BASE, "SELECT item_id, ROUND(SUM(e), 6) AS s, ROUND(SUM(e * e), 6) AS s2, COUNT(*) AS n FROM e GROUP BY item_id"),
)
def q_item_stats(spark, sf):
    train, _ = split_data(spark, sf)
    s = stats.item_stats(train, stats.user_bias(train, 7.0))
    return s.select("item_id", r6(F.col("s")).alias("s"), r6(F.col("s2")).alias("s2"), "n")


@query(
    "dataset_stats",
    with_(
        PART,
        "SELECT MAX(user_id) AS max_user_id, MAX(item_id) AS max_item_id, COUNT(DISTINCT user_id) AS n_users,"
        " COUNT(DISTINCT item_id) AS n_items, COUNT(*) AS n_ratings,"
        " ROUND(COUNT(*) / CAST(MAX(user_id) AS DOUBLE) / CAST(MAX(item_id) AS DOUBLE), 9) AS density FROM ratings",
    ),
)
def q_dataset_stats(spark, sf):
    d = stats.dataset_stats(fx.ratings(spark, sf, "part"))
    return d.withColumn("density", F.round("density", 9))


@query("entity_counts", with_(SUPP, "SELECT COUNT(DISTINCT item_id) AS item_size, COUNT(DISTINCT user_id) AS user_size FROM ratings"))
def q_entity_counts(spark, sf):
    return stats.entity_counts(fx.ratings(spark, sf, "supp"))


@query("ratings_per_user", "SELECT CAST(user_id AS INT) AS user_id, COUNT(*) AS n_ratings FROM events GROUP BY user_id")
def q_ratings_per_user(spark, sf):
    ev = fx.table(spark, sf, "events").select(F.col("user_id").cast("int").alias("user_id"))
    return stats.ratings_per_user(ev)


@query(
    "rating_count_histogram",
    "WITH c AS (SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id), b AS (SELECT MIN(n) AS lo, MAX(n) AS hi FROM c)"
    " SELECT CAST(CASE WHEN b.hi = b.lo THEN 0 ELSE LEAST(FLOOR((c.n - b.lo) / CAST(b.hi - b.lo AS DOUBLE) * 20), 19) END AS INT) AS bin,"
    " COUNT(*) AS n FROM c, b GROUP BY 1",
)
def q_histogram(spark, sf):
    ev = fx.table(spark, sf, "events").select(F.col("user_id").cast("int").alias("user_id"))
    h = stats.rating_count_histogram(stats.ratings_per_user(ev), "n_ratings", 20)
    return h.select("bin", "n")


# fixed values: the published plots have 1000 bins for items and 2000 for users, and
# show a window of the counts
PLOTS = {"item_id": (1000, (30, 45)), "user_id": (2000, (0, 100))}


def _plot_sql(key: str) -> str:
    bins, (low, high) = PLOTS[key]
    return with_(
        PART
        + [
            f"c AS (SELECT {key}, COUNT(*) AS n FROM ratings GROUP BY {key})",
            "b AS (SELECT MIN(n) AS lo, MAX(n) AS hi FROM c)",
            f"f AS (SELECT CASE WHEN b.hi = b.lo THEN 0 ELSE LEAST(FLOOR((c.n - b.lo) / CAST(b.hi - b.lo AS DOUBLE) * {bins}), {bins - 1}) END AS bin, COUNT(*) AS n FROM c, b GROUP BY 1)",
            f"e AS (SELECT CAST(g.bin AS INT) AS bin, b.lo + CAST(b.hi - b.lo AS DOUBLE) * g.bin / {bins} AS bin_lo,"
            f" b.lo + CAST(b.hi - b.lo AS DOUBLE) * (g.bin + 1) / {bins} AS bin_hi FROM (SELECT UNNEST(generate_series(0, {bins - 1})) AS bin) g, b)",
        ],
        f"SELECT e.bin, ROUND(e.bin_lo, 6) AS bin_lo, ROUND(e.bin_hi, 6) AS bin_hi, COALESCE(f.n, 0) AS n FROM e LEFT JOIN f ON f.bin = e.bin WHERE e.bin_hi >= {low} AND e.bin_lo <= {high}",
    )


def _plot(spark, sf, key):
    bins, view = PLOTS[key]
    counts = fx.ratings(spark, sf, "part").groupBy(key).agg(F.count(F.lit(1)).alias("n_ratings"))
    h = stats.histogram_view(counts, "n_ratings", bins, view)
    return h.select("bin", r6(F.col("bin_lo")).alias("bin_lo"), r6(F.col("bin_hi")).alias("bin_hi"), "n")


@query("histogram_items", _plot_sql("item_id"))
def q_histogram_items(spark, sf):
    return _plot(spark, sf, "item_id")


@query("histogram_users", _plot_sql("user_id"))
def q_histogram_users(spark, sf):
    return _plot(spark, sf, "user_id")


@query(
    "smallest_n",
    "SELECT n_ratings FROM (SELECT COUNT(*) AS n_ratings FROM events GROUP BY user_id) ORDER BY n_ratings LIMIT 10",
)
def q_smallest(spark, sf):
    ev = fx.table(spark, sf, "events").select(F.col("user_id").cast("int").alias("user_id"))
    return stats.smallest_n(stats.ratings_per_user(ev), "n_ratings", 10)


@query("sort_by_key", with_(PART, "SELECT user_id, item_id, rating FROM ratings ORDER BY user_id, item_id"))
def q_sort(spark, sf):
    return fx.ratings(spark, sf, "part").orderBy("user_id", "item_id")


# ============================================================ COO algebra


@query(
    "matrix_row_sums",
    with_(
        PART,
        "SELECT item_id, SUM(rating) AS row_sum, COUNT(*) AS row_nnz FROM ratings"
        " WHERE user_id >= 0 AND user_id < (SELECT FLOOR((MAX(user_id) + 1) * 0.7) FROM ratings) GROUP BY item_id",
    ),
)
def q_row_sums(spark, sf):
    r = fx.ratings(spark, sf, "part")
    cut = prepare.split_point(r, 0.7)
    return sparse.matrix_row_sums(r, "item_id", "user_id", "rating", 0, cut)


@query(
    "slice_difference",
    with_(
        PART,
        "SELECT item_id, SUM(CASE WHEN user_id < 500 THEN rating ELSE -rating END) AS diff FROM ratings GROUP BY item_id",
    ),
)
def q_slice_diff(spark, sf):
    r = fx.ratings(spark, sf, "part")
    return sparse.slice_difference(r, "item_id", "user_id", "rating", (0, 500), (500, None))


@query(
    "matrix_vector",
    with_(
        PART,
        "SELECT r.item_id, ROUND(SUM(r.rating * c.c_acctbal / 1000), 6) AS value FROM ratings r"
        " JOIN customer c ON CAST(c.c_custkey AS INT) = r.user_id GROUP BY r.item_id",
    ),
)
def q_matvec(spark, sf):
    r = fx.ratings(spark, sf, "part")
    v = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("int").alias("user_id"), (F.col("c_acctbal") / 1000).alias("v")
    )
    return sparse.matrix_vector(r, v, "item_id", "user_id", "rating").select("item_id", r6(F.col("value")).alias("value"))


@query("elementwise_square", with_(PART, "SELECT user_id, item_id, rating * rating AS rating FROM ratings"))
def q_square(spark, sf):
    return sparse.elementwise_square(fx.ratings(spark, sf, "part"), "rating")


@query("load_ratings", with_(PART, "SELECT user_id, item_id, rating FROM ratings"))
def q_load_ratings(spark, sf):
    path = scratch_path(spark, "coo")
    sources.save_ratings(fx.ratings(spark, sf, "part"), path)
    return sources.load_ratings(spark, path)


@query(
    "save_user_shards",
    with_(SUPP, "SELECT CAST(FLOOR(user_id / 24) AS INT) AS shard, COUNT(*) AS n FROM ratings GROUP BY 1"),
)
def q_save_shards(spark, sf):
    path = scratch_path(spark, "shards")
    sources.save_user_shards(fx.ratings(spark, sf, "supp"), path, 24)
    return spark.read.parquet(path).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query(
    "matrix_matmul",
    with_(
        PART + ["emb AS (SELECT CAST(vec_id AS INT) AS vec_id, embedding AS v FROM embeddings)",
                "b AS (SELECT e.vec_id, CAST(u.i AS INT) - 1 AS dim, CAST(e.v[u.i] AS DOUBLE) AS value"
                " FROM emb e, UNNEST(range(1, len(e.v) + 1)) AS u(i))"],
        "SELECT r.user_id, b.dim, ROUND(SUM(r.rating * b.value), 6) AS value FROM ratings r"
        " JOIN b ON b.vec_id = r.item_id % (SELECT COUNT(*) FROM emb) GROUP BY r.user_id, b.dim",
    ),
)
def q_matmul(spark, sf):
    """ratings (user x part) times an item-feature matrix (part x dim) taken
    from ``embeddings`` (vec_id = part id modulo the table size)."""
    r = fx.ratings(spark, sf, "part")
    emb = fx.table(spark, sf, "embeddings")
    n = emb.count()
    b = emb.select(F.col("vec_id").cast("int").alias("vec_id"), F.posexplode("embedding").alias("dim", "value")).select(
        "vec_id", F.col("dim").cast("int").alias("dim"), F.col("value").cast("double").alias("value")
    )
    a = r.select("user_id", (F.col("item_id") % n).cast("int").alias("vec_id"), F.col("rating").alias("value"))
    out = sparse.matrix_matmul(a, b, "user_id", "vec_id", "dim")
    return out.select("user_id", "dim", r6(F.col("value")).alias("value"))
