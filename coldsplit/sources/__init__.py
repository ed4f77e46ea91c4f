"""Readers and writers for rating data, item metadata and model tables.

Every reader takes an explicit schema (no inference) and returns the canonical
COO layout ``(user_id int, item_id int, rating double)`` where it applies.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldsplit.session import session_conf

LISTERS_PER_CORE = 4

RATINGS_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.IntegerType()),
        T.StructField("item_id", T.IntegerType()),
        T.StructField("rating", T.DoubleType()),
    ]
)
ITEMS_SCHEMA = T.StructType(
    [
        T.StructField("asin", T.IntegerType()),
        T.StructField("description", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("price", T.DoubleType()),
    ]
)
REVIEWS_SCHEMA = T.StructType(
    [
        T.StructField("reviewerID", T.StringType()),
        T.StructField("asin", T.StringType()),
        T.StructField("overall", T.DoubleType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)
DELIMITED_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.IntegerType()),
        T.StructField("item_id", T.IntegerType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("ts", T.LongType()),
    ]
)


# ---------------------------------------------------------------- readers
def read_ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``user,item,rating`` lines."""
    return spark.read.schema(RATINGS_SCHEMA).csv(path, header=False)


def read_items_csv(spark: SparkSession, path: str, stray_quotes: bool = False) -> DataFrame:
    """Header CSV of item metadata; free text may span lines inside quotes.

    Files are read by blocks, so one file makes many tasks. A line break ends a
    record where an even number of quotes stands before it: the quotes of a block
    are counted, a running sum over one row per block tells each block whether it
    starts inside quotes, and lines between two breaks of a record are put together
    within their block. Only the record that crosses a block's border (one a block at
    most) is joined with its other pieces by a second, small shuffle. Empty lines
    outside quotes are no records; the first record of each file is its header; line
    breaks inside quotes stay as they are.

    The count needs quotes inside a field to be doubled and the field quoted, as
    writers do. For files with lone quotes in unquoted fields, ``stray_quotes`` reads
    each file whole in one task.
    """
    if stray_quotes:
        return spark.read.schema(ITEMS_SCHEMA).csv(path, header=True, multiLine=True, escape='"')
    options = {"escape": '"', "multiLine": "true"}
    record = _quoted_records(spark, path).select(F.from_csv("record", ITEMS_SCHEMA.simpleString()[len("struct<"):-1].replace(":", " "), options).alias("r"))
    return record.select("r.*")


def _quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the CSV records of the files under ``path`` but each file's first."""
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),  # in line order inside a block
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("long").alias("quotes"),
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("in_block"))
    blocks = blocks.withColumn("carried", F.coalesce(F.sum("in_block").over(before), F.lit(0)))
    earlier = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.join(blocks, ["file", "block"]).withColumn("outside", (F.col("carried") + F.coalesce(F.sum("quotes").over(earlier), F.lit(0))) % 2 == 0)
    lines = lines.filter(~F.col("outside") | ~F.col("line").isin("", "\r"))
    # 0: the rest of a record of an earlier block
    lines = lines.withColumn("n", F.sum(F.col("outside").cast("long")).over(upto))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    open_end = (F.any_value("carried") + F.any_value("in_block")) % 2 == 1
    pieces = lines.groupBy("file", "block", "n").agg(text.alias("piece"), open_end.alias("block_open"), (F.sum("quotes") % 2 == 1).alias("odd"))
    # a record left open by its last line ends its block
    crossing = (F.col("n") == 0) | (F.col("block_open") & F.col("odd"))
    header = (F.col("block") == 0) & (F.col("n") == 1)
    whole = pieces.filter(~crossing & ~header).select(F.col("piece").alias("record"))
    order = Window.partitionBy("file").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most two a block
    parts = pieces.filter(crossing).withColumn("chain", F.sum((F.col("n") > 0).cast("long")).over(order)).withColumn("head", header)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "n", "piece"))), lambda x: x["piece"]), "\n")
    stitched = parts.groupBy("file", "chain").agg(joined.alias("record"), F.bool_or("head").alias("head")).filter(~F.col("head")).select("record")
    return whole.unionByName(stitched).select(F.regexp_replace("record", "\r$", "").alias("record"))


def read_reviews_json(spark: SparkSession, path: str) -> DataFrame:
    """One dict literal per line (single or double quotes). Lines that are not
    JSON-like land in ``_corrupt_record``; they are never evaluated."""
    return spark.read.schema(REVIEWS_SCHEMA).json(
        path, allowSingleQuotes=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record"
    )


def read_ratings_delimited(spark: SparkSession, path: str, sep: str = "::") -> DataFrame:
    """``UserID::MovieID::Rating::Timestamp`` lines; the timestamp is kept."""
    return spark.read.schema(DELIMITED_SCHEMA).csv(path, sep=sep, header=False)


def read_sectioned_ratings(spark: SparkSession, path: str, id_pattern: str = r"(\d+)[^/\d]*$") -> DataFrame:
    """Directory of per-item files: first line ``<id>:``, then ``user,rating,date``.

    The item id comes from the file path (last number in it by default).
    """
    # one file per item: they are listed by a few tasks a core, not by a task per folder
    listers = str(LISTERS_PER_CORE * spark.sparkContext.defaultParallelism)
    with session_conf(spark, spark__sql__sources__parallelPartitionDiscovery__parallelism=listers):
        files = spark.read.text(path)
    lines = files.select("value", F.col("_metadata.file_path").alias("file_path"))
    body = lines.filter(~F.col("value").rlike(r":\s*$") & (F.length(F.trim("value")) > 0))
    parts = F.split(F.col("value"), ",")
    return body.select(
        parts.getItem(0).cast("int").alias("user_id"),
        F.regexp_extract("file_path", id_pattern, 1).cast("int").alias("item_id"),
        parts.getItem(1).cast("double").alias("rating"),
        parts.getItem(2).alias("date"),
    )


def read_sectioned_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``<item>:`` header lines followed by ``user[,...]`` lines -> (item_id, user_id).

    Files are read by blocks. Inside a block the last header is carried down in
    line order; lines before a block's first header get the last header of the
    blocks before it, from a table of one row per block.
    """
    lines = spark.read.text(path).select(
        F.trim(F.regexp_replace("value", "\r", "")).alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),  # in line order inside a block
    )
    header = F.regexp_extract("line", r"^(-?\d+):", 1)
    lines = lines.withColumn("head", F.when(header != "", header.cast("int")))
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("own", F.last("head", ignorenulls=True).over(inside))
    ends = lines.filter("head is not null").groupBy("file", "block").agg(F.max(F.struct("at", "head")).alias("e"))
    blocks = lines.select("file", "block").distinct().join(ends, ["file", "block"], "left")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = blocks.select("file", "block", F.last("e.head", ignorenulls=True).over(before).alias("carried"))
    found = lines.filter("head is null and line <> ''").join(blocks, ["file", "block"])
    return found.select(F.coalesce("own", "carried").alias("item_id"), F.split("line", ",").getItem(0).cast("int").alias("user_id")).filter("item_id is not null")


def rows_to_df(spark: SparkSession, rows, schema=RATINGS_SCHEMA) -> DataFrame:
    """In-memory tuples -> a distributed ratings table (small inputs only)."""
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- writers
def write_ratings_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select("user_id", "item_id", "rating").write.mode(mode).csv(path, header=False)


def write_items_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select("asin", "description", "title", "price").write.mode(mode).csv(
        path, header=True, escape='"'
    )


def save_ratings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select("user_id", "item_id", "rating").write.mode(mode).parquet(path)


def load_ratings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RATINGS_SCHEMA).parquet(path)


SHARDS_PER_FOLDER = 1000


def save_user_shards(df: DataFrame, path: str, users_per_shard: int = 24, mode: str = "overwrite") -> None:
    """Shards ``floor(user_id / users_per_shard)``, a folder for each thousand of them.

    Rows are dealt by ranges of (folder, shard, item), so that there are about as many
    files as tasks and folders together, however many the shards, and a heavy shard
    is spread by item; inside a file they are sorted, and a reader skips row groups of
    other shards. Rows without user form a shard of their own, without a number."""
    shard = F.floor(F.col("user_id") / F.lit(users_per_shard)).cast("int")
    df = df.withColumn("shard", shard).withColumn("folder", F.floor(F.col("shard") / F.lit(SHARDS_PER_FOLDER)).cast("int"))
    dealt = df.repartitionByRange("folder", "shard", "item_id").sortWithinPartitions("folder", "shard", "user_id")
    dealt.write.mode(mode).partitionBy("folder").parquet(path)


def load_user_shards(spark: SparkSession, path: str, shards=None) -> DataFrame:
    """Union of all shards, or of the listed ones: a list of numbers (folders are
    pruned, row groups skipped) or a table with a column ``shard`` (any number of them)."""
    df = spark.read.parquet(path)
    if isinstance(shards, DataFrame):
        df = df.join(shards.select("shard").distinct(), "shard", "left_semi")
    elif shards is not None:
        numbers = sorted(set(shards))
        df = df.filter(F.col("folder").isin(sorted({n // SHARDS_PER_FOLDER for n in numbers})) & F.col("shard").isin(numbers))
    return df.drop("shard", "folder")


def save_tables(tables: dict[str, DataFrame], path: str, partition_by_level: bool = True) -> None:
    """Write model/tree tables as Parquet, one folder per table."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        if partition_by_level and "level" in df.columns:
            w = w.partitionBy("level")
        w.parquet(f"{path.rstrip('/')}/{name}")


def load_table(spark: SparkSession, path: str, name: str, levels=None) -> DataFrame:
    df = spark.read.parquet(f"{path.rstrip('/')}/{name}")
    if levels is not None:
        df = df.filter(F.col("level").isin(list(levels)))
    return df


def table_names(spark: SparkSession, path: str) -> set[str]:
    """The tables that ``save_tables`` wrote under ``path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return {f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)}


def save_tree(tree, path: str) -> None:
    """Splits, nodes, the salted assignment, biases, residuals and parameters: what
    routing, scoring and further growth read."""
    spark = tree.splits.sparkSession
    meta = spark.createDataFrame([(json.dumps({"mean": tree.mean, "levels": tree.levels, "split_counts": tree.split_counts, "params": tree.params}),)], "meta string")
    save_tables(
        {
            "tree_split": tree.splits,
            "node": tree.nodes(),
            "node_assignment": tree.salted_assignment,
            "user_bias": tree.bias,
            "residual": tree.user_rows,
            "meta": meta,
        },
        path,
    )


def load_tree(spark: SparkSession, path: str):
    """The :class:`InterviewTree` that ``save_tree`` wrote."""
    from coldsplit.operators.tree import InterviewTree

    meta = json.loads(load_table(spark, path, "meta").first()["meta"])
    salted = load_table(spark, path, "node_assignment").select("level", "user_id", "salt", "node")
    splits = load_table(spark, path, "tree_split")
    return InterviewTree(
        splits=splits.select("level", *[c for c in splits.columns if c != "level"]),
        assignment=salted.filter("salt = 0").select("level", "node", "user_id"),
        bias=load_table(spark, path, "user_bias"),
        user_rows=load_table(spark, path, "residual"),
        salted_assignment=salted,
        salted_by_level=[salted.filter(F.col("level") == lv).drop("level") for lv in range(meta["levels"] + 1)],
        node_table=load_table(spark, path, "node").select("level", "node", "n_users"),
        **meta,
    )
