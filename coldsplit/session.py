"""Session-level helpers: checkpoint folder, scratch folders, sizing knobs.

The engine never creates or stops a SparkSession; it takes the caller's.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Largest side we let Spark broadcast when its row count is only known by a
# count we ran ourselves (tree splits, node sets, candidates): rows, and bytes.
BROADCAST_ROW_LIMIT = 2_000_000
BROADCAST_BYTE_LIMIT = 256 << 20
ARRAY_ITEMS = 64  # items assumed in an array column when the caller names no number


def row_bytes(df: DataFrame, array_items: int = ARRAY_ITEMS) -> int:
    """Bytes a row of ``df`` takes in a broadcast hash table, by its schema."""
    from pyspark.sql import types as T

    def width(t) -> int:
        if isinstance(t, T.ArrayType):
            return 16 + array_items * width(t.elementType)
        if isinstance(t, T.MapType):
            return 16 + array_items * (width(t.keyType) + width(t.valueType))
        if isinstance(t, T.StructType):
            return 8 + sum(width(f.dataType) for f in t.fields)
        return 64 if isinstance(t, (T.StringType, T.BinaryType)) else 8

    return 32 + width(df.schema)


def bounded_broadcast(df: DataFrame, rows_bound: int, array_items: int = ARRAY_ITEMS) -> DataFrame:
    """Broadcast ``df`` only when its row count - proven by a count we ran or
    by construction (one row per tree node, per level, ...) - and the bytes of
    that many rows are small; otherwise leave the join to a shuffle."""
    from pyspark.sql import functions as F

    fits = rows_bound <= BROADCAST_ROW_LIMIT and rows_bound * row_bytes(df, array_items) <= BROADCAST_BYTE_LIMIT
    return F.broadcast(df) if fits else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    Reads ``spark.checkpoint.dir`` (or the SparkContext setting). Only when it
    is unset *and* the master is local (tests, benches) a private folder is
    created; on a cluster an unset folder is an error, because a machine-local
    folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        try:
            conf_dir = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            conf_dir = None
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if re.fullmatch(r"local(\[.*\])?", sc.master):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="coldsplit-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/...)"
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch-{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


ROWS_PER_BUCKET = 2_000_000


def bucket_count(spark: SparkSession, rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Buckets for a table of ``rows`` rows: enough to keep every core busy (but
    no more than the session's shuffles have partitions while the table is
    small), and never over ``rows_per_bucket`` rows each."""
    few = min(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    return max(1, few, -(-rows // rows_per_bucket))


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint into the shared folder.

    The frame is persisted first so the checkpoint write does not recompute
    it (a reliable RDD checkpoint otherwise runs the plan twice).
    """
    ensure_checkpoint_dir(df.sparkSession)
    df = df.persist()
    out = df.checkpoint(eager=True)
    df.unpersist()
    return out


def write_bucketed(df: DataFrame, name: str, cols: list[str], buckets: int, sort: list[str] | None = None, dealt: bool = False) -> DataFrame:
    """Write ``df`` as a table bucketed by ``cols`` under the shared checkpoint
    folder and read it back: one file per bucket, whatever the input's
    partitions. Joins on exactly ``cols`` against another frame hash-partitioned
    the same way need no shuffle of this side, and the files outlive any
    executor. ``sort`` orders the rows of a file; ``dealt`` says that ``df`` is
    already hash-partitioned by ``cols`` over ``buckets`` partitions."""
    spark = df.sparkSession
    table = f"coldsplit_{name}_{uuid.uuid4().hex[:12]}".replace("-", "_")
    path = scratch_path(spark, table)
    writer = (df if dealt else df.repartition(buckets, *cols)).write.bucketBy(buckets, *cols)
    if sort:
        writer = writer.sortBy(*sort).option("compression", "zstd")
    writer.option("path", path).saveAsTable(table)
    _SCRATCH_TABLES[table] = path
    return spark.table(table)


_SCRATCH_TABLES: dict[str, str] = {}


def scratch_tables() -> set[str]:
    return set(_SCRATCH_TABLES)


def drop_scratch_tables(spark: SparkSession, names=None) -> int:
    """Drop bucketed scratch tables (all, or ``names``): the catalog entry and
    the files. Call once the frames are no longer needed."""
    chosen = [t for t in _SCRATCH_TABLES if names is None or t in names]
    for t in chosen:
        path = _SCRATCH_TABLES.pop(t)
        spark.sql(f"DROP TABLE IF EXISTS {t}")
        delete_path(spark, path)
    return len(chosen)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark reads it by."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` only reads files, with columns chosen and rows filtered: reading
    it twice repeats no other work."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName() in ("LogicalRelation", "Relation", "RelationV2")


class Scratch:
    """The scratch tables of one computation. They are deleted when the block
    ends, so a result that outlives it is written by :func:`write_table` inside::

        with Scratch(spark) as tmp:
            seen = tmp.write(df, "seen")
            return write_table(seen.groupBy("key").count(), "result")
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: list[str] = []
        self._tables: set[str] = set()

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """As :func:`write_table`."""
        path = scratch_path(self.spark, name)
        self._paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, cols: list[str], buckets: int, sort: list[str] | None = None, dealt: bool = False) -> DataFrame:
        """As :func:`write_bucketed`."""
        before = scratch_tables()
        out = write_bucketed(df, name, cols, buckets, sort, dealt)
        self._tables |= scratch_tables() - before
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete one table of this scope, as soon as its last reader is done."""
        files = df.inputFiles()
        for path in [p for p in self._paths if any(p.split("/")[-1] in f for f in files)]:
            self._paths.remove(path)
            delete_path(self.spark, path)
        gone = {t for t in self._tables if any(_SCRATCH_TABLES[t].split("/")[-1] in f for f in files)}
        self._tables -= gone
        drop_scratch_tables(self.spark, gone)

    def release(self) -> None:
        for path in self._paths:
            delete_path(self.spark, path)
        self._paths = []
        drop_scratch_tables(self.spark, self._tables)
        self._tables = set()

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *failure) -> None:
        self.release()


@contextlib.contextmanager
def session_conf(spark: SparkSession, **conf: str):
    """SQL settings (dots written as ``__``) for the jobs of a block; the
    caller's own come back after it."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: later reads are plain scans (filters and columns pushed down)
    instead of re-running the upstream plan, and the files survive executor
    loss."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
