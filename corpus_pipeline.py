"""The corpus pipeline over `documents`: each stage calls one operator, works on
all rows its predecessor kept, and is written as Parquet before the next one.

Every stage but the last returns the columns of its input. Null, empty and
very long texts, null ids, ties, repeated rows and extra columns have the results
that the operators' modules define; an empty table stays empty in every stage. SQL cannot express
the toxicity model, SimHash or the tokenizer, so ORACLE_SQL is None and the
pipeline is tested against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldsplit.llm import line_dedup, mixing, sentencepiece_fst, simhash, toxicity
from coldsplit.llm.common import table
from coldsplit.session import write_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold. The classifier is
    fitted on the labelled rows of the whole `documents` table."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score(docs, model) < toxicity.THRESHOLD)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that at least ten documents share; n_chars follows."""
    out = line_dedup.LineDedupIndex(spark).insert(docs).drop_lines(docs)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    changed = F.size("dropped") > 0
    return out.select(*[F.when(changed, new[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's share reads it."""
    return mixing.take(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, token ids and their number, and whether decoding
    gives the text back."""
    out = sentencepiece_fst.encode_and_decode(docs.select("doc_id", "source", "lang", "text"))
    return out.select("row.doc_id", "row.source", "row.lang", "ids", F.size("ids").alias("n_ids"), F.col("decoded").eqNullSafe(F.col("row.text")).alias("same_text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


REGISTRY = {"pipeline": (run, ORACLE_SQL)}
