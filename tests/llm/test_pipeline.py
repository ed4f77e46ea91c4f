"""Each stage against a brute-force version on the rows its predecessor kept."""

import duckdb
import pytest
import sentencepiece

import __spark_entry__ as E
import corpus_pipeline as C
from coldsplit.llm import mixing, sentencepiece_fst, toxicity

from .helpers import empty_docs
from .test_line_dedup import brute
from .test_simhash import components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_small, tmp_path_factory):
    top = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        stage(spark, out[-1], sf_small).write.parquet(str(top / name))
        out.append(spark.read.parquet(str(top / name)))
    return out


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_columns(stages):
    for df in stages[1:-1]:
        assert sorted(df.columns) == sorted(COLUMNS)


def test_toxicity(spark, sf_small, stages):
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    model = toxicity.fit(stages[0], labels)
    want = [r for r in rows(stages[0]) if toxicity.score_text(r[1], *model) < 0.7]
    assert sorted(rows(stages[1])) == sorted(want)
    assert len(want) > 0.7 * stages[0].count()


def test_line_dedup(stages):
    before = rows(stages[1])
    want = brute([r[1] for r in before], 10)
    assert sorted(rows(stages[2])) == sorted((r[0], k, *r[2:4], len(k) if k != r[1] else r[4]) for r, k in zip(before, want, strict=True))


def test_near_copies(stages):
    before = rows(stages[2])
    want = {c for *_, c in components([r[:2] for r in before])}
    kept = rows(stages[3])
    assert sorted(r[0] for r in kept) == sorted(want)
    assert set(kept) <= set(before)


def test_mixing(stages):
    documents = stages[3].toPandas()  # noqa: F841  (read by DuckDB)
    con = duckdb.connect()
    con.register("documents", documents)
    want = [r for r in con.execute(f"SELECT doc_id, CAST(taken / size AS INT) FROM ({mixing.OP10_SQL}) WHERE taken > 0").fetchall()]
    got = stages[4].groupBy("doc_id").count().collect()
    assert sorted((r["doc_id"], r["count"]) for r in got) == sorted(want)


def test_tokens(stages):
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    text = {r[0]: r[1] for r in rows(stages[4])}
    out = stages[5].collect()
    assert len(out) == stages[4].count() and all(r["same_text"] for r in out)
    assert all(list(r["ids"]) == lib.encode(text[r["doc_id"]]) for r in out)


def test_run_equals_the_stages(spark, sf_small, stages):
    assert sorted(map(str, C.run(spark, sf_small).collect())) == sorted(map(str, stages[-1].collect()))


def test_empty_and_clashing_columns(spark, sf_small):
    docs = empty_docs(spark)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, sf_small)
        assert docs.count() == 0


def test_registered():
    names = set(E.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()}
    assert set(E.oracle_sql()) <= names
