"""Inputs and brute-force pieces shared by the tests."""

import re

import duckdb

from coldsplit.llm.common import table  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, lines int, kept string, size int, fp string, `group` int, host string, ids int, shard int, t string"
LONG = " ".join(f"w{i}" for i in range(3000)) + "\n" + "z" * 5000
TEXTS = [None, "", " \t\n\x0b", "One line.", "one line.", "ONE LINE. ", LONG, LONG, LONG + " x", "a\n\na\n \nb", "naïve Ünïcode text İ", "x" * 100_000, "Licence\nbody one", "licence \nbody two"]


def edge_rows():
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", None, "r", 1, "k", 2, "f", 3, "h", 4, 5, "t") for i, t in enumerate(TEXTS)]
    rows += [(None, "null id", "en", "s1", 3, *rows[0][5:]), (None, None, None, None, None, *rows[0][5:])]
    return rows + [rows[3], rows[3]]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def norm(v):
    return round(v, 4) if isinstance(v, float) else v


def same_as_sql(df, sql, sf, tables=("documents", "embeddings", "labels")):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = sorted((tuple(norm(v) for v in r) for r in res.fetchall()), key=repr)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*names).collect()), key=repr)
    assert sorted(df.columns) == sorted(names)
    assert got == want
