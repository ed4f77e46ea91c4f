"""Host-level quality rules.

Each text is measured once (word and symbol counts, repeated lines, repeated
three-word windows) and tried against simple rules. Rule failures are summed by
host; a host's failure rate is shrunk towards the rate of all hosts by a beta
prior whose mean and strength are estimated from the hosts themselves (method
of moments), so a host of few documents is judged mostly by the prior. A host
with a shrunk rate over the limit for any rule loses all its documents, and the
verdict is joined back to them.

Only SQL functions: arrays inside a row for the text measures (nothing of a text
is shuffled), a combined aggregation by host, and a join that Spark broadcasts
when the hosts are few and splits when a host is hot. The measures are written
once to the shared checkpoint folder, without the texts.

Defined results: null text has no words (it fails the base rules); a null host
is a host of its own; repeated rows count each; an empty table gives an empty
result; extra columns pass through, whatever their names. Three-word windows are
compared by 64-bit hash within a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldsplit.llm.common import SPACES, WORD_RE, table, text_or_empty
from coldsplit.session import write_table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 20  # symbols per 100 words
MAX_DUP_LINE_PERCENT = 50  # repeated lines per 100 lines
MAX_HOST_RATE = 0.5
# Fixed values of the contract: the symbol characters.
SYMBOLS = "[#*$%&|<>]"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))


def _measure(docs: DataFrame, host: str, text: str) -> DataFrame:
    """One row per input row: row (struct), host and the base measures."""
    t = text_or_empty(text)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.col(host).alias("host"), t.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.select(
        "row", "host", _words(F.col("t")).alias("w"), lines.alias("lines"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    n = F.size("w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    df = df.select(
        "row", "host", "n_symbols", n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(windows, F.array().cast("array<bigint>")).alias("h"),
    )
    # texts without a repeated window (most) are done; in the others, sort the windows by hash and position
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("s", F.when(repeats, pairs)).drop("h")
    same = F.filter(
        F.transform("s", lambda e, k: F.when((e["h"] == F.get("s", k - 1)["h"]) | (e["h"] == F.get("s", k + 1)["h"]), e["i"])), lambda i: i.isNotNull()
    )
    df = df.withColumn("p", F.sort_array(same)).drop("s")
    # words covered by the repeated windows: each adds up to the start of the next, three at most
    covered = F.aggregate(
        F.transform("p", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("p", k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("p")


RULES = {
    "short": "n_words < {MIN_WORDS}",
    "repeats": "100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words",
    "dup_lines": "100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines",
}


def _host_verdicts(measured: DataFrame, limit: float) -> DataFrame:
    """(host, host_docs, host_rate, host_ok): host_rate is the highest shrunk rate of a rule."""
    fails = [F.sum(F.expr(rule.format(**globals())).cast("long")).alias(name) for name, rule in RULES.items()]
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), *fails)
    # the prior of each rule from the hosts' rates: mean m, variance v, strength k = m(1-m)/v - 1
    raw = {f"m_{r}": F.avg(F.col(r) / F.col("host_docs")) for r in RULES} | {f"v_{r}": F.var_pop(F.col(r) / F.col("host_docs")) for r in RULES}
    hosts = write_table(hosts, "hosts")
    prior = hosts.agg(*[c.alias(k) for k, c in raw.items()]).first()  # two numbers a rule
    rates = []
    for r in RULES:
        m, v = prior[f"m_{r}"] or 0.0, prior[f"v_{r}"] or 0.0
        k = max(m * (1 - m) / v - 1, 0.0) if v > 0 else 1e6
        rates.append((F.col(r) + F.lit(k) * F.lit(m)) / (F.col("host_docs") + F.lit(k)))
    rate = F.greatest(*rates)
    return hosts.select("host", "host_docs", rate.alias("host_rate"), (rate <= limit).alias("host_ok"))


def judge(docs: DataFrame, host: str = "source", text: str = "text", limit: float = MAX_HOST_RATE) -> DataFrame:
    """row (struct of the input columns but the text), the measures, base_failed,
    host_docs, host_rate and kept."""
    measured = write_table(_measure(docs, host, text), "measures")
    hosts = _host_verdicts(measured, limit).withColumnRenamed("host", "host1")
    out = measured.join(hosts, F.col("host").eqNullSafe(F.col("host1")))
    failed = F.expr(f"{RULES['short'].format(**globals())} OR {RULES['repeats'].format(**globals())}")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop("host1")


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
h AS (SELECT rid, i, w[i:i + 2] AS h FROM g),
c AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, h) AS n FROM h) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT i + o) AS n FROM c, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, n_symbols, len(lines) AS n_lines,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r ON w.rid = r.rid),
f AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE n_words < 50) AS a, count(*) FILTER (WHERE 100 * n_repeat_words > 50 * n_words) AS b,
      count(*) FILTER (WHERE 100 * n_symbols > 20 * n_words) AS c, count(*) FILTER (WHERE 100 * n_dup_lines > 50 * n_lines) AS e FROM m GROUP BY source),
u AS (SELECT source, n, unnest([a, b, c, e]) AS x, unnest([1, 2, 3, 4]) AS rule FROM f),
p AS (SELECT rule, avg(x / n) AS mean, var_pop(x / n) AS var FROM u GROUP BY rule),
v AS (SELECT source, max((x + k * mean) / (n + k)) <= 0.5 AS ok FROM (SELECT u.*, mean,
      CASE WHEN var > 0 THEN greatest(mean * (1 - mean) / var - 1, 0.0) ELSE 1e6 END AS k FROM u JOIN p USING (rule)) GROUP BY source)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND ok AS kept
FROM m JOIN v ON m.source IS NOT DISTINCT FROM v.source
"""
