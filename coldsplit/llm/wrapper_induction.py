"""HTML extraction by wrapper induction: what pages of a host have in common is
template, what varies is content.

1. Each page is parsed once: its skeleton (block-level elements, repeats merged)
   and its blocks of text outside menus, headers, footers and other parts that
   markup names. The blocks are written; html is not read again.
2. The distinct skeletons of a host are aligned by simple tree matching and merged
   into its wrapper, ``FOLD`` at a time in rounds, so a host of any size is a tree
   of small merges. Each skeleton then maps its nodes to slots of the wrapper.
3. Of each slot the different texts and the different pages that fill it are
   counted; pages with equal texts count once. A slot that ``PAGES`` or more
   pages fill with hardly any variety is template. Hosts with fewer pages are
   judged by the same path of labels on all hosts.
4. The blocks of a page outside template slots are its text.

The slot with most different text of a host is never template (a host may hold copies of
one article), nor is the main heading; inside an article element a slot must be
all but constant.

Defined results: null or empty html, and pages without text, give an empty text;
a null url or one without host belongs to no host and is judged by label paths
alone; repeated rows are pages of their own; very long pages are read whole; html
that is cut off or badly nested is read like a browser would, roughly; equal
counts need no order; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldsplit.llm import dom
from coldsplit.llm.common import parallel, table
from coldsplit.operators.skew import salted_join
from coldsplit.session import Scratch, bounded_broadcast, write_table

FOLD = 32  # skeletons merged in one go, about
PAGES = 12  # different pages that must fill a slot before it is judged
VARIETY = 8  # template: at most one different text for so many pages
MAIN_VARIETY = 64  # the same inside an article element
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
PARSED = "page_id long, url string, host string, sid string, skeleton string, print long, blocks array<struct<node:int,text:string,kind:int>>"


def parse_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: host, skeleton and its digest, a fingerprint of the texts,
    and the blocks that may be main text."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, skeletons, prints, ends, nodes, texts, kinds = [], [], [], [0], [], [], []
            for value in batch.column(3):
                skeleton, blocks = dom.parse(value.as_py() or "")
                sids.append(hashlib.blake2b(skeleton.encode(), digest_size=16).hexdigest())
                skeletons.append(skeleton)
                text = "\n".join(t for _, t, _ in blocks).encode("utf-8", "replace")
                prints.append(int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big", signed=True))
                nodes.extend(n for n, _, _ in blocks)
                texts.extend(t.encode("utf-8", "replace").decode() for _, t, _ in blocks)
                kinds.extend(k for _, _, k in blocks)
                ends.append(len(nodes))
            struct = pa.StructArray.from_arrays([pa.array(nodes, pa.int32()), pa.array(texts, pa.string()), pa.array(kinds, pa.int32())], ["node", "text", "kind"])
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(sids, pa.string()), pa.array(skeletons, pa.string()), pa.array(prints, pa.int64()), found],
                ["page_id", "url", "host", "sid", "skeleton", "print", "blocks"],
            )

    c = {n: F.col(f"`{n}`") for n in (page_id, url, html)}
    host = F.lower(F.regexp_extract(F.coalesce(c[url].cast("string"), F.lit("")), HOST, 1))
    rows = pages.select(c[page_id].cast("long").alias("page_id"), c[url].cast("string").alias("url"), host.alias("host"), c[html].cast("string").alias("html"))
    return rows.mapInArrow(parse, PARSED)


def induce(tmp: Scratch, skeletons: DataFrame) -> DataFrame:
    """(host, wrapper) from the distinct (host, skeleton) rows. A round merges the
    skeletons of a host in blocks of about ``FOLD``, until each host has one."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "skeleton": [dom.merge(sorted(pdf["skeleton"]))]})

    done = None
    rows = skeletons.select("host", "skeleton")
    while True:
        counts = rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / F.lit(FOLD)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
        single, several = counts.filter("n = 1").select("host"), counts.filter("n > 1").select("host", "blocks")
        n_hosts = counts.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") > 1)).first()
        ready = rows.join(bounded_broadcast(single, n_hosts[0]), "host", "left_semi")
        done = ready if done is None else done.unionByName(ready)
        if not n_hosts[1]:
            return done.select("host", F.col("skeleton").alias("wrapper"))
        dealt = rows.join(bounded_broadcast(several, n_hosts[1]), "host").withColumn("block", F.pmod(F.xxhash64("skeleton"), F.col("blocks")))
        dealt = dealt.repartition(parallel(rows.sparkSession), "host", "block")
        rows = tmp.write(dealt.groupBy("host", "block").applyInPandas(fold, "host string, skeleton string").distinct(), "wrappers")


def slots(tmp: Scratch, skeletons: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, sid, slots array<int>, paths array<long>): of each node of a skeleton
    its slot of the host's wrapper, and the hash of its path of labels."""

    @F.pandas_udf("struct<slots:array<int>,paths:array<string>>")
    def place(wrapper: pd.Series, skeleton: pd.Series) -> pd.DataFrame:
        kept: dict[tuple[str, str], list[int]] = {}
        at = [kept[p] if p in kept else kept.setdefault(p, dom.places(*p)) for p in zip(wrapper, skeleton, strict=True)]
        return pd.DataFrame({"slots": at, "paths": [dom.paths(s) for s in skeleton]})

    joined = salted_join(skeletons, wrappers, ["host"], ["sid"], tmp=tmp)
    joined = joined.repartition(parallel(skeletons.sparkSession), "host", "sid").select("host", "sid", place("wrapper", "skeleton").alias("p"))
    return joined.select("host", "sid", F.col("p.slots").alias("slots"), F.transform("p.paths", lambda x: F.xxhash64(x)).alias("paths"))


def _judged(counts: DataFrame) -> DataFrame:
    """Adds ``template`` to counted slots: hardly any variety; null where too few
    pages fill the slot."""
    variety = F.when(F.col("kind") == dom.MAIN, MAIN_VARIETY).otherwise(VARIETY)
    verdict = F.when(F.col("kind") == dom.HEADING, F.lit(False)).otherwise(F.col("texts") * variety <= F.col("pages"))
    return counts.withColumn("template", F.when(F.col("pages") >= PAGES, verdict))


def template_nodes(tmp: Scratch, parsed: DataFrame, at: DataFrame) -> DataFrame:
    """(host, sid, nodes): the nodes of each skeleton that are template; skeletons
    without any have no row."""
    blocks = parsed.select("host", "sid", "print", F.explode("blocks").alias("b")).select(
        "host", "sid", "print", "b.node", F.xxhash64("b.text").alias("text"), F.length("b.text").alias("chars"), "b.kind"
    )
    seen = blocks.groupBy("host", "sid", "node", "text", "print").agg(F.max("kind").alias("kind"), F.max("chars").alias("chars"))
    seen = salted_join(seen, at, ["host", "sid"], ["print", "node"], tmp=tmp)
    seen = tmp.write(
        seen.select("host", "sid", "node", "text", "print", "kind", "chars", F.element_at("slots", F.col("node") + 1).alias("slot"), F.element_at("paths", F.col("node") + 1).alias("path")), "slots"
    )
    size = [F.count_distinct("text").alias("texts"), F.count_distinct("print").alias("pages"), F.max("kind").alias("kind")]
    own = seen.filter("host <> ''")
    by_host = own.groupBy("host", "slot").agg(*size)
    # a text counts once, however many pages show it
    held = own.groupBy("host", "slot", "text").agg(F.max("chars").alias("chars")).groupBy("host", "slot").agg(F.sum("chars").alias("chars"))
    main = held.groupBy("host").agg(F.max(F.struct("chars", F.negative("slot").alias("s"))).alias("m")).select("host", (-F.col("m.s")).alias("main_slot"))
    by_host = _judged(by_host).join(main, "host").withColumn("template", F.col("template") & (F.col("slot") != F.col("main_slot")))
    by_path = _judged(seen.groupBy("path").agg(*size)).select("path", F.col("template").alias("anywhere"))
    nodes = seen.select("host", "sid", "node", "slot", "path").distinct()
    verdict = nodes.join(by_host.select("host", "slot", "template", "main_slot"), ["host", "slot"], "left").join(by_path, "path", "left")
    # a host's own pages decide; few pages, or no host: the path on all hosts
    template = F.coalesce("template", F.col("anywhere") & ~F.coalesce(F.col("slot") == F.col("main_slot"), F.lit(False)), F.lit(False))
    return verdict.filter(template).groupBy("host", "sid").agg(F.collect_set("node").alias("nodes"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text): the main text of each page, blocks joined by an empty line."""
    with Scratch(pages.sparkSession) as tmp:
        parsed = write_table(parse_pages(pages, page_id, url, html), "parsed")  # the result reads it
        skeletons = tmp.write(parsed.groupBy("host", "sid").agg(F.first("skeleton").alias("skeleton")), "skeletons")
        wrappers = tmp.write(induce(tmp, skeletons.filter("host <> ''")).unionByName(skeletons.filter("host = ''").limit(1).select("host", F.lit("0 body").alias("wrapper"))), "wrapper")
        at = tmp.write(slots(tmp, skeletons, wrappers), "places")
        template = write_table(template_nodes(tmp, parsed, at), "template")
        rows = salted_join(parsed.select("page_id", "url", "host", "sid", "blocks"), template, ["host", "sid"], ["page_id"], "left")
        kept = F.filter("blocks", lambda b: F.col("nodes").isNull() | ~F.array_contains("nodes", b["node"]))
        text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
        return rows.select("page_id", "url", text.alias("text"))


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
