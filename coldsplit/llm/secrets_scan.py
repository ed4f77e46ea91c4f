"""Secret scans: patterns, and the guess cost of values in credential contexts.

Three base patterns (assignments, access keys, long hex runs) are found in every
whole text. The method then looks at every value that stands in a credential
context (wider than the base: password-like names before : or =, and the
password part of a URL's user info) and asks how many guesses it is worth: a
dynamic program over its characters finds the cheapest way to write it as a row
of spans, each a dictionary word, a date, a repeat, a keyboard walk or brute
force. Values over ``min_log10`` guesses become spans of kind `guess`; weak
values, such as plain words, don't. Base spans stay as they are.

The dictionary (word -> rank) comes from a public tokenizer's vocabulary, whose
entries are ordered by frequency; its path is a parameter and its size is fixed
by that file. Texts are scanned row by row in Python workers, nothing is
shuffled; a cheap substring test skips the patterns that cannot match.

Defined results: null text is empty and has no spans; positions are code points,
ends exclusive; rows are independent, so repeated rows repeat their result; an
empty table gives an empty result; extra columns pass through, whatever their
names. Values are priced whole, however long; very long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import json
import math
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldsplit.llm.common import table

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
MIN_LOG10 = 8.0
KINDS = ("assign", "access", "hex", "guess")

# Fixed values of the contract: the base patterns.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run is taken whole, so shorter runs never hide a longer one
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Credential contexts of the method; group 1 is the value.
CONTEXT = re.compile(
    r"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|access_?key|private_?key|credential|auth(?:orization)?|login)["']?[\x20\t]*(?:[:=]|(?i:is)\x20)[\x20\t]*["']?([^\s"'<>,;]{6,})""",
    re.ASCII,
)
URL_CONTEXT = re.compile(r"://[^\s/:@]+:([^\s/@]{6,})@")
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "login")

# Rows of a keyboard, read both ways.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@430!1$57", "aaeoiisst")


def _neighbours() -> dict[str, str]:
    near: dict[str, set] = {}
    for r, row in enumerate(KEYBOARD):
        for i, c in enumerate(row):
            around = [row[i - 1] if i else "", row[i + 1] if i + 1 < len(row) else ""]
            for other in (r - 1, r + 1):
                if 0 <= other < len(KEYBOARD):
                    around += [KEYBOARD[other][j] for j in (i - 1, i, i + 1) if 0 <= j < len(KEYBOARD[other])]
            near[c] = {x for x in around if x}
    return {c: "".join(sorted(v)) for c, v in near.items()}


NEAR = _neighbours()
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")


def _alphabet(value: str) -> int:
    n = 0
    n += 10 if re.search(r"[0-9]", value) else 0
    n += 26 if re.search(r"[a-z]", value) else 0
    n += 26 if re.search(r"[A-Z]", value) else 0
    n += 33 if re.search(r"[^0-9a-zA-Z]", value) else 0
    return max(n, 2)


def guess_cost(value: str, ranks: dict[str, int], limit: float = math.inf) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses the cheapest segmentation needs, and its spans (kind,
    start, end). Each span multiplies the guesses, and by 2 more for where it ends.

    Every span costs something, so a prefix worth ``limit`` or more is no part of a
    segmentation under it and is left out: the result is exact under ``limit``, and
    infinity with no spans from there on. A limit keeps repeats and walks, whose costs
    grow with their length, short, so that long values take time in proportion."""
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    per_char = math.log10(10 if value.isdigit() else 16 if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) else _alphabet(value))
    best = [math.inf] * (n + 1)
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    best[0] = 0.0
    border = math.log10(2)
    far = 0  # the last position reached under the limit
    brute, begin = math.inf, 0  # the cheapest brute-force span under way, and where it began

    def offer(kind: str, i: int, j: int, cost: float) -> bool:
        """Whether the span stays under the limit."""
        nonlocal far
        cost += best[i] + border
        if cost >= limit:
            return False
        if cost < best[j]:
            best[j], back[j], far = cost, (kind, i), max(far, j)
        return True

    dates = {m.start(): m.end() for m in DATE.finditer(value)}
    for i in range(n):
        if i > far:
            return math.inf, []
        if best[i] < limit:
            if best[i] + border < brute:
                brute, begin = best[i] + border, i
            _spans_from(i, value, low, plain, ranks, per_char, dates, offer)
        brute += per_char  # brute force goes on from where it is cheapest: any length
        if brute < min(best[i + 1], limit):
            best[i + 1], back[i + 1], far = brute, ("brute", begin), max(far, i + 1)
    if best[n] >= limit:
        return math.inf, []
    spans, j = [], n
    while j:
        kind, i = back[j]
        spans.append((kind, i, j))
        j = i
    return best[n], spans[::-1]


def _spans_from(i: int, value: str, low: str, plain: str, ranks: dict[str, int], per_char: float, dates: dict[int, int], offer) -> None:
    """Offer every word, date, walk and repeat that begins at i."""
    n = len(value)
    for j in range(i + 3, min(n, i + 24) + 1):
        word, shape = low[i:j], value[i:j]
        rank = ranks.get(word)
        leet = rank is None
        if leet:
            rank = ranks.get(plain[i:j])
        if rank is not None:
            case = 1 if shape.islower() or not shape.isalpha() else 2 if shape.istitle() or shape.isupper() else 2 ** min(10, sum(c.isupper() for c in shape))
            offer("word", i, j, math.log10(rank + 1) + math.log10(case) + (math.log10(2 ** sum(a != b for a, b in zip(word, plain[i:j], strict=True))) if leet else 0))
    if i in dates:
        offer("date", i, dates[i], math.log10(365 * 120 if dates[i] - i > 4 else 120))
    j = i + 1  # a keyboard walk: turns cost a choice of neighbours
    steps = 0.0
    while j < n and low[j] in NEAR.get(low[j - 1], ""):
        straight = j >= i + 2 and _step(low[j - 2], low[j - 1]) == _step(low[j - 1], low[j])
        steps += 0.0 if straight else math.log10(6)
        j += 1
        if j - i >= 3 and not offer("walk", i, j, math.log10(47) + steps + math.log10(j - i)):
            break
    for size in range(1, (n - i) // 2 + 1):  # a unit that repeats
        if not offer("repeat", i, i, per_char * size):  # longer units cost more still
            break
        unit, j = value[i : i + size], i + size
        while value.startswith(unit, j):
            j += size
            if j - i >= 3 and not offer("repeat", i, j, per_char * size + math.log10((j - i) // size)):
                break


def _step(a: str, b: str):
    places = [next(((r, row.index(c)) for r, row in enumerate(KEYBOARD) if c in row), (9, 9)) for c in (a, b)]
    return places[1][0] - places[0][0], places[1][1] - places[0][1]


def find_spans(text: str, ranks: dict[str, int], min_log10: float) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by start, then kind as listed."""
    spans: list[tuple[str, int, int]] = []
    low = text.lower()
    values: dict[tuple[int, int], str] = {}
    if any(h in low for h in ASSIGN_HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[1]) >= 8:
                spans.append(("assign", m.start(), m.end()))
            values[m.span(1)] = m[1]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if any(h in low for h in CONTEXT_HINTS):
        values |= {m.span(1): m[1] for m in CONTEXT.finditer(text)}
    if "://" in text:
        values |= {m.span(1): m[1] for m in URL_CONTEXT.finditer(text)}
    for span, value in values.items():
        if guess_cost(value, ranks, min_log10)[0] >= min_log10:
            spans.append(("guess", *span))
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def load_ranks(path: str = VOCABULARY) -> dict[str, int]:
    """Words of at least three letters, ranked by their place in the vocabulary."""
    with open(path, encoding="utf-8") as f:  # a vocabulary beside the driver
        vocabulary = json.load(f)["model"]["vocab"]
    words = (w.removesuffix("</w>") for w, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if w.endswith("</w>"))
    return {w: i + 1 for i, w in enumerate(w for w in words if len(w) >= 3 and w.isalpha())}


def scan(docs: DataFrame, text: str = "text", min_log10: float = MIN_LOG10, vocabulary: str = VOCABULARY) -> DataFrame:
    """(row, spans): each input row as a struct, and an array of (kind, start, end)."""
    sent = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))  # the words of one vocabulary file

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t or "", sent.value, min_log10)] for t in texts], dtype=object)

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), spans(text).alias("spans"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return out.select("row.doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
