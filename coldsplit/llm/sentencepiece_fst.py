"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into three machines, composed lazily with each text:

* normaliser: the model's character-map rules (leftmost, longest), white space
  rules, and the escape of a space to U+2581;
* pieces: a lattice whose arcs read a piece's characters and write its id; a
  character no piece has is read by an arc that writes its byte pieces (or the
  unknown id if the model has none);
* grammar: arc weights in the tropical semiring. A unigram model weighs an arc
  -score. A BPE model allows piece b after piece a (weight 0) if and only if
  merging "ab" alone gives exactly a, b, and forbids it (weight infinity)
  otherwise. A row of pieces is the BPE result of its text if and only if all
  its neighbours are allowed: a merge across a border would happen in the pair
  as it happens in the text, because each picks the best of the merges at hand.
  So one path has finite weight, and it is the library's result.

The shortest path of a unigram model is a dynamic program over positions. In a
BPE lattice each prefix has one finite path, so one state per position is enough
and a depth-first search finds the path. Texts are cut where every
path must pass (before U+2581 and between word characters and others, if no piece
reads across)
and paths of the cuts are remembered in a bounded cache.

Defined results: null text encodes to null and decodes to null; empty text to an
empty array and back; a round trip gives the normalised text (for the identity
rule the text itself, but for U+2581, which reads as a space); very long texts
are encoded whole; of unigram paths of equal cost the one found first stays; extra
columns pass through.
"""

from __future__ import annotations

import math
import re
import struct
import sys
from array import array
from collections.abc import Iterator
from itertools import pairwise
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldsplit.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 60_000  # cuts remembered per generation and worker; two generations live
SLICE = 2 << 20  # bytes of text that a worker codes at once
BLOCK = 1 << 20  # characters or ids of a longer text held as Python objects at once
MARK = "▁"
# Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


def _fields(b: bytes):
    """(number, value) of a serialised message; bytes stay bytes."""
    i = 0

    def varint(i):
        v = s = 0
        while True:
            v |= (b[i] & 127) << s
            s += 7
            i += 1
            if b[i - 1] < 128:
                return v, i

    while i < len(b):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            v, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            v, i = b[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            v, i = b[i : i + n], i + n
        yield tag >> 3, v


class Model:
    """What the transducer needs of a model file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.dummy, self.squeeze, self.escape, charsmap = UNIGRAM, True, True, True, b""
        for number, v in _fields(data):
            if number == 1:
                f = dict(_fields(v))
                self.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(_fields(v)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(v))
                self.dummy, self.squeeze, self.escape = bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
                charsmap = f.get(2, b"")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models have a piece lattice")
        self.rules = _rules(charsmap)


def _rules(charsmap: bytes) -> dict[str, str]:
    """The normaliser's rewrite rules: a double-array trie of byte strings,
    followed by the null-terminated replacements it points into."""
    if not charsmap:
        return {}
    (size,) = struct.unpack_from("<I", charsmap)
    units = struct.unpack_from(f"<{size // 4}I", charsmap, 4)
    texts, rules = charsmap[4 + size :], {}

    def offset(u: int) -> int:
        return (u >> 10) << ((u & 512) >> 6)

    stack = [(offset(units[0]), b"")]
    while stack:
        base, key = stack.pop()
        for c in range(256):
            at = base ^ c
            if at >= len(units) or units[at] & 0x800000FF != c:
                continue
            if c == 0:
                continue
            here = at ^ offset(units[at])
            if units[at] >> 8 & 1:
                v = units[here] & 0x7FFFFFFF
                try:
                    rules[(key + bytes([c])).decode()] = texts[v : texts.index(b"\0", v)].decode()
                except UnicodeDecodeError:
                    pass
            stack.append((here, key + bytes([c])))
    return rules


def _characters(run: bytes) -> str:
    """UTF-8 text; each byte that is in no valid character gives U+FFFD."""
    out = []
    while run:
        try:
            return "".join([*out, run.decode()])
        except UnicodeDecodeError as e:
            out += [run[: e.start].decode(), "\ufffd"]
            run = run[e.start + 1 :]
    return "".join(out)


class Transducer:
    def __init__(self, model: Model):
        self.m = model
        self.ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
        self.score = {i: s for i, (_, s, _) in enumerate(model.pieces)}
        self.text = [p for p, _, _ in model.pieces]
        self.kinds = [k for _, _, k in model.pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(model.pieces) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next((i for i, (_, _, k) in enumerate(model.pieces) if k == UNKNOWN), 0)
        # arcs as a trie: a node is (look-up of its children by character, id or -1)
        tree: dict = {}
        for piece, i in self.ids.items():
            level = tree
            for c in piece:
                level = level.setdefault(c, {})
            level[""] = i

        def node(level: dict):
            return {c: node(x) for c, x in level.items() if c}.get, level.get("", -1)

        self.arcs = node(tree)[0]
        normal = [s for _, s, k in model.pieces if k == NORMAL]
        self.unknown_cost = UNKNOWN_PENALTY - min(normal, default=0.0)
        if any(k == USER for k in self.kinds):
            raise ValueError("user-defined pieces are matched before the lattice and are not supported")
        # cuts: no piece reads across them, so every path passes there
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            cut = ".+"
        else:
            # word characters that never stand beside another sort in a piece
            pairs = {(x, y) for p in self.ids for x, y in pairwise(p) if MARK not in (x, y)}
            mixed: set[str] = set()
            while more := {c for pair in pairs for c in pair if self._word(c, mixed) and not all(self._word(d, mixed) for d in pair)}:
                mixed |= more
            also = "".join(map(re.escape, sorted(mixed)))
            other = f"(?:[{also}]|[^\\w{MARK}])" if mixed else f"[^\\w{MARK}]"
            cut = rf"{MARK}*[^\W{also}]+|{MARK}*{other}+|{MARK}+\Z"
        self.cut = re.compile(cut, re.S)
        # what an id writes when it is decoded; None: a byte of a longer character
        self.plain = [
            (chr(self.byte_of[i]) if self.byte_of[i] < 128 else None) if k == BYTE else "" if k == CONTROL else " ⁇ " if k == UNKNOWN
            else p.replace(MARK, " ") if model.escape else p
            for i, (p, _, k) in enumerate(model.pieces)
        ]
        self.rule = re.compile("|".join(map(re.escape, sorted(model.rules, key=len, reverse=True)))) if model.rules else None
        self.paths: list[dict[str, bytes]] = [{}, {}]  # of cuts: ids as 32-bit numbers
        self.pairs: list[dict[int, bool]] = [{} for _ in range(len(model.pieces) + 1)]  # by the piece before, -1 last
        self.known = 0

    def normalise(self, text: str) -> str:
        if self.rule:
            text = self.rule.sub(lambda x: self.m.rules[x[0]], text)
        if self.m.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if self.m.dummy:
            text = " " + text
        return text.replace(" ", MARK) if self.m.escape else text

    def merge(self, text: str) -> list[str]:
        """The plain merge procedure, for the few short texts of the grammar."""
        parts, ids, score = list(text), self.ids, self.score
        while True:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and score[k] > best:
                    best, at = score[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    @staticmethod
    def _word(c: str, mixed: set[str]) -> bool:
        return c not in mixed and re.match(r"\w", c) is not None

    def _allowed(self, a: int, b: int) -> bool:
        x, y = self.text[b], self.text[a] if a >= 0 else ""
        if self.known >= 3 * CACHE:
            for row in self.pairs:
                row.clear()
            self.known = 0
        self.known += 1
        v = self.pairs[a][b] = self.merge(y + x) == ([y, x] if a >= 0 else [x])
        return v

    def _fallback(self, c: str) -> tuple[int, ...]:
        if not self.bytes:
            return (self.unknown,)
        return tuple(self.bytes[b] for b in c.encode())

    def _bpe(self, s: str) -> list[int]:
        """The one path of finite weight, searched longest arc first. A prefix has
        one path, so a position that led nowhere need not be entered again."""
        arcs, n, pairs = self.arcs, len(s), self.pairs
        path: list[tuple] = []  # (position, arc before, arcs left to try)
        dead: set[int] = set()
        i, a = 0, -1
        while i < n:
            tries: list[tuple[int, int]] = []
            get, j = arcs, i
            for c in s[i:]:
                node = get(c)
                if node is None:
                    break
                get, b = node
                j += 1
                if b >= 0:
                    tries.append((j, b))
            if not tries:  # no piece has this character; no merge crosses it
                tries.append((i + 1, -1))
            while True:
                if not tries:
                    dead.add(i)
                    i, a, tries = path.pop()
                    continue
                j, b = tries.pop()
                if j in dead:
                    continue
                if b >= 0:
                    ok = pairs[a].get(b)
                    if not (self._allowed(a, b) if ok is None else ok):
                        continue
                path.append((i, a, tries))
                i, a = j, b
                break
        out: list[int] = []
        path.append((n, a, tries if n else []))
        for k in range(len(path) - 1):
            b = path[k + 1][1]
            if b < 0:
                out += self._fallback(s[path[k][0]])
            else:
                out.append(b)
        return out

    def _unigram(self, s: str) -> list[int]:
        arcs, score, n = self.arcs, self.score, len(s)
        cost = [math.inf] * (n + 1)
        arc: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            get, j = arcs, i
            for c in s[i:]:
                node = get(c)
                if node is None:
                    break
                get, b = node
                j += 1
                if b >= 0 and cost[i] - score[b] < cost[j]:
                    cost[j], arc[j] = cost[i] - score[b], (i, b)
            node = arcs(s[i])
            if (node is None or node[1] < 0) and cost[i] + self.unknown_cost < cost[i + 1]:
                cost[i + 1], arc[i + 1] = cost[i] + self.unknown_cost, (i, -1)
        out: list[int] = []
        j = n
        while j:
            i, b = arc[j]
            out += reversed(self._fallback(s[i])) if b < 0 else [b]
            j = i
        return out[::-1]

    def _path(self, s: str) -> bytes:
        """The path of a cut, remembered. Two generations are kept: what is still in
        use moves from the old one to the young one."""
        young, old = self.paths
        ids = old.get(s)
        if ids is None:
            ids = array("i", self._bpe(s) if self.m.kind == BPE else self._unigram(s)).tobytes()
        if len(young) >= CACHE:
            self.paths[:] = [{}, young]
        self.paths[0][s] = ids
        return ids

    def ids_of(self, text: str) -> bytes:
        """The ids as 32-bit numbers."""
        s, get = self.normalise(text), self.paths[0].get
        cuts = self.cut.findall(s) if len(s) <= BLOCK else (x[0] for x in self.cut.finditer(s))
        return b"".join([get(c) or self._path(c) for c in cuts])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.ids_of(text), np.int32)

    def decode(self, ids) -> str:
        """The inverse: ids to pieces, bytes to characters, marks to spaces."""
        ids, out, a = np.asarray(ids), [], 0
        while a < len(ids):
            b = min(len(ids), a + BLOCK)
            while b < len(ids) and self.plain[ids[b]] is None:  # a character's bytes stay together
                b += 1
            out.append(self._plain(ids[a:b].tolist()))
            a = b
        if self.m.dummy:
            first = next((i for i in ids if self.kinds[i] != CONTROL), None)
            if first is not None and self.kinds[first] not in (UNKNOWN, BYTE):
                return "".join(out).removeprefix(" ")
        return "".join(out)

    def _plain(self, ids: list[int]) -> str:
        parts = [self.plain[i] for i in ids]
        if None in parts:  # bytes that make up a character together
            run = bytearray()
            for k, i in enumerate(ids):
                if parts[k] is None:
                    run.append(self.byte_of[i])
                    parts[k] = ""
                    if k + 1 == len(parts) or parts[k + 1] is not None:
                        parts[k] = _characters(bytes(run))
                        run = bytearray()
        return "".join(parts)

    def ids_array(self, texts: pa.Array) -> pa.Array:
        """The ids of an array of texts, written to one Arrow buffer."""
        rows = [b"" if t is None else self.ids_of(t) for t in texts.to_pylist()]
        ends = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r) // 4 for r in rows], out=ends[1:])
        values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(rows))])
        return pa.ListArray.from_arrays(pa.array(ends), values, mask=texts.is_null())

    def texts_array(self, rows: pa.Array) -> pa.Array:
        """The texts of an array of id lists."""
        return pa.array([None if r.values is None else self.decode(r.values.to_numpy(zero_copy_only=False)) for r in rows], pa.string())


def _read(spark: SparkSession, path: str):
    with open(path, "rb") as f:  # a model file beside the driver, a few MB
        return spark.sparkContext.broadcast(f.read())


def _compiled(data: bytes) -> Transducer:
    """The worker process's transducer of a model. Functions reach a worker anew with
    each task; this place, and so the remembered paths, lasts as long as the process."""
    kept = sys.modules.setdefault("coldsplit_worker_state", ModuleType("coldsplit_worker_state")).__dict__.setdefault("transducers", {})
    key = xxhash.xxh3_128_hexdigest(data)
    if key not in kept:
        kept.clear()
        kept[key] = Transducer(Model(data))
    return kept[key]


def _slices(rows: pa.Array) -> Iterator[pa.Array]:
    """An array of texts or id lists in parts of about SLICE bytes; a larger row is
    a part of its own."""
    sizes = pc.binary_length(rows) if not pa.types.is_list(rows.type) else pc.multiply(pc.list_value_length(rows), 4)
    ends, a = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(ends, SLICE + (ends[a - 1] if a else 0), "right")))
        yield rows.slice(a, b - a)
        a = b


def _coder(spark: SparkSession, model: str, kind: str, code):
    """A function of a column; ``code`` turns one slice after the other, so that a
    worker holds an incoming batch and the results of one slice."""
    sent = _read(spark, model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fst = _compiled(sent.value)
        for rows in batches:
            for part in _slices(rows):
                yield code(fst, part)

    return F.arrow_udf(run, kind)


def encoder(spark: SparkSession, model: str = MODEL):
    """A function of a text column that gives its ids."""
    return _coder(spark, model, "array<int>", lambda fst, texts: fst.ids_array(texts))


def decoder(spark: SparkSession, model: str = MODEL):
    """A function of an id column that gives its text."""
    return _coder(spark, model, "string", lambda fst, rows: fst.texts_array(rows))


def _both(fst: Transducer, texts: pa.Array) -> pa.Array:
    ids = fst.ids_array(texts)
    return pa.StructArray.from_arrays([ids, fst.texts_array(ids)], ["ids", "decoded"])


def encode_and_decode(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """(row, ids, decoded): each input row as a struct, its ids and their text, both
    of one pass."""
    both = _coder(docs.sparkSession, model, "struct<ids:array<int>,decoded:string>", _both)
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), both(F.col(f"`{text}`")).alias("both"))
    return out.select("row", "both.ids", "both.decoded")


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "row.doc_id", "ids", F.size("ids").alias("n_ids"), F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("row.text")).alias("same_text"),
    )
