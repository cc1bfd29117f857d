"""Secret scans by grammar inference (operator 2).

Fixed patterns give base spans. Their values, in a bounded sample, are labelled credentials;
other tokens of the sample are labelled text. For each label a prefix tree
of character classes is folded into a probabilistic automaton by merging states whose frequencies of next
classes and of ends are statistically compatible (Hoeffding bound). Every token outside the base spans, of any length
and make, is then scored by the likelihood of its format: it is a secret if some credential automaton, with
its end, explains it better than the text automaton by ``MARGIN`` bits. Tokens whose classes exclude such a
margin, whatever the states, need no walk through the automata.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, table
from .wordhash import buffers, chunks, hashes, row_and_text, with_text

# Kinds in order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

SAMPLE = 4000  # labelled values of each label that are learned from, smallest hashes first
_BITS = 12  # of the hashes, by which the values are counted
READ = 256  # bytes of a labelled value that are learned from; scoring reads all of a token
ALPHA = 0.05
MARGIN = 40.0  # bits: odds of 2 ** 40; some 10 to 15 random characters of a known format in ordinary prose
STEPS = 256  # bytes of tokens that are walked side by side; the rest of longer ones goes token by token
_GROUPS = (b"0123456789", b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ", b"+/_=-.")
_CLASS = np.full(256, len(_GROUPS) - 1, np.uint8)
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _i
_N = len(_GROUPS)
_HEX_BYTE, _TOKEN_BYTE = np.zeros(256, bool), np.zeros(256, bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True
_TOKEN_BYTE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True


def base_spans(text: bytes, assign: bool = True, access: bool = True, hexes: bool = True) -> list[tuple[int, int, str, int, int]]:
    """(start, kind's place, kind, value's start, end) of the fixed patterns, in bytes; a span of assign covers the whole match."""
    out = []
    if assign:
        out += [(m.start(), 0, "assign", m.start(2), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if access:
        out += [(m.start(), 1, "access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if hexes:
        out += [(m.start(), 2, "hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out)


class Automaton:
    """A probabilistic automaton over character classes, inferred from a sample by state merging."""

    def __init__(self, sample: list[bytes]):
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, int]] = [{}]
        self.ends = [0]
        for value in sample:
            state = 0
            for c in _CLASS[np.frombuffer(value[:READ], np.uint8)].tolist():
                self.count[state][c] = self.count[state].get(c, 0) + 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                state = self.next[state][c]
            self.ends[state] += 1
        self._tabulate(self._merge())
        del self.next, self.count, self.ends

    def _total(self, s: int) -> int:
        return self.ends[s] + sum(self.count[s].values())

    def _differ(self, a: int, na: int, b: int, nb: int) -> bool:
        return abs(a / na - b / nb) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a, a state of the automaton, and b, the root of a tree, end and go on alike, and so do their successors."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            na, nb = self._total(a), self._total(b)
            if not na or not nb:
                continue
            if self._differ(self.ends[a], na, self.ends[b], nb) or any(self._differ(self.count[a].get(c, 0), na, self.count[b].get(c, 0), nb) for c in range(_N)):
                return False
            stack += [(self.next[a][c], self.next[b][c]) for c in self.next[b] if c in self.next[a]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree under b to the automaton from a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
            for c, to in self.next[b].items():
                if c in self.next[a]:
                    if self.next[a][c] != to:
                        stack.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to

    def _merge(self) -> list[int]:
        """Fold each state at the border into a compatible one or keep it; the states kept."""
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            parent, c = blue.pop(0)
            b = self.next[parent][c]
            if b in red:
                continue
            for r in red:
                if self._compatible(r, b):
                    self.next[parent][c] = r
                    self._fold(r, b)
                    blue += [(x, y) for x in red for y in sorted(self.next[x]) if self.next[x][y] not in red and (x, y) not in blue]
                    break
            else:
                red.append(b)
                blue += [(b, y) for y in sorted(self.next[b])]
        return red

    def _tabulate(self, states: list[int]) -> None:
        """``step``, ``cost`` by state and class, and ``end`` by state: next state, bits of a character and of the end, smoothed.

        Characters of a class are equally likely; a class never seen in a state leaves the state as it is.
        """
        place = {s: i for i, s in enumerate(states)}
        self.step, self.cost, self.end = np.zeros((len(states), _N), np.int32), np.zeros((len(states), _N)), np.zeros(len(states))
        for s, i in place.items():
            total = self._total(s) + 0.1 * (_N + 1)
            self.end[i] = -math.log2((self.ends[s] + 0.1) / total)
            for c in range(_N):
                self.step[i, c] = place[self.next[s][c]] if c in self.next[s] else i
                self.cost[i, c] = -math.log2((self.count[s].get(c, 0) + 0.1) / total / len(_GROUPS[c]))

    def bits(self, value: bytes) -> float:
        """Cost of a whole value and its end."""
        state, cost = 0, 0.0
        for c in _CLASS[np.frombuffer(value, np.uint8)].tolist():
            cost += self.cost[state, c]
            state = self.step[state, c]
        return float(cost + self.end[state])


def _runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of at least ``least`` true values; a run ends where its row ends."""
    border = np.zeros(len(mask) + 1, bool)
    border[offsets] = True
    start = np.flatnonzero(mask & (border[:-1] | ~np.concatenate([[False], mask])[:-1]))
    end = np.flatnonzero(mask & (border[1:] | ~np.concatenate([mask, [False]])[1:])) + 1
    long = end - start >= least
    return start[long], end[long]


class Scan:
    """Base spans and other tokens of a chunk of texts, with places in the chunk's bytes.

    Only rows with a keyword, a long run of hexadecimal digits or the access prefix can hold base spans; these are
    found for all rows at once, runs within their rows. ``tokens`` are the maximal runs of token bytes that
    no base span touches.
    """

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = buffers(texts)
        data, offsets = self.data, self.offsets
        self.raw = data.tobytes()
        row = lambda at: np.searchsorted(offsets, at, side="right") - 1
        rows = set(row(_runs(_HEX_BYTE[data], offsets, LEAST["hex"])[0]).tolist())
        low = self.raw.lower()
        for w in (*WORDS, b"akia"):
            at = low.find(w)
            while at >= 0:
                rows.add(int(row(at)))
                at = low.find(w, at + 1)
        self.base: list[tuple[int, int, int, str, int, int]] = []  # row, start, kind's place, kind, value's start, end
        for r in sorted(rows):
            a = int(offsets[r])
            self.base += [(r, a + s, place, kind, a + v, a + e) for s, place, kind, v, e in base_spans(self.raw[a : int(offsets[r + 1])])]
        self.start, self.end = _runs(_TOKEN_BYTE[data], offsets, 1)
        if self.base:
            cover = np.zeros(len(data) + 1, np.int32)
            for _, s, _, _, _, e in self.base:
                cover[s] += 1
                cover[e] -= 1
            touched = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
            free = touched[self.end] == touched[self.start]
            self.start, self.end = self.start[free], self.end[free]

    def points(self, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Places in bytes as code points of their rows."""
        upto = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        return upto[at] - upto[self.offsets[rows]]


class _Least:
    """The distinct values with the smallest hashes of a stream."""

    def __init__(self, most: int):
        self.most, self.of, self.limit = most, {}, 1 << 64

    def add(self, h: int, value: bytes) -> None:
        if h < self.limit:
            self.of[h] = value
            if len(self.of) > 2 * self.most:
                self.of = dict(sorted(self.of.items())[: self.most])
                self.limit = max(self.of)


def labelled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(label, h, value): values of the base spans and tokens outside them in every whole text; of each label a task's ``sample`` smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = {k: _Least(sample) for k in (*KINDS, "text")}
        for batch in batches:
            for part in chunks(batch):
                scan = Scan(part.column("text"))
                for _, _, _, kind, a, b in scan.base:
                    least[kind].add(xxhash.xxh64_intdigest(scan.raw[a:b]), scan.raw[a:b][:READ])
                h, own = hashes(scan.data, scan.start, scan.end), least["text"]
                h, first = np.unique(h, return_index=True)
                for x, i in zip(h.tolist(), first[: 2 * sample].tolist(), strict=False):
                    if x >= own.limit:
                        break
                    own.add(x, scan.raw[scan.start[i] : scan.end[i]][:READ])
        found = [(label, h, v) for label, own in least.items() for h, v in sorted(own.of.items())[:sample]]
        label, h, value = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.string()), pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(value, pa.binary())], names=["label", "h", "value"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "label string, h long, value binary")


class Grammar:
    """Automata of the credential kinds and of ordinary tokens."""

    def __init__(self, values: dict[str, list[bytes]]):
        self.kinds = [Automaton(values[k]) for k in KINDS if values.get(k)]
        own = [Automaton(values.get("text", [])), *self.kinds]
        first = np.cumsum([0, *(len(a.end) for a in own)])
        self.first = first[:-1].astype(np.int32) * _N
        self.step = np.concatenate([(a.step + f).ravel() * _N for a, f in zip(own, first, strict=False)]).astype(np.int32)
        self.cost = np.concatenate([a.cost.ravel() for a in own]).astype(np.float32)
        self.end = np.concatenate([a.end for a in own]).astype(np.float32)
        if self.kinds:
            # what a character of each class, and the end, can add to the margin at most
            cheapest = np.min([a.cost.min(0) for a in self.kinds], axis=0)
            self.most = np.maximum(0, own[0].cost.max(0) - cheapest)[_CLASS]
            self.most_end = max(0.0, own[0].end.max() - min(a.end.min() for a in self.kinds))

    def gains(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """By how many bits the best credential automaton explains each token better than the text automaton."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        begin, size = start[order], size[order]
        steps = min(STEPS, int(size[0])) if len(size) else 0
        alive = len(size) - np.searchsorted(size[::-1], np.arange(steps), side="right")
        state = np.repeat(self.first[:, None], len(size), axis=1)
        bits = np.zeros(state.shape, np.float32)
        for i in range(steps):
            k = alive[i]
            at = state[:, :k] + _CLASS[data[begin[:k] + i]]
            bits[:, :k] += self.cost[at]
            state[:, :k] = self.step[at]
        for j in range(int((size > STEPS).sum())):
            codes = _CLASS[data[begin[j] + STEPS : begin[j] + size[j]]].tolist()
            for a in range(len(state)):
                now, cost = int(state[a, j]), 0.0
                for c in codes:
                    cost += self.cost[now + c]
                    now = int(self.step[now + c])
                state[a, j], bits[a, j] = now, bits[a, j] + cost
        bits += self.end[state // _N]
        out = np.empty(len(size))
        out[order] = bits[0] - bits[1:].min(0)
        return out

    def secrets(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which tokens are secrets."""
        out = np.zeros(len(start), bool)
        if self.kinds and len(start):
            bound = np.concatenate([[0.0], np.cumsum(self.most[data])])
            open_ = np.flatnonzero(bound[end] - bound[start] + self.most_end >= MARGIN - 1e-3)
            out[open_] = self.gains(data, start[open_], end[open_]) >= MARGIN
        return out

    def is_secret(self, value: bytes) -> bool:
        return bool(self.secrets(np.frombuffer(value, np.uint8), np.array([0]), np.array([len(value)]))[0])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Learn from at most ``sample`` distinct values of each label, those with the smallest hashes (ties: the least value).

    The values are counted by their hashes' first bits; what lies below each label's cut reaches the driver: the sample and one
    bucket's values at most.
    """
    rows = labelled(docs, sample).groupBy("label", "h").agg(F.min("value").alias("value"))
    rows = Scratch(docs.sparkSession, "labelled").keep("values", rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - _BITS)))
    sizes: dict[str, list[tuple[int, int]]] = {}
    for label, bucket, n in sorted(rows.groupBy("label", "bucket").count().collect()):  # 2 ** _BITS buckets a label at most
        sizes.setdefault(label, []).append((bucket, n))
    near, values = F.lit(False), {}
    for label, own in sizes.items():
        sums = np.cumsum([n for _, n in own])
        near = near | ((F.col("label") == label) & (F.col("bucket") <= own[min(int(np.searchsorted(sums, sample)), len(own) - 1)][0]))
    for label, h, value, _ in rows.where(near).collect():
        values.setdefault(label, []).append((h % (1 << 64), bytes(value)))
    return Grammar({k: sorted(x for _, x in sorted(v)[:sample]) for k, v in values.items()})


def spans_of(docs: DataFrame, grammar: Grammar, *keep: str) -> DataFrame:
    """``keep`` columns of every row with base and all: arrays of (start, kind, end) by start, then kind.

    Offsets are code points, ends exclusive. Kind ``format`` marks spans that the automata add; they never overlap base
    spans. Null or empty texts have no spans; a text that repeats is judged alike each time. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            for part in chunks(with_text(batch, "_text"), "_text"):
                scan = Scan(part.column("_text"))
                base, every = [[] for _ in range(part.num_rows)], [[] for _ in range(part.num_rows)]
                hit = g.secrets(scan.data, scan.start, scan.end)
                start, end = scan.start[hit], scan.end[hit]
                more = zip((np.searchsorted(scan.offsets, start, side="right") - 1).tolist(), start.tolist(), end.tolist(), strict=True)
                found = sorted([(r, s, place, kind, e) for r, s, place, kind, _, e in scan.base] + [(r, s, len(KINDS), "format", e) for r, s, e in more])
                if found:
                    rows = np.array([f[0] for f in found])
                    at, to = scan.points(np.array([f[1] for f in found]), rows), scan.points(np.array([f[4] for f in found]), rows)
                    for (r, _, place, kind, _), s, e in zip(found, at.tolist(), to.tolist(), strict=True):
                        every[r].append((s, kind, e))
                        if place < len(KINDS):
                            base[r].append((s, kind, e))
                dicts = lambda rows: pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in own] for own in rows], span)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), dicts(base), dicts(every)], names=[*keep, "base", "every"])

    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("base", spans), T.StructField("every", spans)])
    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def redacted(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents with every secret span replaced by ``mask``, one for overlapping spans; n_chars, if there, follows the text."""
    found = spans_of(row_and_text(docs), fit(docs), "_row")
    old = F.col("_row.text")
    piece = lambda a, b: F.substring(old, (a + 1).cast("int"), (b - a).cast("int"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["out"], piece(acc["at"], s["start"]), F.lit(mask)).alias("out"), s["end"].alias("at"))).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
    cut = F.aggregate("every", start, step, lambda acc: F.concat(acc["out"], piece(acc["at"], F.length(old))))
    out = found.withColumn("text", F.when(F.size("every") == 0, old).otherwise(cut))
    length = lambda c: F.when(F.size("every") == 0, F.col("_row.n_chars")).otherwise(F.length("text")).cast(docs.schema[c].dataType)
    return out.select(*(F.col("text") if c == "text" else length(c).alias(c) if c == "n_chars" else F.col(f"_row.`{c}`") for c in docs.columns))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ``spans_of`` for every document; nulls and empty tables as there."""
    docs = table(spark, sf_dir, "documents")
    found = spans_of(docs, fit(docs), "doc_id")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"))
