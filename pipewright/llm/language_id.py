"""Language identification by cross-parsing entropy (operator 1).

For each language a suffix automaton of labelled text is built on the driver. A text
is parsed against it greedily: each phrase is the longest match with any substring of the
labelled text. Fewer phrases mean a closer language; counts are normalised by the
logarithm of the labelled length and by the text's length.

The automata become dense transition tables, in which a failed match is a step to the
state after a fresh start, with a mark in the lowest bit. A batch of whole texts is cut into
blocks of ``BLOCK`` symbols, and all blocks take their next step at once, each from a fresh start. A block whose
predecessor ended inside a phrase is then parsed from there as well, until both parses
begin a phrase at one place and agree from there on: the phrases are those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .split import held_out
from .scratch import table
from .wordhash import chunks, row_and_text, with_text

SYMBOLS = 20_000  # labelled symbols per language: the bound on what the automata learn from
TOTAL = 64 * SYMBOLS  # labelled symbols of all languages: bounds the tables that are broadcast, however many labels there are
DOCUMENTS = 64  # labelled documents per language that reach the driver, smallest hashes first
LETTERS = 60  # most frequent letters with a symbol of their own
BLOCK = 512
FEW = 96  # blocks that are cheaper to parse again one by one than side by side
REJECT, SHORT = 0.9, 2.0  # rejected from REJECT + SHORT / sqrt(symbols) times the phrases of random letters


def _symbols(text: str, code: np.ndarray) -> np.ndarray:
    """Symbols of a text: letters in lower case, one space for every run of others."""
    out = code[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    again = np.zeros(len(out), bool)
    again[1:] = (out[1:] == 0) & (out[:-1] == 0)
    return out[~again]


def _alphabet(texts: list[str]) -> np.ndarray:
    """Code point -> symbol: 0 for non-letters, 1 for rare letters, from 2 the frequent ones."""
    point, count = np.unique(np.frombuffer("".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
    code = np.zeros(0x110000, np.uint8)
    code[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
    letters = sorted((-n, p) for p, n in zip(point.tolist(), count.tolist(), strict=True) if code[p])
    for i, (_, p) in enumerate(letters[:LETTERS]):
        code[p] = 2 + i
    return code


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a symbol sequence; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = clone
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
        last = new
    return edges


def parsing_table(text: np.ndarray, width: int) -> np.ndarray:
    """Flat table: entry [state * width + symbol] is (next state * width) * 2 + (1 if a phrase begins there)."""
    edges = suffix_automaton(text)
    start = np.zeros(width, np.int32)
    for c, to in edges[0].items():
        start[c] = to
    steps = np.tile(start * (2 * width) + 1, (len(edges), 1)).astype(np.int32)
    for state, own in enumerate(edges[1:], 1):
        for c, to in own.items():
            steps[state, c] = to * (2 * width)
    return steps.ravel()


class Model:
    """What ``fit`` learns: an alphabet, the languages and their tables."""

    def __init__(self, samples: dict[str, list[str]], symbols: int = SYMBOLS):
        self.langs = sorted(samples)
        self.code = _alphabet([t for lang in self.langs for t in samples[lang]])
        self.width = int(self.code.max()) + 1
        symbols = max(1, min(symbols, TOTAL // max(1, len(self.langs))))
        texts = [np.concatenate([np.zeros(1, np.uint8), *(_symbols(t, self.code) for t in samples[lang])])[:symbols] for lang in self.langs]
        self.tables = [parsing_table(t, self.width) for t in texts]
        self.scale = [np.log2(len(t) + 1) for t in texts]
        shuffled = [np.random.default_rng(5).permutation(t) for t in texts]
        # phrases per symbol, in bits, of letters in random order: what a text of no learned language is like
        self.alien = min((self.bits(t)[:, 0].min() for t in shuffled if len(t) > 1), default=1.0)

    def bits(self, symbols: np.ndarray, bounds: np.ndarray | None = None) -> np.ndarray:
        """Normalised phrases per symbol, [language, text], of concatenated texts with the given bounds."""
        bounds = np.array([0, len(symbols)]) if bounds is None else bounds
        n = np.diff(bounds)
        blocks = -(-n // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)])
        text = np.repeat(np.arange(len(n)), blocks)
        begin = bounds[text] + (np.arange(first[-1]) - first[text]) * BLOCK
        size = np.minimum(BLOCK, bounds[text + 1] - begin)
        order = np.argsort(-size, kind="stable")
        longest = size[order]
        padded = np.concatenate([symbols, np.zeros(1, np.uint8)])
        alive = len(size) - np.searchsorted(longest[::-1], np.arange(BLOCK), side="right")
        counts = np.zeros((len(self.langs), len(size)), np.int32)
        state = np.zeros((len(self.langs), len(size)), np.int32)
        for step in range(int(longest[0]) if len(size) else 0):
            k = alive[step]
            c = padded[begin[order[:k]] + step].astype(np.int32)
            for i, steps in enumerate(self.tables):
                to = steps[(state[i, :k] >> 1) + c]
                counts[i, :k] += to & 1
                state[i, :k] = to
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        counts, state = counts[:, place], state[:, place]
        later = np.flatnonzero(np.diff(text) == 0) + 1  # blocks that continue the text of the one before
        for i, steps in enumerate(self.tables):
            assumed = np.zeros(len(size), np.int32)  # the state that each block's parse began in
            redo = later[state[i, later - 1] >> 1 != 0]
            while len(redo):
                now, old, at = state[i, redo - 1] >> 1, assumed[redo], redo
                assumed[redo] = now
                step = 0
                while len(at) > FEW and step < BLOCK:
                    open_ = step < size[at]
                    state[i, at[~open_]] = now[~open_] << 1
                    at, now, old = at[open_], now[open_], old[open_]
                    c = padded[begin[at] + step].astype(np.int32)
                    a, b = steps[now + c], steps[old + c]
                    counts[i, at] += (a & 1) - (b & 1)
                    now, old = a >> 1, b >> 1
                    apart = now != old
                    at, now, old, step = at[apart], now[apart], old[apart], step + 1
                table = memoryview(steps)
                for k, x, y in zip(at.tolist(), now.tolist(), old.tolist(), strict=True):  # the last few, such as texts of one word repeated
                    more = 0
                    for c in padded[begin[k] + step : begin[k] + size[k]].tolist():
                        a, b = table[x + c], table[y + c]
                        more += (a & 1) - (b & 1)
                        x, y = a >> 1, b >> 1
                        if x == y:
                            break
                    else:
                        state[i, k] = x << 1
                    counts[i, k] += more
                redo = later[(state[i, later - 1] >> 1) != assumed[later]]
        out = np.zeros((len(self.langs), len(n)))
        for i, scale in enumerate(self.scale):
            out[i] = (np.bincount(text, counts[i], minlength=len(n)) if len(size) else 0) * scale / np.maximum(n, 1)
        return out


def fit(docs: DataFrame, train, symbols: int = SYMBOLS, documents: int = DOCUMENTS) -> Model:
    """Learn from the rows of ``docs`` (text, lang) for which ``train`` holds and both are non-null.

    Per language at most ``documents`` texts, those with the smallest hashes, reach the driver, and at most
    ``symbols`` symbols of them are learned; a text that passes the bound counts up to it.
    """
    rows = docs.where(train).where("text is not null and lang is not null").select("lang", F.substring("text", 1, symbols).alias("text"))
    rows = rows.where(F.length("text") > 0).withColumn("h", F.xxhash64("text"))
    # first per (language, salt), then per language: no task sees all of a frequent language
    salted = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h", "text")
    few = rows.select("lang", "h").distinct().withColumn("text", F.lit(0)).withColumn("i", F.row_number().over(salted)).where(F.col("i") <= documents)
    few = few.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("i") <= documents).select("lang", "h")
    bound = few.groupBy("lang").agg(F.max("h").alias("most"))
    texts: dict[str, dict[int, str]] = {}
    for lang, h, text in rows.join(F.broadcast(bound), "lang").where("h <= most").groupBy("lang", "h").agg(F.min("text").alias("text")).collect():
        texts.setdefault(lang, {})[h] = text
    samples = {}
    for lang, own in texts.items():
        samples[lang], size = [], 0
        for h in sorted(own):
            if size < symbols:
                samples[lang].append(own[h])
                size += len(own[h])
    return Model(samples, symbols)


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns of every row of ``docs`` with lang_pred, score and known.

    lang_pred is ``und`` with score 0 if the text is null or has no letter, or nothing was learned. score is 0 to 1:
    by which part of the second-best language's phrases the best needs fewer.
    known is false for ``und`` and for text that no learned language fits clearly better than random letters;
    short texts have to be worse, as their counts vary more.
    Ties go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in chunks(with_text(batch, "_text"), "_text"):
                own = [_symbols(t, m.code) for t in pc.fill_null(part.column("_text"), "").to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
                flat = np.concatenate([*own, np.zeros(0, np.uint8)])
                letters = np.concatenate([[0], np.cumsum(flat > 0)])
                some = letters[bounds[1:]] > letters[bounds[:-1]]
                if m.langs:
                    bits = m.bits(flat, bounds)
                    best, least = bits.argmin(0), bits.min(0)
                    second = np.sort(bits, axis=0)[1] if len(m.langs) > 1 else np.full(len(least), m.alien)
                    score = np.clip((second - least) / np.maximum(second, 1e-9), 0, 1)
                else:
                    some[:] = False
                    best, least, score = np.zeros(len(some), int), np.zeros(len(some)), np.zeros(len(some))
                pred = [m.langs[b] if ok else "und" for b, ok in zip(best.tolist(), some.tolist(), strict=True)]
                known = some & (least < m.alien * (REJECT + SHORT / np.sqrt(np.maximum(np.diff(bounds), 1))))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(np.where(some, score, 0.0)), pa.array(known)], names=[*keep, "lang_pred", "score", "known"])

    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def language_kept(docs: DataFrame) -> DataFrame:
    """The documents whose text some learned language fits, with all their columns.

    Rejected: null texts, texts without letters, and texts that look like random letters to every language.
    """
    model = fit(docs, F.lit(True))
    return predict(row_and_text(docs), model, "_row").where("known").select("_row.*")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``predict`` for the whole table, learned outside the held-out fold; nulls and empty tables as there."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out(0))
    out = predict(docs.withColumn("held_out", held_out(0)), model, "doc_id", "held_out")
    return out.select("doc_id", "held_out", "lang_pred", "score", "known")
