"""Language-model scores by subword lattices (operator 5).

The pieces of an existing subword vocabulary weigh all segmentations of a text: a forward
recursion in log space over each word's lattice gives its marginal probability, and a document's
is the product over its words and one end. The vocabulary has merge ranks instead of probabilities, so the pieces'
weights are learned here, from all training documents: first each word's usual segmentation counts as
often as the word occurs, then ``ROUNDS`` of expectation maximisation replace the counts by those expected
over all segmentations, by forward and backward recursion over each distinct word's lattice.

Words are counted per block of documents first, so that neither a frequent word nor the whole
vocabulary meets in one task: totals are sums of blocks' counts, each distinct word's lattice is
computed once, and every block gets just its own words' scores back beside its documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, table
from .split import held_out
from .wordhash import chunks

BLOCK_BYTES = 16 << 20  # of text that one task scores at a time
PARTS = 2  # of the distinct words, for each block
SMOOTHING = 0.1  # added to each piece's count
ROUNDS = 1  # of expectation maximisation
SHORT = 64  # characters up to which probabilities do not underflow; longer words are computed with logarithms throughout
_WORDS = 1 << 20  # distinct (block, word) counts that a task holds
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = "▁"


def _split(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_UPPER).split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word, n): occurrences in training documents; 0 for words of held-out ones alone."""
    held: dict[int, Counter[bytes]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for block, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block, np.int64)), pa.array([w.decode("utf-8", "replace") for w in own], pa.string()), pa.array(list(own.values()), pa.int64())], names=["block", "word", "n"])

    for batch in batches:
        for part in chunks(batch):
            for block, text, skip in zip(*(part.column(c).to_pylist() for c in ("block", "text", "held_out")), strict=True):
                own = held.setdefault(block, Counter())
                if skip:
                    own.update(dict.fromkeys(set(_split(text)), 0))
                else:
                    own.update(_split(text))
            if sum(map(len, held.values())) > _WORDS:
                yield from out()
                held = {}
    yield from out()


class Pieces:
    """A subword vocabulary with weights, as a tree of characters whose leaves hold (probability, logarithm, number)."""

    def __init__(self, pieces: list[str], logp: list[float], byte_logp: list[float], numbers: list[int] | None = None, byte_numbers: list[int] | None = None):
        self.root: dict = {}
        for piece, p, i in zip(pieces, logp, numbers or range(len(pieces)), strict=True):
            node = self.root
            for ch in piece:
                node = node.setdefault(ch, {})
            node[""] = (math.exp(p), p, i)
        self.byte_logp = byte_logp
        self.byte_numbers = byte_numbers or [len(pieces) + b for b in range(256)]

    def _edges(self, text: str) -> Iterator[list[tuple[int, tuple[float, float, int | tuple[int, ...]]]]]:
        """For each character, (end, weights) of the pieces that begin there; one that is no piece of its own stands for its bytes."""
        n = len(text)
        for i in range(n):
            out, j, node, single = [], i + 1, self.root.get(text[i]), False
            while node is not None:
                if "" in node:
                    out.append((j, node[""]))
                    single = single or j == i + 1
                if j == n:
                    break
                node = node.get(text[j])
                j += 1
            if not single:
                own = text[i].encode("utf-8", "surrogatepass")
                p = sum(self.byte_logp[b] for b in own)
                out.append((i + 1, (math.exp(p), p, tuple(self.byte_numbers[b] for b in own))))
            yield out

    def log_marginal(self, word: str) -> float:
        """Natural logarithm of the summed probability of all segmentations of a word with its leading mark."""
        text = _SPACE + word
        if len(text) <= SHORT:
            into = [1.0] + [0.0] * len(text)
            for i, edges in enumerate(self._edges(text)):
                here = into[i]
                for j, (p, _, _) in edges:
                    into[j] += here * p
            if into[-1] > 1e-280:
                return math.log(into[-1])
        came: list[list[float]] = [[0.0]] + [[] for _ in text]
        for i, edges in enumerate(self._edges(text)):
            here = _log_sum(came[i])
            came[i] = []
            for j, (_, p, _) in edges:
                came[j].append(here + p)
        return _log_sum(came[-1])

    def expect(self, word: str, times: float, counts: np.ndarray) -> None:
        """Add how often each piece is expected in ``times`` occurrences of a word."""
        text = _SPACE + word
        n, edges = len(text), list(self._edges(text))
        ahead, back = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        if n <= SHORT:
            f, b = [1.0] + [0.0] * n, [0.0] * n + [1.0]
            for i, own in enumerate(edges):
                here = f[i]
                for j, (p, _, _) in own:
                    f[j] += here * p
            if f[n] > 1e-280:
                scale = times / f[n]
                for i in range(n - 1, -1, -1):
                    total, here = 0.0, f[i] * scale
                    for j, (p, _, number) in edges[i]:
                        x = p * b[j]
                        total += x
                        _add(counts, number, here * x)
                    b[i] = total
                return
        came: list[list[float]] = [[] for _ in range(n + 1)]
        came[0].append(0.0)
        for i, own in enumerate(edges):
            ahead[i] = _log_sum(came[i])
            for j, (_, p, _) in own:
                came[j].append(ahead[i] + p)
        whole = _log_sum(came[n])
        for i in range(n - 1, -1, -1):
            back[i] = _log_sum([p + back[j] for j, (_, p, _) in edges[i]])
            for j, (_, p, number) in edges[i]:
                _add(counts, number, times * math.exp(ahead[i] + p + back[j] - whole))


def _add(counts: np.ndarray, number: int | tuple[int, ...], n: float) -> None:
    for i in (number,) if type(number) is int else number:
        counts[i] += n


def _log_sum(x: list[float]) -> float:
    most = max(x)
    return most + math.log(sum([math.exp(v - most) for v in x]))


def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def fit(vocab: DataFrame, n_documents: int, path: str, smoothing: float = SMOOTHING, rounds: int = ROUNDS) -> tuple[Pieces, float]:
    """The weighted vocabulary and the end's natural log probability, from (word, c) of all training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(path)
        total = np.zeros(sp.vocab_size(), np.int64)
        for batch in batches:
            ids = sp.encode(batch.column("word").to_pylist(), num_threads=1)
            flat = np.array([i for own in ids for i in own], np.int64)
            times = np.repeat(batch.column("c").to_numpy(), [len(own) for own in ids])
            total += np.bincount(flat, times, minlength=len(total)).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "n"])

    counted = {r[0]: r[1] for r in vocab.where("c > 0").select("word", "c").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n")).collect()}  # the vocabulary at most
    sp = _processor(path)
    ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i))]
    whole = [i for i in ids if not sp.is_byte(i)]
    bytes_ = {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)}

    def weighted(found: dict[int, float]) -> tuple[Pieces, float]:
        weight = {i: found.get(i, 0) + smoothing for i in ids}
        total = math.log(sum(weight.values()) + n_documents + smoothing)
        logp = {i: math.log(w) - total for i, w in weight.items()}
        pieces = Pieces([sp.id_to_piece(i) for i in whole], [logp[i] for i in whole], [logp[bytes_[b]] for b in range(256)], whole, [bytes_[b] for b in range(256)])
        return pieces, math.log(n_documents + smoothing) - total

    def expected(model):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, add = np.zeros(n_pieces), model.value.expect
            for batch in batches:
                for word, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist(), strict=True):
                    add(word, c, counts)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["piece", "n"])

        return run

    n_pieces, made = sp.vocab_size(), weighted(counted)
    for _ in range(rounds if counted else 0):
        shared = vocab.sparkSession.sparkContext.broadcast(made[0])
        found = vocab.where("c > 0").select("word", "c").mapInArrow(expected(shared), "piece long, n double").groupBy("piece").agg(F.sum("n")).collect()
        made = weighted({r[0]: r[1] for r in found})
        shared.destroy()
    return made


def score(docs: DataFrame, path: str, fold: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text).

    Learns from the rows outside the fold. ``base_score`` is the smoothed word unigram's log10 probability, ``score``
    the lattice model's. Null and empty texts are the end alone. Repeated rows count and are scored each time.
    If nothing can be learned, all weights are equal. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lattice")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out(fold).alias("held_out"))
    n_train, size = rows.agg(F.count(F.when(~F.col("held_out"), 1)), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-(size or 0) // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    words = scratch.keep("words", rows.repartition(blocks, "block").mapInArrow(_counts, "block long, word string, n long"))
    # as many parts as there are CPU seconds in their lattices, not as bytes would make them
    vocab = scratch.keep("vocab", words.repartition(PARTS * blocks, "word").groupBy("word").agg(F.sum("n").alias("c")))
    n_words, distinct = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    tokens, kinds = n_words + n_train, distinct + (1 if n_train else 0)
    pieces, end = fit(vocab, n_train, path)
    model = spark.sparkContext.broadcast(pieces)
    scale = math.log10(tokens + 0.5 * (kinds + 1))

    def marginal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.value.log_marginal
        for batch in batches:
            p = [of(w) / math.log(10) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(p, pa.float64())], names=["word", "c", "p"])

    scored = vocab.mapInArrow(marginal, "word string, c long, p double")
    local = scratch.keep("local", words.select("block", "word").join(scored, "word").select("block", "word", "c", "p"))  # a block may name a word twice
    end_base = math.log10(n_train + 0.5) - scale

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        place = {w.encode(): i for i, w in enumerate(right.column("word").to_pylist())}.__getitem__
        c, p = right.column("c").to_numpy(), right.column("p").to_numpy()
        base = np.log10(c + 0.5) - scale
        n, known, plain, lattice = [], [], [], []
        for text in left.column("text").to_pylist():
            own = _split(text)
            at = np.fromiter(map(place, own), np.int64, len(own))
            n.append(len(own) + 1)
            known.append(int((c[at] > 0).sum()) + (n_train > 0))
            plain.append(float(base[at].sum()) + end_base)
            lattice.append(float(p[at].sum()) + end / math.log(10))
        return pa.table(
            [left.column("doc_id").cast(pa.int64()), left.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([tokens] * len(n), pa.int64()), pa.array(plain, pa.float64()), pa.array(lattice, pa.float64())],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(local.groupBy("block")).applyInArrow(block, schema)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score`` of the whole table; nulls and empty tables as there."""
    return score(table(spark, sf_dir, "documents"), vocabulary())
