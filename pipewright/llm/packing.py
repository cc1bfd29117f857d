"""Best-fit packing by a grouping genetic algorithm (operator 8).

Documents become token pieces of at most a sequence's length, and pieces are dealt into regions of bounded size. Every region is
evolved on ``ISLANDS`` islands, each a Spark task of its own: an individual is a set of bins, first from best-fitting
pieces in random order; crossover injects well-filled whole bins of one parent into the other, removes the bins
that hold the same pieces, exchanges displaced pieces for smaller ones of bins with room, and best-fits the rest. After each
epoch the islands of a region send their elite individual to the next one in the ring. Of a region's last
elites the best is taken: its well-filled bins are final, pieces of its other bins are dealt into fewer regions, and so
on, until one region is left or bins no longer become fewer.
"""

from __future__ import annotations

import bisect
import random
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, table
from .wordhash import chunks

LENGTH = 2048
REGION = 4096  # pieces per region, about
ISLANDS, EPOCHS = 2, 2  # of each region
SIZE, GENERATIONS = 6, 16  # individuals of an island, crossovers of an epoch
DISSOLVED = 2  # emptiest bins, and as many chance ones, that each child gives up
FULL = 0.99  # filling from which a bin is final
_PUNCTUATION = string.punctuation
END = b"\0\0\0\0"  # id 0 after each document
_CACHE = 600_000  # words whose ids a worker keeps


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in a byte-level vocabulary: printable bytes themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """A dict that makes a missing value from its key."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Ids of texts, through bounded tables of words' and parts' ids.

    White space ends tokens in a vocabulary that drops it, so a text's ids are those of its words in turn. A new word
    that is Latin-1 letters, with ASCII punctuation behind, is one or two parts for the merges; any other goes
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.merges = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.words, self.parts = _Known(self._word), _Known(self._part)

    def _part(self, part: str) -> bytes:
        text = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.merges(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "surrogatepass")
        core = text.rstrip(_PUNCTUATION)
        if core.isalpha() and (core.isascii() or max(core) <= "\xff"):
            ids = self.parts[core.lower()]
            return ids + self.parts[text[len(core) :]] if len(core) < len(text) else ids
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, ended by id 0."""
        if len(self.words) > _CACHE:
            self.words = _Known(self._word)
        if len(self.parts) > _CACHE:
            self.parts = _Known(self._part)
        get = self.words.__getitem__
        return [b"".join(map(get, t.encode("utf-8", "surrogatepass").split())) + END for t in texts]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row: ids cut into pieces of ``length``, the last maybe shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for batch in batches:
            for part in chunks(batch):
                rows, piece, size, crc = [], [], [], []
                for r, ids in enumerate(encode(pc.fill_null(part.column("text"), "").to_pylist())):
                    for i, at in enumerate(range(0, len(ids), 4 * length)):
                        own = ids[at : at + 4 * length]
                        rows.append(r)
                        piece.append(i)
                        size.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                n = np.array(piece, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows, pa.int64())).cast(pa.int64()), pa.array(n.astype(np.int32)), pa.array(n * length), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: list[list[int]], room: list[int]) -> None:
    """Put the items, largest first, each into the fullest bin with room, opening bins where none has."""
    by: dict[int, list[int]] = {}
    open_ = 0
    for b, left in enumerate(room):
        if left:
            by.setdefault(left, []).append(b)
            open_ |= 1 << left
    for i in sorted(items, key=lambda i: -sizes[i]):
        n = sizes[i]
        fits = open_ >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = by[left].pop()
            if not by[left]:
                open_ ^= 1 << left
        else:
            b, left = len(bins), capacity
            bins.append([])
            room.append(capacity)
        bins[b].append(i)
        left -= n
        room[b] = left
        if left:
            by.setdefault(left, []).append(b)
            open_ |= 1 << left


Individual = tuple[list[list[int]], list[int]]  # bins of item numbers, and each bin's room


def exchange(displaced: list[int], sizes: list[int], bins: list[list[int]], room: list[int]) -> list[int]:
    """Swap displaced pieces for one or two smaller pieces of a bin where that fills it better; the pieces then left over."""
    displaced = sorted(displaced, key=sizes.__getitem__)
    keys = [sizes[i] for i in displaced]
    for k, own in enumerate(bins):
        left = room[k]
        if not left or not displaced:
            continue
        sets = [(i,) for i in own] + ([(i, j) for n, i in enumerate(own) for j in own[:n]] if len(own) <= 6 else [])
        gain, at, out = 0, 0, ()
        for some in sets:
            size = sum(sizes[i] for i in some)
            x = bisect.bisect_right(keys, size + left) - 1
            if x >= 0 and keys[x] - size > gain:
                gain, at, out = keys[x] - size, x, some
        if gain:
            bins[k] = [i for i in own if i not in out] + [displaced[at]]
            room[k] -= gain
            del displaced[at], keys[at]
            for i in out:
                x = bisect.bisect_left(keys, sizes[i])
                keys.insert(x, sizes[i])
                displaced.insert(x, i)
    return displaced


def fitness(x: Individual, capacity: int) -> float:
    """Fewer bins first, then fuller ones."""
    return sum(((capacity - r) / capacity) ** 2 for r in x[1]) / max(1, len(x[1])) - len(x[1])


def random_individual(sizes: list[int], capacity: int, chance: random.Random) -> Individual:
    """Pieces in random order, some at a time, best-fitted."""
    bins: list[list[int]] = []
    room: list[int] = []
    order = chance.sample(range(len(sizes)), len(sizes))
    step = max(1, len(order) // 64)
    for at in range(0, len(order), step):
        best_fit(order[at : at + step], sizes, capacity, bins, room)
    return bins, room


def crossover(a: Individual, b: Individual, sizes: list[int], capacity: int, chance: random.Random) -> Individual:
    """Inject well-filled bins of b into a, drop a's bins with the same pieces and some others, exchange and best-fit what they alone held."""
    full = [k for k, r in enumerate(b[1]) if r <= (1 - FULL) * capacity] or sorted(range(len(b[1])), key=b[1].__getitem__)[: len(b[1]) // 4 + 1]
    full = chance.sample(full, max(1, len(full) // 2))
    gained = {i for k in full for i in b[0][k]}
    bins, room, displaced = [b[0][k][:] for k in full], [b[1][k] for k in full], []
    for own, left in zip(*a, strict=True):
        if gained.isdisjoint(own):
            bins.append(own[:])
            room.append(left)
        else:
            displaced += [i for i in own if i not in gained]
    drop = set(sorted(range(len(room)), key=room.__getitem__)[-DISSOLVED:]) | {chance.randrange(len(bins)) for _ in range(DISSOLVED)}
    displaced += [i for k in drop for i in bins[k]]
    bins, room = [x for k, x in enumerate(bins) if k not in drop], [r for k, r in enumerate(room) if k not in drop]
    best_fit(exchange(displaced, sizes, bins, room), sizes, capacity, bins, room)
    return bins, room


def evolve(population: list[Individual], sizes: list[int], capacity: int, chance: random.Random, generations: int = GENERATIONS, size: int = SIZE) -> Individual:
    """The elite after ``generations`` crossovers; the population is filled up at random. Stops early at the lower bound."""
    least = -(-sum(sizes) // capacity)
    rank = lambda x: -fitness(x, capacity)
    if population and len(min(population, key=rank)[0]) <= least:
        return min(population, key=rank)
    own = population + [random_individual(sizes, capacity, chance) for _ in range(size - len(population))]
    own.sort(key=rank)
    for _ in range(generations):
        if len(own[0][0]) <= least:
            break
        own.append(crossover(*chance.sample(own, 2), sizes, capacity, chance))
        own.sort(key=rank)
        del own[size:]
    return own[0]


_PIECE = ("doc_id long", "piece int", "start long", "length long", "ids_crc32 long")
_STATE = ", ".join((*_PIECE, "pid long", "region long", "island int", "bin int", "offset long", "room long", "fit double", "solved boolean"))


_NONE = pa.table([pa.array([], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]]) for c in _STATE.split(", ")], names=[c.split()[0] for c in _STATE.split(", ")])


def _island(capacity: int, level: int, epoch: int, generations: int, size: int):
    """One epoch of one island: its own pieces and elite, and the elite that came from its neighbour."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        region, island = (k.as_py() for k in key)
        guest = group.column("guest")
        own = group.filter(pc.invert(guest)).sort_by("pid")
        if not own.num_rows:  # this island was done before
            return _NONE
        sizes, population = own.column("length").to_pylist(), []
        for some in (own, group.filter(guest).sort_by("pid")):
            if some.num_rows and not some.column("bin").null_count:
                bins: dict[int, list[int]] = {}
                for i, b in enumerate(some.column("bin").to_pylist()):
                    bins.setdefault(b, []).append(i)
                found = list(bins.values())
                population.append((found, [capacity - sum(sizes[i] for i in x) for x in found]))
        best = evolve(population, sizes, capacity, random.Random(f"{level}.{epoch}.{region}.{island}"), generations, size)
        place, offset, room = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k, (items, left) in enumerate(zip(*best, strict=True)):
            at = 0
            for i in items:
                place[i], offset[i], room[i] = k, at, left
                at += sizes[i]
        fit, solved = np.full(len(sizes), fitness(best, capacity)), np.full(len(sizes), len(best[0]) <= -(-sum(sizes) // capacity))
        columns = [own.column(c.split()[0]) for c in (*_PIECE, "pid", "region", "island")]
        return pa.table([*columns, pa.array(place), pa.array(offset), pa.array(room), pa.array(fit), pa.array(solved)], names=[c.split()[0] for c in _STATE.split(", ")])

    return run


def pack(found: DataFrame, scratch: Scratch, length: int = LENGTH, region: int = REGION, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, size: int = SIZE) -> DataFrame:
    """``found`` (as from ``pieces``) with sequence_id and offset: where each piece lies, gapless from 0.

    Which of equal pieces lies where is left to chance with fixed seeds.
    """
    rest, n, level, opened, done = found, found.count(), 0, None, []
    while True:
        regions = max(1, -(-n // region))
        own = F.monotonically_increasing_id()
        state = rest.withColumn("pid", own).withColumn("region", F.pmod(F.xxhash64("pid"), F.lit(regions)).cast("long"))
        state = state.withColumn("island", F.explode(F.array(*map(F.lit, range(islands))))).withColumn("bin", F.lit(None).cast("int"))
        for epoch in range(epochs):
            own = state.where("not solved") if epoch else state  # at the lower bound there is nothing to gain
            own = own.withColumn("guest", F.lit(False))
            if epoch:  # migration: each island's elite to the next
                own = own.union(state.withColumn("island", (F.col("island") + 1) % islands).withColumn("guest", F.lit(True)))
            bred = own.groupBy("region", "island").applyInArrow(_island(length, level, epoch, generations, size), _STATE)
            state = scratch.keep(f"level-{level}-{epoch}", state.where("solved").union(bred) if epoch else bred)
        best = state.groupBy("region").agg(F.max(F.struct("fit", "island")).alias("best")).select("region", F.col("best.island").alias("island"))
        packed = state.join(best, ["region", "island"])
        packed = packed.select(*(c.split()[0] for c in _PIECE), (F.lit(level << 56) + F.shiftleft("region", 16) + F.col("bin")).alias("sequence_id"), "offset", (F.col("room") <= (1 - FULL) * length).alias("final"))
        packed = scratch.keep(f"level-{level}", packed)
        for epoch in range(epochs):
            scratch.drop(f"level-{level}-{epoch}")
        left, bins = packed.where("not final").agg(F.count("*"), F.count(F.when(F.col("offset") == 0, 1))).first()
        if regions == 1 or not left or (opened is not None and bins > 0.99 * opened):
            return _union(done + [packed]).drop("final")
        done.append(packed.where("final"))
        rest, n, level, opened = packed.where("not final").drop("sequence_id", "offset", "final"), left, level + 1, bins


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def packed_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """Every row's pieces with their places in sequences of at most ``length`` tokens.

    Null and empty texts are the one id 0. Repeated rows and ids are packed one by one; other columns are not read.
    Texts are encoded whole, whatever their length. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.keep("pieces", pieces(docs, tokenizer, length)), scratch, length)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``packed_documents`` of the whole table; nulls and empty tables as there."""
    return packed_documents(table(spark, sf_dir, "documents"), vocabulary())
