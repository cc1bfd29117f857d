"""N-gram Jaccard self-join by a token-group matrix (operator 10).

Documents become sets of 64-bit hashes of their distinct word shingles; documents
with one set are one class, kept once. The join over classes has four steps.

1. Order. Shingles that recur within many chunks of the corpus are counted over all
   documents; at most ``HEAVY`` of the most frequent go last in the one global order
   (by magnitude of their count, then hash). The order decides speed only.
2. Matrix. Two sets with Jaccard >= t share a shingle among the first
   n - ceil(t * n) + 1 of each, in any one global order, so the token -> class matrix holds only
   these; tokens of a single class are dropped by a pre-aggregated min/max, and of tokens
   with one and the same list of classes the first in the order is kept.
3. Groups. Every token has ``LEADERS`` classes: the one with the smallest part of unshared tokens,
   and the smallest by several hashes; a class is compared with the leaders that it shares most
   tokens with. The links found make stars, whose
   components, cut into parts of about ``GROUP`` members by hash, are the groups. Each group
   stores its token union.
4. Search. A class and a group of another component that share a matrix token meet
   once, unless the token's places already exclude a link; the group is opened only if the class's overlap with the union reaches
   ceil(t * n). One link per opened group suffices, as its members are connected already.

Both searches first bound the overlap by bitmaps of two to four bits a shingle; only classes of
pairs that pass have their whole sets read from the documents again and compared.

Links are exact for the given threshold. Components of all links follow from
alternating star contraction over written edge tables. No step collects links, and
every grouping is a pre-aggregated min, max, count or a join that Spark may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, table
from .wordhash import Words, chunks, mix, row_sets, windows

WIDTH = 5
PERCENT = 80
HEAVY = 1 << 17  # frequent shingles that go last: 1 MiB, whatever the input's size
GROUP = 256
LEADERS = 4
_COUNTED = 4 << 20  # shingles within which recurrence is noticed


def _sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    words = Words(batch.column("text"), lower=True)
    return row_sets(*windows(words, width, short=True), batch.num_rows)


def _classes(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each row's set; 0 for an empty one."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        sums = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), first[:-1][full])
        out[full] = mix(sums + n[full].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return out


def _need(n, percent: int):
    """ceil(percent * n / 100)"""
    return (percent * n + 99) // 100


def _sketch(tokens: np.ndarray) -> bytes:
    """A bitmap of the tokens' low bits, with 2 to 4 bits a token."""
    size = 1 << max(6, (2 * len(tokens) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _folded(sketch: bytes, size: int) -> np.ndarray:
    """The bitmap as it would be with ``size`` bytes, at most its own."""
    return np.bitwise_or.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, size), axis=0)


def _missing(a: bytes, b: bytes) -> int:
    """A lower bound of the number of a's tokens that b lacks."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(_folded(a, size) & ~_folded(b, size)).sum())


def _signatures(width: int):
    """Rows (doc_id, n, cls, sketch, mark, key) of documents, and rows (token, df) of shingles seen in several sets of one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def counted() -> pa.RecordBatch:
            token, df = np.unique(np.concatenate([*held.values(), np.zeros(0, np.uint64)]), return_counts=True)
            token, df = token[df > 1], df[df > 1]
            n = len(token)
            none = pa.nulls(n, pa.int64())
            return rows(none, df, token, False, [None] * n, none, none)

        def rows(doc_id, n, cls, is_doc, sketch, mark, key) -> pa.RecordBatch:
            columns = [doc_id, pa.array(n.astype(np.int64)), pa.array(cls.view(np.int64)), pa.array(np.full(len(cls), is_doc)), pa.array(sketch, pa.binary()), mark, key]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "cls", "is_doc", "sketch", "mark", "key"])

        for batch in batches:
            for part in chunks(batch):
                flat, first = _sets(part, width)
                cls = _classes(flat, first)
                own = [flat[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                for c, x in zip(cls.tolist(), own, strict=True):
                    if c not in held:
                        held[c] = x
                        size += len(x)
                yield rows(part.column("doc_id").cast(pa.int64()), np.diff(first), cls, True, [_sketch(x) if len(x) else None for x in own], part.column("mark"), part.column("key"))
                if size >= _COUNTED:
                    yield counted()
                    held, size = {}, 0
        yield counted()

    return run


def _matrix(width: int, percent: int, heavy: np.ndarray, level: np.ndarray):
    """(token, cls, at) for the first tokens of every set in the global order; ``at`` is 64 * place + level."""
    bits = np.uint64((1 << 20) - 1)
    maybe = np.zeros(1 << 20, bool)
    maybe[(heavy & bits).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                flat, first = _sets(part, width)
                cls, n = _classes(flat, first), np.diff(first)
                _, one = np.unique(cls, return_index=True)
                wanted = np.zeros(len(n), np.int64)
                wanted[one] = (n - _need(n, percent) + 1)[one] * (n[one] > 0)
                rank = np.zeros(len(flat), np.int64)
                if len(heavy) and len(flat):
                    at = np.flatnonzero(maybe[(flat & bits).astype(np.int64)])
                    to = np.minimum(np.searchsorted(heavy, flat[at]), len(heavy) - 1)
                    hit = heavy[to] == flat[at]
                    rank[at[hit]] = level[to[hit]]
                row = np.repeat(np.arange(len(n)), n)
                light = rank == 0
                place = np.cumsum(light) - light  # light tokens keep their order by hash
                place -= np.repeat(np.concatenate([[0], np.cumsum(light)])[first[:-1]], n)
                take = light & (place < wanted[row])
                lacking = wanted - np.bincount(row[take], minlength=len(n))
                for r in np.flatnonzero(lacking > 0).tolist():
                    own = first[r] + np.flatnonzero(~light[first[r] : first[r + 1]])
                    own = own[np.lexsort((flat[own], rank[own]))[: lacking[r]]]
                    take[own] = True
                    place[own] = wanted[r] - lacking[r] + np.arange(len(own))
                at = np.flatnonzero(take)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[at].view(np.int64)), pa.array(cls[row[at]].view(np.int64)), pa.array((place[at] << 6) + rank[at])], names=["token", "cls", "at"]
                )

    return run


def _full_sets(width: int):
    """(cls, tokens) of the documents whose class is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                flat, first = _sets(part, width)
                cls = _classes(flat, first).view(np.int64)
                rows = np.flatnonzero(cls == part.column("want").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls[rows]), pa.array([flat[first[r] : first[r + 1]].tobytes() for r in rows.tolist()], pa.binary())],
                    names=["cls", "tokens"],
                )

    return run


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    same = _overlap(a, b)
    return 100 * same >= percent * (len(a) + len(b) - same)


def _likely(percent: int):
    """The pairs (a, b) of classes whose bitmaps admit a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [
                100 * min(m, n) >= percent * max(m, n) and _missing(x, y) <= m - _need(m, percent) and _missing(y, x) <= n - _need(n, percent)
                for m, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("a_n", "b_n", "a_sketch", "b_sketch")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _group_sketch(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """The bitmap of a group's token union, at the size of its smallest member's."""
    own = group.column("sketch").to_pylist()
    size = min(map(len, own))
    return pa.table({"part": [key[0].as_py()], "union": [np.bitwise_or.reduce([_folded(x, size) for x in own]).tobytes()]})


def _qualify(percent: int):
    """The pairs (q, part) whose bitmaps admit the overlap that a link needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_missing(x, y) <= n - _need(n, percent) for n, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "sketch", "union")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("part")], names=["q", "part"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column("a_tokens").to_pylist(), batch.column("b_tokens").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _open(percent: int):
    """Bound each class's overlap with its group's union; open the group if it qualifies and return the first link."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        members = right.column("cls").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in right.column("tokens").to_pylist()]
        union = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        for q, tokens in zip(left.column("q").to_pylist(), left.column("q_set").to_pylist(), strict=True):
            own = np.frombuffer(tokens, np.uint64)
            if _overlap(own, union) < _need(len(own), percent):
                continue
            for cls, other in zip(members, sets, strict=True):
                if 100 * min(len(other), len(own)) >= percent * max(len(other), len(own)) and _linked(own, other, percent):
                    a.append(q)
                    b.append(cls)
                    break
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_shingles, component_id, cls, component, mark) for every row of ``docs`` (doc_id, text, and mark if there; other columns are not read).

    Two rows link when 100 * |A & B| >= percent * |A | B|. ``component_id`` is the smallest doc_id
    reachable by links, itself included; ``cls`` is equal for rows with one set, ``component`` for rows of one
    component, whatever their ids (null without words). ``mark`` (long) is handed on.
    Null or empty text, or none but white space: n_shingles 0, linked with nothing. Fewer than ``width``
    words: the whole sequence is the one shingle. Repeated rows link with each other; an empty table gives
    an empty result. A null doc_id keeps its row and never names a component that has another id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col("mark") if "mark" in docs.columns else F.lit(None)).cast("long").alias("mark"))
    # where a class's text is read again; not the id alone, which may be null or stand for several texts
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    seen = scratch.keep("signatures", rows.mapInArrow(_signatures(width), "doc_id long, n long, cls long, is_doc boolean, sketch binary, mark long, key long"))
    sig = seen.where("is_doc").drop("is_doc")
    top = seen.where("not is_doc").groupBy("cls").agg(F.sum("n").alias("df")).where("df >= 4").orderBy(F.desc("df"), "cls").limit(heavy).collect()
    token = np.array([r[0] for r in top], np.int64).view(np.uint64)
    order = np.argsort(token)
    level = np.log2(np.array([r[1] for r in top], float).clip(2)).astype(np.int64) if top else np.zeros(0, np.int64)

    classes = scratch.keep("classes", sig.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    sig = sig.drop("sketch", "key")

    rows = rows.drop("doc_id", "mark")
    entries = scratch.keep("entries", rows.mapInArrow(_matrix(width, percent, token[order], level[order]), "token long, cls long, at long"))
    lists = entries.groupBy("token").agg(F.min("cls").alias("least"), F.max("cls").alias("most"), F.count("*").alias("size"), F.sum(F.xxhash64("cls").cast("decimal(20,0)")).alias("mark"), F.min(F.col("at") % 64).alias("level")).where("least < most")
    lists = lists.groupBy("least", "most", "size", "mark").agg(F.min(F.struct("level", F.col("token").bitwiseXOR(F.lit(-(2**63))), "token"))["token"].alias("token"), F.count("*").alias("times"))
    listed = scratch.keep("listed", entries.join(lists, "token").distinct())
    scratch.drop("entries")
    # u: tokens among the first ones that no other class has among its own first ones; others may have them later, so u chooses leaders and excludes no link
    first = f"n - ({percent} * n + 99) div 100 + 1"
    shared = listed.groupBy("cls").agg(F.sum("times").alias("times")).join(classes, "cls").select("cls", "n", F.expr(f"{first} - times").alias("u"))
    matrix = scratch.keep("matrix", listed.select("token", "cls", F.floor(F.col("at") / 64).alias("place")).join(shared, "cls"))
    scratch.drop("listed")

    def sets_of(name: str, wanted: DataFrame) -> DataFrame:
        """(cls, tokens) of the wanted classes, from one document of each."""
        need = wanted.distinct().join(classes, "cls").select("key", F.col("cls").alias("want"))
        return scratch.keep(name, rows.join(need, "key").select("text", "want").mapInArrow(_full_sets(width), "cls long, tokens binary").dropDuplicates(["cls"]))

    # stars: each class against the leaders of most of its shared tokens
    leaders = [F.min_by("cls", F.struct(F.col("u") / F.col("n"), "cls")), *(F.min_by("cls", F.xxhash64("cls", F.lit(i))) for i in range(1, LEADERS))]
    led = matrix.groupBy("token").agg(F.array(*leaders).alias("leaders"))
    tally = matrix.join(led, "token").select("cls", F.posexplode("leaders").alias("i", "to")).where("cls <> to").groupBy("cls", "i", "to").agg(F.count("*").alias("same"))
    best = tally.groupBy("cls", "i").agg(F.max(F.struct("same", "to")).alias("best")).select(F.col("cls").alias("a"), F.col("best.to").alias("b")).distinct()
    stars = scratch.keep("likely", _both(best, classes, "n", "sketch").mapInArrow(_likely(percent), "a long, b long"))
    sets = sets_of("star-sets", stars.select(F.explode(F.array("a", "b")).alias("cls")))
    links = scratch.keep("stars", _both(stars, sets, "tokens").mapInArrow(_verify(percent), "a long, b long"))
    scratch.drop("star-sets")
    stars_of = scratch.keep("star-components", components(links, scratch, "star-rounds"))

    # groups of at most about GROUP members, each within one component
    sizes = stars_of.groupBy("component").agg(F.count("*").alias("size"))
    parts = stars_of.join(sizes, "component").select(F.col("node").alias("cls"), F.col("component").alias("home"), "size", F.xxhash64("component", F.when(F.col("size") > GROUP, F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / GROUP))).otherwise(0)).alias("part"))
    own = matrix.join(parts, "cls", "left").select("token", "cls", "place", "n", F.coalesce("home", "cls").alias("home"), F.coalesce("part", "cls").alias("part"), F.coalesce("size", F.lit(1)).alias("size"))
    mixed = own.groupBy("token").agg(F.min("home").alias("lo"), F.max("home").alias("hi")).where("lo < hi").select("token")
    own = scratch.keep("mixed", own.join(mixed, "token"))
    scratch.drop("matrix")

    # classes of the smaller component search the groups of the larger one; of a class and a group's member
    # no more tokens than follow their first common one, which is the first of its list, can be common on either side
    left = f"{100 + percent} * (n - place) - {percent} * n"
    groups = own.groupBy("token", "home", "part", "size").agg(F.min("n").alias("least_n"), F.max(F.expr(left)).alias("left")).withColumnsRenamed({"home": "other", "size": "other_size"})
    meet = own.select("token", F.col("cls").alias("q"), "place", "n", "home", "size").join(groups, "token")
    meet = meet.where(f"(size, home) < (other_size, other) and {left} >= {percent} * least_n and left >= {percent} * n")
    members = scratch.keep("members", own.select("cls", "part").distinct())
    pairs = scratch.keep("pairs", meet.select("q", "part").distinct())
    scratch.drop("mixed")
    unions = members.join(pairs.select("part").distinct(), "part").join(classes, "cls").select("part", "sketch").groupBy("part").applyInArrow(_group_sketch, "part long, union binary")
    asked = pairs.join(classes.select(F.col("cls").alias("q"), "n", "sketch"), "q").join(unions, "part")
    asked = scratch.keep("asked", asked.mapInArrow(_qualify(percent), "q long, part long"))
    members = scratch.keep("asked-members", members.join(asked.select("part").distinct(), "part"))
    sets = sets_of("sets", members.select("cls").union(asked.select("q")))
    # a task holds one group and about GROUP of the classes that ask for it
    dealt = asked.join(asked.groupBy("part").agg(F.count("*").alias("asking")), "part")
    dealt = dealt.select("part", "q", F.pmod(F.xxhash64("q"), F.ceil(F.col("asking") / GROUP)).alias("salt"))
    dealt = scratch.keep("dealt", dealt)
    left = dealt.join(sets.select(F.col("cls").alias("q"), F.col("tokens").alias("q_set")), "q")
    spots = dealt.select(F.col("part").alias("to_part"), F.col("salt").alias("to_salt")).distinct()
    right = spots.join(members, F.col("part") == F.col("to_part")).join(sets, "cls").select("to_part", "to_salt", "cls", "tokens")
    found = left.groupBy("part", "salt").cogroup(right.groupBy("to_part", "to_salt")).applyInArrow(_open(percent), "a long, b long")
    found = scratch.keep("links", found)
    scratch.drop("sets")

    whole = scratch.keep("components", components(links.union(found), scratch, "rounds"))
    named = classes.join(whole.select(F.col("node").alias("cls"), "component"), "cls", "left").select("cls", "doc_id", F.coalesce("component", "cls").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = named.join(least, "component").select("cls", "component_id", "component")
    out = sig.join(labels, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "cls", "component", "mark")


def _both(edges: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """The edges (a, b) with the columns of either class."""
    for end in ("a", "b"):
        edges = edges.join(of.select(F.col("cls").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns)), end)
    return edges


def near_duplicates_removed(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, with all its columns: that of the smallest id, then row hash; null ids go last.

    All rows without words stay. Ids need not be there or be unique: rows of one id with different texts are different documents.
    """
    row = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    found = jaccard_components(docs.select("doc_id", "text", row.alias("mark")))
    stay = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "mark")).alias("stay")).select(F.col("stay.mark").alias("_mark"))
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    one = docs.where(worded).withColumn("_mark", row).join(stay, "_mark", "left_semi").dropDuplicates(["_mark"]).drop("_mark")
    return one.union(docs.where(~worded))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``jaccard_components`` of the whole table; nulls and empty tables as there."""
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
