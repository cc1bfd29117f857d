"""Mixing sources to target weights by systematic sampling (operator 3).

Targets share a total over the sources by weight, with a ceiling for each; each
document of a source then expects target / source size copies. The expected copies are summed along
the source's documents in order of size, one random offset is added, and a document is
emitted once for each integer boundary that its interval crosses. Order by size makes the
taken words follow the target closely.

A document's place is its rank, which comes from counts: sizes within a source, then parts of equal
size within a size, then rows within a part. No window sees more than the distinct sizes of a source,
``PARTS`` parts, or one part.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch, table

WEIGHTS = (5, 2, 1)  # by place of the source's name, repeating
SHARE = 1.5  # of all sizes
CEILING = 2  # times a source's size
PARTS = 4096  # into which documents of one source and size are dealt by id
SEED = 20240229


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """``sizes`` (source, source_size; other columns are handed on) with each source's target.

    Sources sort by code point, null last, and take the weights in turn. What would pass a source's ceiling is
    shared again by weight until none is above: with sources in order of ceiling / weight, those before the first whose
    share of the rest fits stand at their ceilings.
    """
    everything = Window.partitionBy()
    s = sizes.withColumn("place", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("most", F.col("source_size") * ceiling)
    line = everything.orderBy(F.col("most") / F.col("w"), "place")
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(0, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("w").over(after)
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct(F.col("most") / F.col("w"), "place", "level"))).over(everything)["level"])
    return s.select(*sizes.columns, F.least(F.col("most").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("most").cast("double"))).alias("target"))


def mix(docs: DataFrame, seed: int = SEED, carry: bool = True, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, row) of every row; ``row`` holds the whole input row if ``carry``.

    size is the number of words of the text (null: 0); copies is how often the mix takes the row. Sources
    without words have target 0 and copies 0. Rows of one source and size are dealt by id, those without one by their length; repeated
    rows are sampled one by one. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    words = F.expr("regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+')").cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", F.col("text").cast("string").alias("text"))
    part = F.coalesce(F.pmod(F.col("doc_id"), F.lit(PARTS)), -1 - F.coalesce(F.length("text"), F.lit(0)) % 64)
    # a key without null, so that windows and joins over sources share one exchange
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = rows.select("row", "doc_id", "source", key.alias("key"), F.coalesce(words, F.lit(0)).alias("size"), part.cast("long").alias("part"))
    if not carry:
        rows = scratch.keep("sized", rows.drop("row"))
    offset = random.Random(seed).random()
    counts = scratch.keep("counts", rows.groupBy("source", "key", "size", "part").agg(F.count("*").alias("n")))
    by_size = counts.groupBy("source", "key", "size").agg(F.sum("n").alias("n"))
    goal = targets(by_size.groupBy("source", "key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), **options)
    sofar = lambda w: F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    sizes = by_size.withColumn("at_size", sofar(Window.partitionBy("key").orderBy("size"))).drop("n", "source")
    parts = counts.withColumn("at_part", sofar(Window.partitionBy("key", "size").orderBy("part"))).drop("n", "source")
    base = parts.join(sizes, ["key", "size"]).join(goal.drop("source"), "key").withColumn("base", F.col("at_size") + F.col("at_part")).drop("at_size", "at_part")
    own = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("doc_id")))
    own = own.join(base, ["key", "size", "part"]).withColumn("rank", F.col("base") + F.col("rank"))
    copies = F.col("target") / F.col("source_size")
    crossed = F.floor(F.col("rank") * copies + offset) - F.floor((F.col("rank") - 1) * copies + offset)
    return own.withColumn("copies", F.when(F.col("source_size") > 0, crossed).otherwise(F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: rows with two copies come twice, rows with none not at all."""
    out = mix(docs).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mix`` of the whole table as taken words; nulls and empty tables as there."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), carry=False)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(length(text), 0) AS chars, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source
), w AS (
  SELECT *, [{", ".join(map(str, WEIGHTS))}][place % {len(WEIGHTS)} + 1]::BIGINT AS w, source_size * {CEILING} AS most FROM s
), l AS (
  SELECT *, ({SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(w) OVER (ORDER BY most::DOUBLE / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w
), g AS (
  SELECT source, source_size, least(most::DOUBLE, coalesce((SELECT level FROM l WHERE level * w <= most ORDER BY most::DOUBLE / w, place LIMIT 1) * w, most::DOUBLE)) AS target FROM l
), r AS (
  SELECT doc_id, size, source_size, target, target / source_size AS copies,
    row_number() OVER (PARTITION BY g.source ORDER BY size, coalesce(doc_id % {PARTS}, -1 - chars % 64), doc_id) AS rank
  FROM sized JOIN g ON sized.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  (size * CASE WHEN source_size > 0 THEN floor(rank * copies + {random.Random(SEED).random()!r}::DOUBLE) - floor((rank - 1) * copies + {random.Random(SEED).random()!r}::DOUBLE) ELSE 0 END)::BIGINT AS taken
FROM r
"""
ORACLE_SQL = {"op3_mixing": _SQL}
