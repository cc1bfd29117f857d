"""Chat formatting by multi-party perspective rotation (operator 4).

For every participant of a conversation the whole dialogue is rendered once with that speaker as
the assistant and everyone else as a named user; only the assistant's words and their end marker carry loss.
``rotate`` has a row for each perspective and turn, with the segment's text and its place in the rendered
dialogue; ``render`` puts a perspective's segments together, in parts of bounded size, so that no dialogue has to fit into one
row or task. Everything is DataFrame operations; the turns join the conversation's participants, and offsets are sums over
blocks of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import table

BLOCK = 256  # turns whose lengths one window adds up
PART = 1 << 16  # code points: a part holds the segments that begin within so many
# The markers, and what stands for their beginning inside names and texts, which so cannot forge one.
START, END, OPEN, ESCAPED = "<|im_start|>", "<|im_end|>", "<|", "< |"


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit(OPEN), F.lit(ESCAPED))


def rotate(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn, role, name, segment, start, length, loss_start, loss_end) for each participant and turn.

    A segment is ``<|im_start|>assistant\\n...<|im_end|>\\n`` for the perspective's own turns, else
    ``<|im_start|>user name=...\\n...<|im_end|>\\n``; start and length count code points in the rendered dialogue, loss_start and loss_end
    (exclusive) bound the own words and their end marker, header and closing line break left out; they are null in others' turns.
    ``<|`` inside names and texts becomes ``< |``, a line break inside names a space.
    Turns go by turn (nulls last), then role, then text; repeated turns stay, one after the other. A null role is one participant without
    a name, apart from every named one; a null text is empty; rows without a conversation form one of their own. Other columns are not
    read. An empty table gives an empty result.
    """
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    people = own.select(F.col("conv_id").alias("conv"), F.col("name").alias("perspective")).distinct()
    all_ = own.join(people, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    mine = F.col("name").eqNullSafe(F.col("perspective"))
    shown = F.coalesce(F.concat(F.lit(" name="), F.replace(_plain(F.col("name")), F.lit("\n"), F.lit(" "))), F.lit(""))
    all_ = all_.withColumn("head", F.when(mine, F.lit(f"{START}assistant\n")).otherwise(F.concat(F.lit(f"{START}user"), shown, F.lit("\n"))))
    all_ = all_.withColumn("segment", F.concat("head", _plain(F.col("body")), F.lit(f"{END}\n"))).withColumn("length", F.length("segment").cast("long")).withColumn("block", F.floor(F.col("turn") / BLOCK))
    order = [F.col(c).asc_nulls_last() for c in ("turn", "name", "body")]
    keys = ["conv_id", "perspective", "block"]
    in_block = F.sum("length").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    blocks = all_.groupBy(*keys).agg(F.sum("length").alias("size"))
    blocks = blocks.withColumn("base", F.sum("size").over(Window.partitionBy("conv_id", "perspective").orderBy(F.col("block").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).drop("size")
    blocks = blocks.withColumnsRenamed({c: f"{c}_" for c in keys})
    out = all_.withColumn("in_block", in_block).join(blocks, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in keys]).withColumn("start", F.col("base") + F.col("in_block"))
    loss = [F.when(mine, F.col("start") + n).alias(c) for c, n in (("loss_start", F.length("head")), ("loss_end", F.col("length") - 1))]
    return out.select("conv_id", "perspective", "turn", F.when(mine, F.lit("assistant")).otherwise(F.lit("user")).alias("role"), "name", "segment", "start", "length", *loss)


def render(turns: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, perspective, part, start, n_turns, text, masks): each participant's dialogue in parts, to be joined in turn.

    A part holds the segments that begin in its ``part`` code points of the dialogue, each whole; ``start`` is the first one's place. ``masks``
    are the spans with loss as start:end, comma-joined, in code points of the dialogue. Otherwise as ``rotate``.
    """
    rows = rotate(turns).withColumn("part", F.floor(F.col("start") / part))
    own = F.array_sort(F.collect_list(F.struct("start", "segment", F.concat_ws(":", "loss_start", "loss_end").alias("mask"), F.isnotnull("loss_start").alias("loss"))))
    made = rows.groupBy("conv_id", "perspective", "part").agg(own.alias("own"))
    masks = F.array_join(F.transform(F.filter("own", lambda s: s["loss"]), lambda s: s["mask"]), ",")
    return made.select("conv_id", "perspective", "part", F.col("own")[0]["start"].alias("start"), F.size("own").cast("long").alias("n_turns"), F.array_join("own.segment", "").alias("text"), masks.alias("masks"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as each of its participants, ``render`` of the whole table; nulls and empty tables as there."""
    return render(table(spark, sf_dir, "conversations"))


ORACLE_SQL = {
    "op4_chat_format": f"""
WITH own AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role AS name, coalesce(text, '') AS body FROM conversations
), people AS (
  SELECT DISTINCT conv_id AS conv, name AS perspective FROM own
), heads AS (
  SELECT *, name IS NOT DISTINCT FROM perspective AS loss,
    CASE WHEN name IS NOT DISTINCT FROM perspective THEN '{START}assistant'
      ELSE '{START}user' || coalesce(' name=' || replace(replace(name, '{OPEN}', '{ESCAPED}'), chr(10), ' '), '') END || chr(10) AS head
  FROM own JOIN people ON own.conv_id IS NOT DISTINCT FROM people.conv
), segments AS (
  SELECT *, head || replace(body, '{OPEN}', '{ESCAPED}') || '{END}' || chr(10) AS segment FROM heads
), placed AS (
  SELECT *, (sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, name NULLS LAST, body ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(segment))::BIGINT AS start
  FROM segments
)
SELECT conv_id, perspective, start // {PART} AS part, min(start) AS start, count(*) AS n_turns, string_agg(segment, '' ORDER BY start) AS text,
  coalesce(string_agg(CASE WHEN loss THEN (start + length(head))::VARCHAR || ':' || (start + length(segment) - 1)::VARCHAR END, ',' ORDER BY start), '') AS masks
FROM placed GROUP BY conv_id, perspective, start // {PART}
"""
}
