"""The split of documents into training and held-out ones by crc32 of the id's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDS = 5


def held_out(fold: int) -> Column:
    """Whether crc32(doc_id as text) mod 5 is ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == fold
