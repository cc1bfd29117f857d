"""A change stream into the catalog: each micro-batch becomes the dataset's next version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators.views import Views
from ..sources.catalog import ID, Catalog


def replay(stream: DataFrame, catalog: Catalog, dataset: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Upsert and delete rows from a stream with the dataset's columns, ``deleted`` boolean and ``seq`` long.

    The last change of each row id in a batch wins. Batches that were applied before a restart are
    recognised by their number and skipped; views that read the dataset are rebuilt after each.
    """
    views = Views(catalog)

    def batch(df: DataFrame, number: int) -> None:
        meta = catalog.meta(dataset)
        if meta.get("last_batch", -1) >= number:
            return
        last = df.withColumn("_n", F.row_number().over(Window.partitionBy(ID).orderBy(F.desc("seq")))).where("_n = 1").drop("_n", "seq")
        gone = F.coalesce(F.col("deleted"), F.lit(False))
        catalog.apply(dataset, meta["version"] + 1, [("rows_changed", last.where(~gone).drop("deleted"), last.where(gone).select(ID))], last_batch=number)
        views.refresh_for(dataset)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
