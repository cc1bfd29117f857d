"""Typed datasets from delimited text and from mutation scripts: text columns that take the dialect's types."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import GEOMETRY, Val, cast
from ..plans.lexer import QueryError
from .catalog import ID, Catalog

# Spark types of the dialect's types in an empty copy.
SPARK_TYPES = {
    "text": "string", "number": "decimal(38,18)", "double": "double", "boolean": "boolean", "fixed_timestamp": "timestamp", "floating_timestamp": "timestamp_ntz", "date": "date", "time": "time(6)",
    "interval": "struct<months: int, days: int, micros: bigint>", "json": "variant", "blob": "string", "photo": "string", "url": "struct<url: string, description: string>",
    "document": "struct<file_id: string, filename: string, content_type: string>", "location": "struct<point: binary, address: string, city: string, state: string, zip: string>",
    "row_identifier": "bigint", "row_version": "bigint",
} | dict.fromkeys(GEOMETRY, "binary")


def decode(c: Column, kind: str) -> Column:
    """A text column as a type. Stamps may end in a short offset (``+00``), geometries may be hexadecimal WKB, true and false may be t and f."""
    if kind in ("fixed_timestamp", "floating_timestamp"):
        c = F.regexp_replace(c, r"([+-]\d\d)$", "$1:00") if kind == "fixed_timestamp" else c
    if kind in GEOMETRY:
        hexadecimal = c.rlike("^(?:[0-9A-Fa-f]{2})+$")
        return F.when(hexadecimal, F.unhex(c)).otherwise(cast(Val(F.when(~hexadecimal, c), "text"), kind).col)
    if kind == "document":
        return F.from_json(c, SPARK_TYPES["document"])
    return cast(Val(c, "text"), kind).col


def typed(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The columns of ``kinds`` from a table of texts, with the types in the columns' metadata; empty text stays text and is null elsewhere."""
    unknown = set(kinds.values()) - SPARK_TYPES.keys()
    if unknown:
        raise QueryError(f"no such type: {', '.join(sorted(unknown))}")
    value = lambda n, k: F.col(f"`{n}`") if k == "text" else F.nullif(F.col(f"`{n}`"), F.lit(""))
    return rows.select(*(decode(value(n, k), k).alias(n, metadata={"kind": k}) for n, k in kinds.items()))


def read_csv(spark: SparkSession, path: str, kinds: dict[str, str], header: bool = True, **options) -> DataFrame:
    """Delimited text with the given columns, in order; only the columns a query needs are decoded."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in kinds])
    options = {"header": header, "quote": '"', "escape": '"', "multiLine": False, "enforceSchema": not header} | options
    return typed(spark.read.schema(schema).options(**options).csv(path), kinds)


def write_csv(df: DataFrame, path: str, header: bool = True, **options) -> None:
    """The rows as delimited text in the forms that ``read_csv`` takes."""
    from .results import _plain

    plain = _plain(df)
    plain.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in plain.columns)).write.options(header=header, quote='"', escape='"', **options).csv(path)


def mutations(text: str) -> list[dict]:
    """The operations of a mutation script: a JSON array, in which keys may go without quotes."""
    try:
        return json.loads(text)
    except ValueError:
        return json.loads(re.sub(r'([{,]\s*)([A-Za-z_]\w*)(\s*:)', r'\1"\2"\3', text))


def replay_script(catalog: Catalog, name: str, text: str) -> dict:
    """Run a mutation script on a dataset: ``create``, ``add column``, ``row data`` and the rows after it, ``publish``.

    Rows are objects of column names and values; row ids count up from those that are there. A one-element array deletes the row of
    that id. Everything between two published states is one change set. Returns the new metadata.
    """
    events: list[tuple] = []
    kinds: dict[str, str] = {}
    rows: list[dict] = []
    gone: list[int] = []
    fresh = catalog.exists(name)
    if fresh:
        kinds = {k: v for k, v in catalog.schema(name).items() if k != ID}
    start = (catalog.read(name).agg(F.max(ID)).first()[0] or 0) if fresh else 0

    def flush() -> None:
        if rows or gone:
            schema = T.StructType([T.StructField(ID, T.StringType()), *(T.StructField(n, T.StringType()) for n in kinds)])
            as_text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
            own = catalog.spark.createDataFrame([(f"row-{start + i + 1}", *(as_text(r.get(n)) for n in kinds)) for i, r in enumerate(rows)], schema)
            data = typed(own, {ID: "row_identifier"} | kinds)
            events.append(("rows_changed", data if rows else None, catalog.spark.createDataFrame([(g,) for g in gone], f"`{ID}` long") if gone else None))
            rows.clear()
            gone.clear()

    for op in mutations(text):
        if isinstance(op, list):
            gone.append(int(op[0]))
        elif "c" not in op:
            rows.append(op)
        elif op["c"] == "create":
            events.append(("working_copy_created", f"`{ID}` bigint"))
        elif op["c"] == "add column":
            kinds[op.get("field_name", op["id"])] = op["type"]
            events.append(("column_created", op.get("field_name", op["id"]), SPARK_TYPES[op["type"]], op["type"]))
        elif op["c"] == "row data":
            flush()
        elif op["c"] == "publish":
            flush()
            events.append(("working_copy_published",))
        else:
            raise QueryError(f"no such operation: {op['c']}")
    flush()
    return catalog.apply(name, (catalog.version(name) if fresh else 0) + 1, events)
