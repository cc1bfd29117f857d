"""Result sinks: compact JSON rows under a header, and a schema document."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import GEOMETRY, Val, text_of, type_of


def _plain(df: DataFrame) -> DataFrame:
    """Every column as text or as a JSON value of its own type."""
    out = []
    for f in df.schema:
        kind, c = type_of(f), F.col(f"`{f.name}`")
        keep = kind in ("text", "number", "double", "boolean", "blob", "photo")
        out.append(c.alias(f.name) if keep else F.base64(c).alias(f.name) if kind in (*GEOMETRY, "geometry") else text_of(Val(c, kind)).alias(f.name))
    return df.select(*out)


def schema_document(df: DataFrame, names: bool = True) -> list[dict]:
    return [{"type": type_of(f)} | ({"name": f.name} if names else {}) for f in df.schema]


def cjson(df: DataFrame, data_version: int = 0, last_modified: str | None = None, row_count: int | None = None, locale: str = "en_US") -> Iterator[str]:
    """Lines of one JSON array: a header, then a row of values each. Rows stream from the executors by partition."""
    header = {"approximate_row_count": row_count, "data_version": data_version, "last_modified": last_modified, "locale": locale, "schema": schema_document(df)}
    yield "[" + json.dumps(header)
    for row in _plain(df).toLocalIterator():
        yield "," + json.dumps(list(row), default=lambda v: float(v) if hasattr(v, "as_tuple") else str(v), ensure_ascii=False)
    yield "]"


def gzipped_cjson(df: DataFrame, **header) -> Iterator[bytes]:
    """The same compressed, in chunks as the rows come."""
    press = zlib.compressobj(wbits=31)
    for line in cjson(df, **header):
        if chunk := press.compress(line.encode() + b"\n"):
            yield chunk
    yield press.flush()
