"""Typed columns, literal conversions and casts."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lexer import QueryError

NUMERIC = ("number", "double")
WHOLE = "decimal(38,0)"  # products and sums of integers, which 64 bits may not hold
GEOMETRY = ("point", "multipoint", "line", "multiline", "polygon", "multipolygon")
DECIMAL = "decimal(38,18)"
ROW_TAGS = {"row_identifier": "row", "row_version": "rv"}
SYSTEM_KINDS = {":id": "row_identifier", ":version": "row_version"}


@dataclass
class Val:
    """A column with its type; ``lit`` holds a literal's value, if it is one; ``integer`` marks numbers that Spark keeps as integers."""

    col: Column
    type: str
    lit: object = None
    literal: bool = False
    integer: bool = False

    @property
    def text(self) -> bool:
        return self.literal and isinstance(self.lit, str)


def literal(value) -> Val:
    if value is None:
        return Val(F.lit(None), "null", None, True)
    if isinstance(value, bool):
        return Val(F.lit(value), "boolean", value, True)
    if isinstance(value, Decimal):
        whole = value == value.to_integral_value() and abs(value) < 2**63
        return Val(F.lit(int(value)) if whole else F.lit(value), "number", value, True, whole)
    return Val(F.lit(value), "text", value, True)


def type_of(field: T.StructField) -> str:
    """The dialect's type of a Spark column; ``kind`` in its metadata wins."""
    if "kind" in field.metadata:
        return field.metadata["kind"]
    kind = field.dataType
    if field.name in SYSTEM_KINDS and isinstance(kind, T.LongType):
        return SYSTEM_KINDS[field.name]
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "double"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.StructType):
        names = set(kind.names)
        for have, name in (({"url", "description"}, "url"), ({"file_id", "filename"}, "document"), ({"point", "address"}, "location"), ({"months", "days", "micros"}, "interval")):
            if have <= names:
                return name
    simple = {T.StringType: "text", T.BooleanType: "boolean", T.TimestampType: "fixed_timestamp", T.TimestampNTZType: "floating_timestamp", T.DateType: "date", T.BinaryType: "geometry", T.VariantType: "json"}
    if hasattr(T, "TimeType"):
        simple[T.TimeType] = "time"
    return next((v for k, v in simple.items() if isinstance(kind, k)), "text")


_PERIOD = re.compile(r"([+-]?)P(?:([+-]?\d+)Y)?(?:([+-]?\d+)M)?(?:([+-]?\d+)W)?(?:([+-]?\d+)D)?(?:T(?:([+-]?\d+)H)?(?:([+-]?\d+)M)?(?:([+-]?\d+(?:\.\d+)?)S)?)?$")


def parse_interval(text: str) -> tuple[int, int, int]:
    """(months, days, microseconds) of an ISO-8601 period."""
    m = _PERIOD.match(text.strip())
    if not m or len(text.strip()) < 3:
        raise QueryError(f"bad interval {text!r}")
    sign = -1 if m[1] == "-" else 1
    y, mo, w, d, h, mi = (int(x or 0) for x in m.groups()[1:7])
    return sign * (12 * y + mo), sign * (7 * w + d), sign * int(((h * 60 + mi) * 60 + Decimal(m[8] or 0)) * 1_000_000)


def interval(months, days, micros) -> Column:
    as_ = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(as_(months, "int").alias("months"), as_(days, "int").alias("days"), as_(micros, "long").alias("micros"))


def let(c: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a column that is computed once, however often ``fn`` names it."""
    return F.transform(F.array(c), fn)[0]


def interval_column(text: Column) -> Column:
    """The interval of a column of ISO-8601 periods, without Python."""
    n = r"([+-]?\d+)"
    form = rf"^([+-]?)P(?=.)(?:{n}Y)?(?:{n}M)?(?:{n}W)?(?:{n}D)?(?:T(?=.)(?:{n}H)?(?:{n}M)?(?:([+-]?\d+(?:\.\d+)?)S)?)?$"

    def made(t: Column) -> Column:
        part = lambda k: F.coalesce(F.nullif(F.regexp_extract(t, form, k), F.lit("")).cast("decimal(20,6)"), F.lit(0))
        sign = F.when(t.startswith("-"), -1).otherwise(1)
        out = interval(sign * (part(2) * 12 + part(3)), sign * (part(4) * 7 + part(5)), sign * ((part(6) * 3600 + part(7) * 60 + part(8)) * 1_000_000))
        return F.when(t.isNotNull() & ~t.rlike(form), F.raise_error(F.concat(F.lit("bad interval "), t))).when(t.isNotNull(), out)

    return let(text, made)


def interval_text(i: Column) -> Column:
    """ISO-8601 text of an interval."""
    return let(i, _interval_text)


def _interval_text(i: Column) -> Column:
    unit = lambda n, u: F.when(n != 0, F.concat(n.cast("string"), F.lit(u))).otherwise("")
    # whole units keep the sign of the part they come from
    div = lambda a, b: F.signum(a).cast("long") * F.floor(F.abs(a) / F.lit(b))
    mon, us = i["months"].cast("long"), i["micros"]
    sec = us / F.lit(1_000_000) - div(us, 60_000_000) * 60
    seconds = F.when(sec != 0, F.concat(F.regexp_replace(F.round(sec, 6).cast("decimal(10,6)").cast("string"), r"\.?0+$", ""), F.lit("S"))).otherwise("")
    time = F.concat(unit(div(us, 3_600_000_000), "H"), unit(div(us, 60_000_000) % 60, "M"), seconds)
    body = F.concat(unit(div(mon, 12), "Y"), unit(mon % 12, "M"), unit(i["days"].cast("long"), "D"), F.when(time != "", F.concat(F.lit("T"), time)).otherwise(""))
    return F.when(i.isNotNull(), F.concat(F.lit("P"), F.when(body == "", "T0S").otherwise(body)))


def number_text(c: Column) -> Column:
    """Digits of a number without trailing zeros."""
    s = c.cast("string")
    return F.when(s.contains("E"), s).when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")).otherwise(s)


def location_text(l: Column) -> Column:
    from .geometry import native_xy

    x, y = native_xy(l["point"])
    full = lambda c: F.nullif(c, F.lit(""))
    city = F.concat_ws(", ", full(l["city"]), full(F.concat_ws(" ", full(l["state"]), full(l["zip"]))))
    spot = F.when(x.isNotNull(), F.concat(F.lit("("), number_text(y), F.lit(", "), number_text(x), F.lit(")")))
    return F.concat_ws("\n", full(l["address"]), full(city), spot)


def _instant(c: Column, pattern: str) -> Column:
    return F.date_format(c.cast("timestamp"), pattern)


TO_TEXT: dict[str, Callable[[Column], Column]] = {
    "text": lambda c: c,
    "null": lambda c: c.cast("string"),
    "blob": lambda c: c,
    "photo": lambda c: c,
    "number": number_text,
    "double": lambda c: c.cast("string"),
    "boolean": lambda c: c.cast("string"),
    "date": lambda c: c.cast("string"),
    "fixed_timestamp": lambda c: _instant(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
    "floating_timestamp": lambda c: _instant(c, "yyyy-MM-dd'T'HH:mm:ss.SSS"),
    "time": lambda c: F.rpad(F.concat(c.cast("string"), F.when(c.cast("string").contains("."), F.lit("")).otherwise(F.lit("."))), 12, "0"),
    "interval": interval_text,
    "json": lambda c: F.to_json(c),
    "document": lambda c: F.to_json(c),
    "url": lambda c: F.when(c["url"].isNotNull() & c["description"].isNotNull(), F.concat(c["description"], F.lit(" ("), c["url"], F.lit(")"))).otherwise(F.coalesce(c["url"], c["description"])),
    "location": location_text,
}


def text_of(v: Val) -> Column:
    if v.type in GEOMETRY or v.type == "geometry":
        from .geometry import to_wkt

        return to_wkt(v.col)
    if v.type in ROW_TAGS:
        return F.concat(F.lit(f"{ROW_TAGS[v.type]}-"), v.col.cast("string"))
    return TO_TEXT[v.type](v.col)


def _boolean(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin("t", "true", "y", "yes", "on", "1"), True).when(s.isin("f", "false", "n", "no", "off", "0"), False).when(c.isNotNull(), F.raise_error(F.concat(F.lit("bad boolean "), c)))


def _from_text(kind: str, v: Val) -> Column:
    c = v.col.cast("string")
    if kind in GEOMETRY:
        from .geometry import from_wkt, wkb_of_wkt

        return F.lit(bytearray(b) if (b := wkb_of_wkt(v.lit, kind)) is not None else None).cast("binary") if v.text else from_wkt(c, kind)
    if kind == "interval":
        return interval(*parse_interval(v.lit)) if v.text else interval_column(c)
    if kind == "location":
        address = F.get_json_object(c, "$.human_address")
        part = lambda name: F.get_json_object(address, f"$.{name}")
        from .geometry import make_point

        at = lambda name: F.get_json_object(c, f"$.{name}").cast("double")
        return F.when(c.isNotNull(), F.struct(make_point(at("longitude"), at("latitude")).alias("point"), *(part(p).alias(p) for p in ("address", "city", "state", "zip"))))
    made = {
        "number": lambda: F.lit(Decimal(v.lit)) if v.text and re.fullmatch(r"[+-]?\d+(\.\d+)?", v.lit) else c.cast(DECIMAL),
        "double": lambda: c.cast("double"),
        "boolean": lambda: _boolean(c),
        "fixed_timestamp": lambda: F.to_timestamp(c),
        "floating_timestamp": lambda: F.to_timestamp(c).cast("timestamp_ntz") if not v.text else F.lit(v.lit.rstrip("Z")).cast("timestamp_ntz"),
        "date": lambda: c.cast("date"),
        "time": lambda: c.cast("time(6)"),
        "json": lambda: F.parse_json(c),
        "blob": lambda: c,
        "photo": lambda: c,
        "url": lambda: F.from_json(c, "struct<url string, description string>"),
        "row_identifier": lambda: F.regexp_replace(c, "^row-", "").cast("long"),
        "row_version": lambda: F.regexp_replace(c, "^rv-", "").cast("long"),
    }
    if kind not in made:
        raise QueryError(f"no cast from text to {kind}")
    return made[kind]()


def cast(v: Val, kind: str) -> Val:
    """``expr::type``"""
    if v.type == kind:
        return v
    if v.type == "null":
        return Val(v.col, kind)
    if kind == "text":
        return Val(text_of(v), "text")
    if v.type == "text":
        return Val(_from_text(kind, v), kind)
    if kind in NUMERIC and v.type in NUMERIC:
        return Val(v.col.cast("double" if kind == "double" else DECIMAL), kind)
    if kind == "point" and v.type == "location":
        return Val(v.col["point"], "point")
    if kind == "date" and v.type == "floating_timestamp":
        return Val(F.to_date(v.col), "date")
    raise QueryError(f"no cast from {v.type} to {kind}")


def agree(a: Val, b: Val) -> tuple[Val, Val]:
    """A string literal takes the other side's type."""
    if a.text and b.type not in ("text", "null"):
        return cast(a, b.type), b
    if b.text and a.type not in ("text", "null"):
        return a, cast(b, a.type)
    return a, b


def common(vals: list[Val]) -> list[Val]:
    """Arguments that must share a type, after literals took it."""
    kinds = {v.type for v in vals if v.type != "null" and not v.text}
    if kinds <= set(NUMERIC) and kinds:
        kind = "double" if "double" in kinds else "number"
    elif len(kinds) > 1:
        raise QueryError(f"arguments of different types: {', '.join(sorted(kinds))}")
    else:
        kind = next(iter(kinds), "text")
    return [cast(v, kind) if v.text and kind != "text" else Val(v.col, kind, v.lit, v.literal) for v in vals]


def need(v: Val, kind: str) -> Val:
    """An argument of a given type; string literals and nulls convert."""
    if v.type == kind or (kind in NUMERIC and v.type in NUMERIC):
        return v
    if v.text or v.type == "null":
        return cast(v, kind)
    raise QueryError(f"expected {kind}, found {v.type}")


def whole(c: Column) -> Column:
    """Round half away from zero to an int."""
    return F.round(c).cast("int")
