"""Scalar functions by surface name: each takes typed values and gives one."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.lexer import QueryError
from . import geometry as G
from .values import GEOMETRY, NUMERIC, WHOLE, Val, agree, cast, common, interval, literal, need, number_text, text_of, whole

STAMPS = ("fixed_timestamp", "floating_timestamp")
REGISTRY: dict[str, object] = {}


def define(*names: str):
    def wrap(fn):
        for n in names:
            REGISTRY[n] = fn
        return fn

    return wrap


def _text(v: Val) -> Column:
    return need(v, "text").col


def _bool(c: Column) -> Val:
    return Val(c, "boolean")


def _num(c: Column) -> Val:
    return Val(c, "number")


# -- predicates
def _parts(v: Val) -> list[Column] | None:
    names = {"url": ("url", "description"), "location": ("point", "address", "city", "state", "zip")}.get(v.type)
    return names and [v.col[n] for n in names]


@define("#is_null")
def is_null(v: Val) -> Val:
    parts = _parts(v)
    return _bool(reduce(lambda a, b: a & b, [p.isNull() for p in parts]) if parts else v.col.isNull())


@define("#is_not_null")
def is_not_null(v: Val) -> Val:
    return _bool(~is_null(v).col)


def _equal(a: Val, b: Val) -> Column:
    a, b = agree(a, b)
    if "null" in (a.type, b.type):
        return is_null(b if a.type == "null" else a).col
    if a.type != b.type and not {a.type, b.type} <= set(NUMERIC) and not {a.type, b.type} <= {*GEOMETRY, "geometry"}:
        raise QueryError(f"cannot compare {a.type} with {b.type}")
    left, right = _parts(a), _parts(b)
    return reduce(lambda x, y: x & y, [p.eqNullSafe(q) for p, q in zip(left, right, strict=True)]) if left and right else a.col == b.col


REGISTRY["#="] = lambda a, b: _bool(_equal(a, b))
REGISTRY["#<>"] = lambda a, b: _bool(~_equal(a, b))
REGISTRY["#not"] = lambda a: _bool(~need(a, "boolean").col)
REGISTRY["#and"] = lambda a, b: _bool(need(a, "boolean").col & need(b, "boolean").col)
REGISTRY["#or"] = lambda a, b: _bool(need(a, "boolean").col | need(b, "boolean").col)


def _ordered(op):
    def run(a: Val, b: Val) -> Val:
        a, b = agree(a, b)
        return _bool(op(a.col, b.col))

    return run


REGISTRY |= {"#<": _ordered(lambda a, b: a < b), "#<=": _ordered(lambda a, b: a <= b), "#>": _ordered(lambda a, b: a > b), "#>=": _ordered(lambda a, b: a >= b)}


@define("#between")
def between(x: Val, a: Val, b: Val) -> Val:
    return _bool((agree(x, a)[0].col >= agree(x, a)[1].col) & (agree(x, b)[0].col <= agree(x, b)[1].col))


REGISTRY["#not_between"] = lambda x, a, b: _bool(~between(x, a, b).col)


@define("#in")
def in_(x: Val, *of: Val) -> Val:
    return _bool(x.col.isin(*(agree(x, v)[1].col for v in of)))


REGISTRY["#not_in"] = lambda x, *of: _bool(~in_(x, *of).col)


def _upper(v: Val) -> Val:
    return Val(F.upper(v.col), "text", v.lit.upper() if v.text else None, v.text) if v.type == "text" else v


REGISTRY |= {
    "caseless_one_of": lambda x, *of: in_(_upper(x), *map(_upper, of)),
    "caseless_not_one_of": lambda x, *of: _bool(~in_(_upper(x), *map(_upper, of)).col),
    "caseless_eq": lambda a, b: _bool(_equal(_upper(a), _upper(b))),
    "caseless_ne": lambda a, b: _bool(~_equal(_upper(a), _upper(b))),
    "caseless_starts_with": lambda t, p: _bool(F.startswith(F.upper(_text(t)), F.upper(_text(p)))),
    "caseless_contains": lambda t, p: _bool(F.contains(F.upper(_text(t)), F.upper(_text(p)))),
}


def _extreme(fn):
    def run(*vals: Val) -> Val:
        vals = common(list(vals))
        return Val(fn(*(v.col for v in vals)) if len(vals) > 1 else vals[0].col, vals[0].type)

    return run


REGISTRY |= {"least": _extreme(F.least), "greatest": _extreme(F.greatest)}


# -- text
def _like(t: Val, p: Val) -> Column:
    return F.like(_text(t), _text(p))


@define("substring")
def substring(t: Val, start: Val, n: Val | None = None) -> Val:
    s = whole(start.col)
    first = F.greatest(s, F.lit(1))
    if n is None:
        return Val(F.substr(_text(t), first), "text")
    size = whole(n.col)
    clip = F.greatest(s + size - first, F.lit(0))
    return Val(F.when(size < 0, F.raise_error(F.lit("negative substring length"))).otherwise(F.substr(_text(t), first, clip)), "text")


# Letters whose plain form no decomposition gives.
_UNMARKED = {"Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i", "Ł": "L", "ł": "l", "Ŧ": "T", "ŧ": "t", "Ð": "D", "ð": "d"}
_SPELLED = {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "TH", "þ": "th", "Ĳ": "IJ", "ĳ": "ij"}
#: Marked Latin letters to their bases.
_ACCENTS = {c: d[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()} | _UNMARKED


def unaccent(t: Val) -> Val:
    marked = "".join(_ACCENTS)
    c = F.translate(_text(t), marked, "".join(_ACCENTS.values()))
    return Val(reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), _SPELLED.items(), c), "text")


REGISTRY |= {
    "#like": lambda t, p: _bool(_like(t, p)),
    "#not_like": lambda t, p: _bool(~_like(t, p)),
    "#||": lambda a, b: Val(F.concat(text_of(a), text_of(b)), "text"),
    "lower": lambda t: Val(F.lower(_text(t)), "text"),
    "upper": lambda t: Val(F.upper(_text(t)), "text"),
    "length": lambda t: _num(F.length(_text(t))),
    "replace": lambda t, a, b: Val(F.replace(_text(t), _text(a), _text(b)), "text"),
    "trim": lambda t: Val(F.trim(_text(t)), "text"),
    "trim_leading": lambda t: Val(F.ltrim(_text(t)), "text"),
    "trim_trailing": lambda t: Val(F.rtrim(_text(t)), "text"),
    "starts_with": lambda t, p: _bool(F.startswith(_text(t), _text(p))),
    "contains": lambda t, p: _bool(F.contains(_text(t), _text(p))),
    "left_pad": lambda t, n, f: Val(F.lpad(_text(t), whole(n.col), _text(f)), "text"),
    "right_pad": lambda t, n, f: Val(F.rpad(_text(t), whole(n.col), _text(f)), "text"),
    "chr": lambda n: Val(F.decode(F.unhex(F.lpad(F.hex(whole(n.col)), 8, "0")), "UTF-32"), "text"),
    "split_part": lambda t, d, n: Val(F.split_part(_text(t), _text(d), whole(n.col)), "text"),
    "unaccent": unaccent,
}


# -- numbers
def _pair(op, integers: str | None = None):
    """An operation of two numbers; ``integers`` is the type that two integers take first, so that the result fits."""

    def run(a: Val, b: Val) -> Val:
        a, b = agree(a, b)
        kind = "double" if "double" in (a.type, b.type) else "number"
        x, y = need(a, "number"), need(b, "number")
        both = x.integer and y.integer and integers is not None
        l, r = (x.col.cast(integers), y.col.cast(integers)) if both else (x.col, y.col)
        return Val(op(l, r), kind, integer=both and integers == "long")

    return run


def _same(fn):
    return lambda v: Val(fn(need(v, "number").col), v.type if v.type in NUMERIC else "number", integer=v.integer)


@define("#+")
def plus(a: Val, b: Val) -> Val:
    return _temporal("+", a, b) or _pair(lambda x, y: x + y, "long")(a, b)


@define("#-")
def minus(a: Val, b: Val) -> Val:
    return _temporal("-", a, b) or _pair(lambda x, y: x - y, "long")(a, b)


@define("round")
def round_(x: Val, n: Val | None = None) -> Val:
    x = need(x, "number")
    if n is None or n.literal:
        return Val(F.round(x.col, int(n.lit) if n else 0), x.type)
    scale = F.pow(F.lit(10.0), whole(n.col))
    return Val(F.signum(x.col) * F.floor(F.abs(x.col) * scale + F.lit(0.5)) / scale, "double")


REGISTRY |= {
    "#*": _pair(lambda a, b: a * b, WHOLE),
    "#%": _pair(lambda a, b: a % b, "long"),
    "#^": lambda a, b: Val(F.pow(need(a, "number").col, need(b, "number").col), "double"),
    "#neg": _same(lambda c: -c),
    "ln": lambda x: Val(F.when(need(x, "number").col <= 0, F.raise_error(F.lit("logarithm of a number that is not positive"))).otherwise(F.ln(x.col)), "double"),
    "abs": _same(F.abs),
    "ceil": _same(F.ceil),
    "floor": _same(F.floor),
    "width_bucket": lambda x, lo, hi, n: _num(F.width_bucket(x.col.cast("double"), lo.col.cast("double"), hi.col.cast("double"), whole(n.col))),
    "signed_magnitude_10": lambda x: _num(F.signum(x.col) * F.length(F.floor(F.abs(x.col)).cast("string"))),
    "signed_magnitude_linear": lambda x, w: _num(F.when(w.col == 1, F.floor(x.col)).otherwise(F.signum(x.col) * F.floor(F.abs(x.col) / w.col + 1))),
}
REGISTRY["#/"] = _pair(lambda a, b: a / b)


# -- dates, times, intervals
#: Fixed offsets of zone abbreviations, which the session would read as regions or reject.
ZONES = {"EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00", "GMT": "+00:00", "UTC": "+00:00"}


def _zone(v: Val) -> Column:
    if v.text:
        return F.lit(ZONES.get(v.lit.upper(), v.lit))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in ZONES.items() for x in kv))[F.upper(v.col)], v.col)


@define("to_floating_timestamp")
def to_floating(ts: Val, zone: Val) -> Val:
    return Val(F.from_utc_timestamp(need(ts, "fixed_timestamp").col, _zone(zone)).cast("timestamp_ntz"), "floating_timestamp")


def _stamp(v: Val) -> Val:
    return v if v.type in (*STAMPS, "date", "time") else need(v, "floating_timestamp")


def _trunc(unit: str):
    def run(v: Val, zone: Val | None = None) -> Val:
        v = _stamp(v)
        if zone is not None:
            v = to_floating(v, zone)
        if v.type == "date":
            return Val(F.trunc(v.col, unit) if unit != "day" else v.col, "date")
        return Val(F.date_trunc(unit, v.col).cast("timestamp" if v.type == "fixed_timestamp" else "timestamp_ntz"), v.type)

    return run


def _second(c: Column) -> Column:
    return F.date_part(F.lit("SECOND"), c)


_PARTS = {
    "y": ("year", F.year), "m": ("month", F.month), "d": ("day", F.dayofmonth), "hh": ("hour", F.hour), "mm": ("minute", F.minute), "ss": ("second", _second),
    "dow": ("day_of_week", lambda c: F.dayofweek(c) - 1), "woy": ("week_of_year", F.weekofyear), "iso_y": ("iso_year", lambda c: F.date_part(F.lit("YEAROFWEEK"), c)),
}
FIELDS: dict[str, object] = {}
for _short, (_field, _fn) in _PARTS.items():
    REGISTRY[f"date_extract_{_short}"] = lambda v, fn=_fn: _num(fn(_stamp(v).col))
    FIELDS[_field] = REGISTRY[f"date_extract_{_short}"]
for _name, _unit in (("ymd", "day"), ("ym", "month"), ("y", "year")):
    REGISTRY[f"date_trunc_{_name}"] = _trunc(_unit)
FIELDS["date"] = lambda v: Val(F.to_date(v.col), "date")
FIELDS["time"] = lambda v: Val(F.make_time(F.hour(v.col), F.minute(v.col), _second(v.col)), "time")


def business_days(a: Column, b: Column) -> Column:
    """Weekdays in the closed interval between two dates."""
    s, e = F.least(a, b), F.greatest(a, b)
    until = lambda d: F.floor((F.datediff(d, F.lit("1970-01-05").cast("date"))) / 7) * 5 + F.least(F.weekday(d) + 1, F.lit(5))
    return until(e) - until(F.date_sub(s, 1))


@define("date_diff_business_days", "business_days_diff")
def diff_business(a: Val, b: Val, zone: Val | None = None) -> Val:
    day = lambda v: F.to_date((to_floating(v, zone) if zone is not None else _stamp(v)).col)
    return _num(business_days(day(a), day(b)))


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


@define("date_diff_d")
def diff_days(a: Val, b: Val) -> Val:
    a, b = agree(_stamp(a), _stamp(b))
    if a.type == "date":
        return _num(F.datediff(a.col, b.col))
    d = _micros(a.col) - _micros(b.col)
    return _num(F.signum(d).cast("long") * F.floor(F.abs(d) / F.lit(86_400_000_000)))


def _shift(stamp: Column, i: Column, sign: int) -> Column:
    secs = (i["micros"] * sign).cast("decimal(20,0)") / F.lit(1_000_000)
    return stamp + F.make_interval(months=i["months"] * sign, days=i["days"] * sign, secs=secs.cast("decimal(18,6)"))


def _micros_of(t: Column) -> Column:
    return (F.hour(t).cast("long") * 3600 + F.minute(t) * 60) * 1_000_000 + (_second(t) * 1_000_000).cast("long")


def _time_of(us: Column) -> Column:
    us = F.pmod(us, F.lit(86_400_000_000))
    return F.make_time(F.floor(us / F.lit(3_600_000_000)).cast("int"), (F.floor(us / F.lit(60_000_000)) % 60).cast("int"), ((us % 60_000_000).cast("decimal(16,6)") / 1_000_000).cast("decimal(16,6)"))


def _temporal(op: str, a: Val, b: Val) -> Val | None:
    kinds = (*STAMPS, "date", "time")
    sign = 1 if op == "+" else -1
    if a.type in kinds and b.text:
        b = cast(b, "interval" if b.lit.lstrip("+-").startswith("P") else a.type)
    elif b.type in kinds and a.text:
        a = cast(a, "interval" if a.lit.lstrip("+-").startswith("P") else b.type)
    if op == "+" and a.type == "interval" and b.type in kinds:
        a, b = b, a
    if a.type in STAMPS and b.type == "interval":
        return Val(_shift(a.col, b.col, sign), a.type)
    if a.type == "date" and b.type == "interval":
        return Val(_shift(a.col.cast("timestamp_ntz"), b.col, sign), "floating_timestamp")
    if a.type == "time" and b.type == "interval":
        return Val(_time_of(_micros_of(a.col) + b.col["micros"] * sign), "time")
    if op == "+" and {a.type, b.type} == {"date", "time"}:
        d, t = (a, b) if a.type == "date" else (b, a)
        return Val(F.make_timestamp_ntz(date=d.col, time=t.col), "floating_timestamp")
    if op == "-" and a.type == b.type == "time":
        return Val(interval(0, 0, _micros_of(a.col) - _micros_of(b.col)), "interval")
    if op == "-" and a.type == b.type == "date":
        return _num(F.datediff(a.col, b.col))
    return None


REGISTRY["date_add"] = lambda ts, i: _temporal("+", _stamp(ts), need(i, "interval"))
REGISTRY["epoch_seconds"] = lambda ts: _num(F.round(_micros(need(ts, "fixed_timestamp").col).cast("decimal(20,0)") / 1_000_000, 3))


# -- geometry, locations, urls, documents, JSON
def _geo(v: Val) -> Val:
    v = Val(v.col["point"], "point") if v.type == "location" else v
    if v.text:
        for kind in GEOMETRY:
            if G.wkb_of_wkt(v.lit, kind) is not None:
                return cast(v, kind)
    if v.type not in (*GEOMETRY, "geometry"):
        raise QueryError(f"expected a geometry, found {v.type}")
    return v


def _box(v: Val) -> list[Column]:
    b = G.box_(_geo(v).col)
    return [b[i] for i in range(4)]


def _multi(kind: str) -> str:
    return {"point": "multipoint", "line": "multiline", "polygon": "multipolygon"}.get(kind, kind)


@define("within_box")
def within_box(g: Val, top: Val, left: Val, bottom: Val, right: Val) -> Val:
    x0, y0, x1, y1 = _box(g)
    t, l, b, r = (v.col.cast("double") for v in (top, left, bottom, right))
    return _bool((x0 >= l) & (x1 <= r) & (y0 >= b) & (y1 <= t))


@define("within_polygon")
def within_polygon(g: Val, p: Val) -> Val:
    a, b = _geo(g), _geo(p)
    return _bool(G.within_(a.col, b.col))


@define("visible_at")
def visible_at(g: Val, n: Val) -> Val:
    v = _geo(g)
    x0, y0, x1, y1 = _box(v)
    big = F.lit(True) if v.type in ("point", "multipoint") else (x1 - x0 >= n.col.cast("double")) | (y1 - y0 >= n.col.cast("double"))
    return _bool(~F.coalesce(G.is_empty_(v.col), F.lit(True)) & big)


@define("#spatial_union")
def spatial_union(a: Val, b: Val) -> Val:
    x, y = _geo(a), _geo(b)
    for fn, kind in ((G.union_points_, "point"), (G.union_lines_, "line"), (G.union_polygons_, "polygon")):
        if {x.type, y.type} <= {kind, f"multi{kind}"}:
            return Val(fn(x.col, y.col), f"multi{kind}")
    raise QueryError(f"spatial_union of {x.type} with {y.type}")


@define("make_valid")
def make_valid(g: Val) -> Val:
    v = _geo(g)
    return Val(G.make_valid_(v.col), "multipolygon" if v.type == "polygon" else v.type)


@define("curated_region_test")
def curated_region_test(g: Val, n: Val) -> Val:
    """Why a geometry cannot serve as a region: 'empty' for null, and null for one that can."""
    v = _geo(g)
    x0, y0, x1, y1 = _box(v)
    out = F.when(v.col.isNull(), "empty").when(G.num_points(v.col) > n.col.cast("double"), "too complex")
    return Val(out.when((x0 < -180) | (x1 > 180) | (y0 < -90) | (y1 > 90), "out of bounds").otherwise(G.invalid_(v.col)), "text")


@define("human_address")
def human_address(*parts: Val) -> Val:
    cols = [_text(p) for p in parts]
    body = F.concat(F.lit("{"), *(x for i, (n, c) in enumerate(zip(("address", "city", "state", "zip"), cols, strict=True)) for x in (F.lit((", " if i else "") + f'"{n}": '), _quoted(c))), F.lit("}"))
    return Val(F.when(~reduce(lambda a, b: a & b, [c.isNull() for c in cols]), body), "text")


def _quoted(c: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r'^\{"v":(.*)\}$', 1)


def _location(point: Val, *parts: Val) -> Val:
    return Val(F.struct(need(point, "point").col.alias("point"), *(_text(p).alias(n) for p, n in zip(parts, ("address", "city", "state", "zip"), strict=True))), "location")


REGISTRY |= {
    "point": lambda lat, lon: Val(G.make_point(lon.col, lat.col), "point"),
    "num_points": lambda g: _num(G.num_points(_geo(g).col)),
    "is_empty": lambda g: _bool(F.coalesce(G.is_empty_(_geo(g).col), F.lit(True))),
    "geo_multi": lambda g: Val(G.to_multi_(_geo(g).col), _multi(_geo(g).type)),
    "geo_collection_extract": lambda g: Val(G.to_multi_(_geo(g).col), _multi(_geo(g).type)),
    "intersects": lambda a, b: _bool(G.intersects_(_geo(a).col, _geo(b).col)),
    "crosses": lambda a, b: _bool(G.crosses_(_geo(a).col, _geo(b).col)),
    "overlaps": lambda a, b: _bool(G.overlaps_(_geo(a).col, _geo(b).col)),
    "within_circle": lambda g, lat, lon, m: _bool(G.distance_(_geo(g).col, G.make_point(lon.col, lat.col)) <= m.col.cast("double")),
    "simplify": lambda g, t: Val(G.simplify_(_geo(g).col, t.col.cast("double")), _geo(g).type),
    "simplify_preserve_topology": lambda g, t: Val(G.simplify_keep(_geo(g).col, t.col.cast("double")), _geo(g).type),
    "snap_to_grid": lambda g, s: Val(G.snap_(_geo(g).col, s.col.cast("double")), _geo(g).type),
    "reduce_precision": lambda g, s: Val(G.snap_(_geo(g).col, s.col.cast("double")), _geo(g).type),
    "area": lambda g: Val(G.area_(_geo(g).col), "double"),
    "distance_in_meters": lambda a, b: Val(G.distance_(_geo(a).col, _geo(b).col), "double"),
    "intersection": lambda a, b: Val(G.intersection_(_geo(a).col, _geo(b).col), "multipolygon"),
    "concave_hull": lambda g, share: Val(G.concave_hull_(_geo(g).col, share.col.cast("double")), "multipolygon"),
    "convex_hull": lambda g: Val(G.convex_hull_(_geo(g).col), "multipolygon"),
    "location": _location,
    "location_latitude": lambda l: Val(G.native_xy(l.col["point"])[1], "double"),
    "location_longitude": lambda l: Val(G.native_xy(l.col["point"])[0], "double"),
    "location_human_address": lambda l: human_address(*(Val(l.col[n], "text") for n in ("address", "city", "state", "zip"))),
    "url": lambda u, d: Val(F.struct(_text(u).alias("url"), _text(d).alias("description")), "url"),
}


@define("#index")
def index(j: Val, n: Val) -> Val:
    if not n.literal:
        raise QueryError("a JSON index must be a literal")
    return Val(F.variant_get(need(j, "json").col, f"$[{int(n.lit)}]", "variant"), "json")


def field(v: Val, name: str) -> Val:
    """``expr.name``"""
    if v.type == "json":
        return Val(F.variant_get(v.col, f"$.{name}", "variant"), "json")
    if v.type in ("url", "document", "location") and name not in ("latitude", "longitude"):
        return Val(v.col[name], "point" if name == "point" else "text")
    if name in ("latitude", "longitude"):
        return Val(G.native_xy(v.col["point"] if v.type == "location" else v.col)[name == "latitude"], "double")
    if v.type in (*STAMPS, "date", "time") and name in FIELDS:
        return FIELDS[name](v)
    raise QueryError(f"{v.type} has no field {name}")


# -- conditions
@define("nullif")
def nullif(a: Val, b: Val) -> Val:
    a, b = agree(a, b)
    return Val(F.nullif(a.col, b.col), a.type)


@define("coalesce")
def coalesce(*vals: Val) -> Val:
    vals = common(list(vals))
    return Val(F.coalesce(*(v.col for v in vals)), vals[0].type)


@define("case")
def case(*args: Val) -> Val:
    values = common(list(args[1::2]))
    out = F
    for i, v in enumerate(values):
        test = args[2 * i]
        if test.literal and test.lit is True:
            return Val(v.col if out is F else out.otherwise(v.col), v.type)
        out = out.when(need(test, "boolean").col, v.col)
    return Val(out, values[0].type)


REGISTRY["iif"] = lambda c, a, b: case(c, a, literal(True), b)
