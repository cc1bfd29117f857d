"""Aggregates and window functions by surface name; each aggregate also runs over a window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.lexer import QueryError
from . import geometry as G
from .values import NUMERIC, WHOLE, Val, common, need


def _kept(c: Column, where: Column | None) -> Column:
    return c if where is None else F.when(where, c)


def _text_median(c: Column) -> Column:
    own = F.sort_array(F.collect_list(c))
    return F.when(F.size(own) > 0, F.element_at(own, F.ceil(F.size(own) / 2).cast("int")))


def _simple(fn, kind=None):
    return lambda c, v: Val(fn(c), kind or v.type)


def _numeric(fn, kind="double"):
    def run(c: Column, v: Val) -> Val:
        need(v, "number")
        return Val(fn(c), kind or v.type)

    return run


def _median(c: Column, v: Val) -> Val:
    return Val(_text_median(c), "text") if v.type == "text" else Val(F.median(c), "double")



def spatial(name: str, c: Column, v: Val, over=lambda x: x) -> Val:
    """extent or spatial_union; ``over`` puts the underlying built-in aggregates over a window.

    A union gathers a group's distinct geometries, as its result is of their size.
    """
    if name == "extent":
        box = G.box_(c)
        return Val(G.rectangle_(over(F.min(box[0])), over(F.min(box[1])), over(F.max(box[2])), over(F.max(box[3]))), "multipolygon")
    own = over(F.collect_set(c))
    if v.type in ("point", "multipoint"):
        return Val(G.union_points_all(own), "multipoint")
    if v.type in ("line", "multiline"):
        return Val(G.union_lines_all(own), "multiline")
    if v.type in ("polygon", "multipolygon"):
        return Val(G.union_polygons_all(own), "multipolygon")
    raise QueryError(f"spatial_union of {v.type} is not supported")


ONE = {
    "max": lambda c, v: Val(F.max(F.to_json(c) if v.type == "json" else c), "text" if v.type == "json" else v.type, integer=v.integer),
    "min": lambda c, v: Val(F.min(F.to_json(c) if v.type == "json" else c), "text" if v.type == "json" else v.type, integer=v.integer),
    "sum": lambda c, v: Val(F.sum(need(v, "number") and (c.cast(WHOLE) if v.integer else c)), v.type),
    "avg": _numeric(F.avg, None),
    "median": _median,
    "stddev_pop": _numeric(F.stddev_pop),
    "stddev_samp": _numeric(F.stddev_samp),
    "extent": lambda c, v: spatial("extent", c, v),
    "spatial_union": lambda c, v: spatial("spatial_union", c, v),
}
ONE["median_disc"] = lambda c, v: Val(_text_median(c), v.type)
TWO = {"regr_intercept": F.regr_intercept, "regr_slope": F.regr_slope, "regr_r2": F.regr_r2}
NAMES = {*ONE, *TWO, "count"}
WINDOW_ONLY = {"row_number", "rank", "dense_rank", "first_value", "last_value", "lead", "lag", "ntile"}


def aggregate(name: str, args: list[Val], star: bool, distinct: bool, where: Column | None) -> Val:
    if name == "count":
        if star:
            return Val(F.count(_kept(F.lit(1), where)), "number", integer=True)
        v = args[0]
        c = F.when(v.col["url"].isNotNull() | v.col["description"].isNotNull(), F.lit(1)) if v.type == "url" and not distinct else v.col
        c = _kept(c, where)
        return Val(F.countDistinct(c) if distinct else F.count(c), "number", integer=True)
    if name in TWO:
        y, x = (_kept(a.col.cast("double"), where) for a in args)
        return Val(TWO[name](y, x), "double")
    v = args[0]
    c = _kept(v.col, where)
    if distinct and name in ("sum", "avg"):
        need(v, "number")
        return Val(F.sum_distinct(c) if name == "sum" else F.sum_distinct(c) / F.countDistinct(c), v.type)
    return ONE[name](c, v)


def window_function(name: str, args: list[Val], over) -> Val:
    """A function of windows only; ``over`` puts a built-in over the window."""
    if name in ("row_number", "rank", "dense_rank"):
        return Val(over(getattr(F, name)()), "number")
    if name == "ntile":
        return Val(over(F.ntile(_count(args[0]))), "number")
    v = args[0]
    if name in ("first_value", "last_value"):
        return Val(over((F.first if name == "first_value" else F.last)(v.col, ignorenulls=False)), v.type)
    fn = F.lead if name == "lead" else F.lag
    n = _count(args[1]) if len(args) > 1 else 1
    if len(args) < 3:
        return Val(over(fn(v.col, n)), v.type)
    v, default = common([v, args[2]])
    if default.literal and v.type not in NUMERIC:
        return Val(over(fn(v.col, n, default.lit)), v.type)
    # a row that is there may hold null, so its presence is asked for apart
    return Val(F.when(over(fn(F.lit(True), n)).isNull(), default.col).otherwise(over(fn(v.col, n))), v.type)


def _count(v: Val) -> int:
    if not v.literal:
        raise QueryError("expected a literal number")
    return int(v.lit.to_integral_value(rounding="ROUND_HALF_UP"))
