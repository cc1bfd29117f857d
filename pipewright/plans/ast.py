"""The syntax tree of a query; nodes compare by value, so that group keys can be found again in expressions."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lit:
    value: object  # str, Decimal, bool or None


@dataclass(frozen=True)
class Ref:
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Star:
    table: str | None = None
    without: tuple[str, ...] = ()


@dataclass(frozen=True)
class Sort:
    expr: object
    desc: bool = False
    nulls_first: bool | None = None


@dataclass(frozen=True)
class Over:
    partition: tuple = ()
    order: tuple[Sort, ...] = ()
    frame: tuple | None = None  # (rows or range, start, end); a bound is None or a number of rows


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()
    distinct: bool = False
    where: object = None
    over: Over | None = None


@dataclass(frozen=True)
class Cast:
    expr: object
    type: str


@dataclass(frozen=True)
class Field:
    expr: object
    name: str


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str | None = None


@dataclass(frozen=True)
class Source:
    of: object  # a name or a query
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    kind: str
    source: Source
    on: object
    lateral: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple
    source: Source | None = None
    joins: tuple[Join, ...] = ()
    where: object = None
    group: tuple | None = None
    having: object = None
    search: str | None = None
    search_output: bool = False
    order: tuple[Sort, ...] = ()
    limit: int | None = None
    offset: int | None = None
    distinct: bool = False
    distinct_on: tuple = ()
    materialized: bool = False


@dataclass(frozen=True)
class SetOp:
    kind: str
    left: object
    right: object


@dataclass(frozen=True)
class Pipe:
    left: object
    right: Select


@dataclass(frozen=True)
class With:
    of: tuple  # (name, query) in order; each may name those before it
    body: object


@dataclass(frozen=True)
class Values:
    rows: tuple[tuple, ...]


@dataclass
class Names:
    taken: set = field(default_factory=set)


def name_of(e) -> str:
    """The automatic name of an unnamed output."""
    import re

    def words(e) -> str:
        match e:
            case Ref(name, _):
                return name
            case Lit(None):
                return "null"
            case Lit(v):
                return str(v)
            case Call(name, args, distinct, where, over):
                parts = [name.strip("#") or name, *(["distinct"] if distinct else []), *map(words, args)]
                if where is not None:
                    parts += ["filter_where", words(where)]
                if over is not None:
                    parts += ["over", *(["partition_by"] if over.partition else []), *map(words, over.partition), *(["order_by"] if over.order else []), *(words(s.expr) for s in over.order)]
                return "_".join(p for p in parts if p)
            case Cast(x, kind):
                return f"{words(x)}_{kind}"
            case Field(x, name):
                return f"{words(x)}_{name}"
            case Star():
                return ""
        return ""

    out = re.sub(r"[^\w-]+", "_", words(e)).strip("_") or "_"
    return f"_{out}" if out[0].isdigit() else out
