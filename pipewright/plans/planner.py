"""Syntax tree to DataFrame: name and type resolution, grouping, windows, joins, set operations."""

from __future__ import annotations

import contextlib
import datetime
import hashlib
import itertools
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import aggregate as A
from ..functions import geometry as G
from ..functions import scalar as S
from ..functions import search
from ..functions.obfuscate import clear, obfuscated
from ..functions.values import DECIMAL, ROW_TAGS, Val, cast, literal, need, type_of
from .ast import Call, Cast, Field, Item, Lit, Over, Pipe, Ref, Select, SetOp, Sort, Source, Star, Values, With, name_of
from .lexer import QueryError
from .parser import parse

_ids = itertools.count()


@dataclass(frozen=True)
class Output:
    """A column of a relation: how queries name it, and what it is called in the DataFrame."""

    table: str | None
    name: str
    physical: str
    type: str
    integer: bool = False


@dataclass
class Relation:
    df: DataFrame
    columns: list[Output]

    def named(self, alias: str | None) -> Relation:
        return Relation(self.df, [replace(c, table=alias) for c in self.columns])

    def result(self) -> DataFrame:
        """The DataFrame with output names, and types in the columns' metadata."""
        return self.df.select(*(F.col(c.physical).alias(c.name, metadata={"kind": c.type}) for c in self.columns))


def relation(df: DataFrame, alias: str | None = None, exact: bool = False) -> Relation:
    """A DataFrame under fresh column names, so that no join is ambiguous; with ``exact``, floating-point columns become decimals."""
    columns, cols = [], []
    for f in df.schema:
        kind, c = type_of(f), F.col(f"`{f.name}`")
        if exact and kind == "double":
            kind, c = "number", c.cast(DECIMAL)
        columns.append(Output(alias, f.name, f"c{next(_ids)}", kind, isinstance(f.dataType, T.IntegralType) and kind == "number"))
        cols.append(c.alias(columns[-1].physical))
    return Relation(df.select(*cols), columns)


@dataclass
class Context:
    """What a query may refer to besides its text."""

    spark: SparkSession
    tables: Callable[[str], DataFrame]
    primary: str | None = None
    variables: dict[str, str] = field(default_factory=dict)
    now: datetime.datetime = field(default_factory=lambda: datetime.datetime.now(datetime.timezone.utc).replace(microsecond=0))
    case_sensitive: bool = True
    held: list[DataFrame] = field(default_factory=list)  # persisted for hints
    exact: bool = False  # floating-point columns of tables count as decimals
    obfuscation_key: bytes | None = None  # without one, row ids and versions read row-<n> and rv-<n>


class Env:
    """Name resolution within one select."""

    def __init__(self, ctx: Context, columns: list[Output], aliases: dict[str, object] | None = None, outer: Env | None = None):
        self.ctx, self.columns, self.aliases, self.outer = ctx, columns, aliases or {}, outer
        self.keys: dict[object, Val] | None = None  # group keys, if grouped
        self.aggregates: dict[object, tuple[str, Val]] = {}
        self.busy: set[str] = set()
        self.ready: dict[object, Val] = {}  # windows that are there as columns

    def find(self, ref: Ref) -> Val | None:
        hits = [c for c in self.columns if c.name == ref.name and (ref.table is None or c.table == ref.table)]
        if len(hits) > 1 and ref.table is None:
            hits = hits[:1]
        return Val(F.col(hits[0].physical), hits[0].type, integer=hits[0].integer) if hits else None

    def resolve(self, ref: Ref) -> Val:
        v = self.find(ref)
        if v is not None and self.keys is None:
            return v
        if ref.table is None and ref.name in self.aliases and ref.name not in self.busy:
            self.busy.add(ref.name)
            try:
                return self.eval(self.aliases[ref.name])
            finally:
                self.busy.discard(ref.name)
        if v is not None:
            raise QueryError(f"column {ref.name} must be grouped or aggregated")
        if self.outer is not None:
            hits = [c for c in self.outer.columns if c.name == ref.name and (ref.table is None or c.table == ref.table)]
            if hits:
                return Val(F.col(hits[0].physical).outer(), hits[0].type, integer=hits[0].integer)
        raise QueryError(f"no such column: {ref.name}")

    def eval(self, e) -> Val:
        if self.keys is not None and e in self.keys:
            return self.keys[e]
        if e in self.ready:
            return self.ready[e]
        match e:
            case Lit(value):
                return literal(value)
            case Ref():
                return self.resolve(e)
            case Cast(x, kind):
                v = self.eval(x)
                if self.ctx.obfuscation_key and kind == "text" and v.type in ROW_TAGS:
                    return Val(obfuscated(v.col, self.ctx.obfuscation_key, ROW_TAGS[v.type]), "text")
                return cast(self.row_literal(v, kind), kind)
            case Field(x, name):
                if isinstance(x, Ref) and x.table is None and self.find(x) is None and x.name not in self.aliases:
                    return self.resolve(Ref(name, x.name))
                return S.field(self.eval(x), name)
            case Call():
                return self.call(e)
        raise QueryError(f"unexpected {e!r}")

    def row_literal(self, v: Val, kind: str) -> Val:
        """A text literal that stands for a row id or version, as that number."""
        if not (self.ctx.obfuscation_key and kind in ROW_TAGS and v.text):
            return v
        n = clear(v.lit, self.ctx.obfuscation_key, ROW_TAGS[kind])
        if n is None:
            raise QueryError(f"{v.lit!r} is no {kind}")
        return Val(F.lit(n).cast("long"), kind)

    def call(self, e: Call) -> Val:
        if e.over is not None:
            return self.windowed(e)
        if e.name in A.NAMES:
            return self.aggregate(e)
        if e.where is not None or e.distinct:
            raise QueryError(f"{e.name} is not an aggregate")
        if e.name == "get_utc_date":
            return Val(F.lit(self.ctx.now), "fixed_timestamp")
        if e.name == "get_context":
            return self.variable(self.eval(e.args[0]))
        fn = S.REGISTRY.get(e.name)
        if fn is None:
            raise QueryError(f"no such function: {e.name}")
        args = [self.eval(a) for a in e.args]
        if row := next((a.type for a in args if a.type in ROW_TAGS), None):
            args = [self.row_literal(a, row) for a in args]
        if not self.ctx.case_sensitive and e.name in ("#=", "#<>", "#in", "#not_in", "#like", "#not_like", "#<", "#<=", "#>", "#>="):
            args = [S._upper(a) for a in args]
        try:
            return fn(*args)
        except TypeError as x:
            raise QueryError(f"bad arguments of {e.name}: {x}") from x

    def variable(self, key: Val) -> Val:
        own = self.ctx.variables
        if key.text:
            return Val(F.lit(own.get(key.lit)).cast("string"), "text")
        if not own:
            return Val(F.lit(None).cast("string"), "text")
        return Val(F.create_map(*(F.lit(x) for kv in own.items() for x in kv))[key.col], "text")

    def aggregate(self, e: Call) -> Val:
        if self.keys is None:
            raise QueryError(f"aggregate {e.name} is not allowed here")
        if e not in self.aggregates:
            inner = Env(self.ctx, self.columns, self.aliases, self.outer)
            star = bool(e.args) and isinstance(e.args[0], Star)
            where = inner.eval(e.where).col if e.where is not None else None
            v = A.aggregate(e.name, [] if star else [inner.eval(a) for a in e.args], star, e.distinct, where)
            self.aggregates[e] = (f"a{next(_ids)}", v)
        name, v = self.aggregates[e]
        return Val(F.col(name), v.type, integer=v.integer)

    def spec(self, over: Over):
        w = Window.partitionBy(*(self.eval(p).col for p in over.partition))
        if over.order:
            w = w.orderBy(*(sort_column(self, s) for s in over.order))
        if over.frame:
            kind, start, end = over.frame
            edge = {"first": Window.unboundedPreceding, "last": Window.unboundedFollowing}
            bounds = [edge.get(b, b) for b in (start, end)]
            w = w.rowsBetween(*bounds) if kind == "rows" else w.rangeBetween(*bounds)
        return w

    def windowed(self, e: Call) -> Val:
        w = self.spec(e.over)
        star = bool(e.args) and isinstance(e.args[0], Star)
        args = [] if star else [self.eval(a) for a in e.args]
        if e.name in A.WINDOW_ONLY:
            return A.window_function(e.name, args, lambda c: c.over(w))
        if e.name not in A.NAMES:
            raise QueryError(f"{e.name} is not a window function")
        where = self.eval(e.where).col if e.where is not None else None
        if e.distinct and e.name == "count":
            return Val(F.size(F.collect_set(A._kept(args[0].col, where)).over(w)), "number")
        if e.name in ("median", "median_disc") and (args[0].type == "text" or e.over.order or e.name == "median_disc"):
            own = F.sort_array(F.collect_list(A._kept(args[0].col, where)).over(w))
            n = F.size(own)
            low = F.element_at(own, F.greatest(F.ceil(n / 2), F.lit(1)).cast("int"))
            if args[0].type == "text" or e.name == "median_disc":
                return Val(F.when(n > 0, low), args[0].type)
            return Val(F.when(n > 0, (low.cast("double") + F.element_at(own, (F.floor(n / 2) + 1).cast("int")).cast("double")) / 2), "double")
        if e.name in ("extent", "spatial_union"):
            return A.spatial(e.name, A._kept(args[0].col, where), args[0], lambda c: c.over(w))
        v = A.aggregate(e.name, args, star, e.distinct, where)
        return Val(v.col.over(w), v.type, integer=v.integer)


def sort_column(env: Env, s: Sort) -> Column:
    """Ascending keys put nulls last and descending ones first, unless the query says otherwise."""
    c = env.eval(s.expr).col
    first = s.desc if s.nulls_first is None else s.nulls_first
    if s.desc:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()


def is_constant(e) -> bool:
    return isinstance(e, Lit) or isinstance(e, Cast) and is_constant(e.expr) or isinstance(e, Call) and e.over is None and e.name not in A.NAMES and bool(e.args) and all(map(is_constant, e.args))


def has_aggregate(e) -> bool:
    match e:
        case Call(name, args, _, _, over):
            return over is None and name in A.NAMES or any(map(has_aggregate, args)) or over is not None and any(map(has_aggregate, (*over.partition, *(s.expr for s in over.order))))
        case Cast(x, _) | Field(x, _):
            return has_aggregate(x)
    return False


BOXED = ("within_polygon", "intersects", "crosses", "overlaps")  # of two geometries whose boxes meet


def refs(e) -> list[Ref]:
    """The columns that an expression names."""
    match e:
        case Ref():
            return [e]
        case Call(_, args):
            return [r for a in args for r in refs(a)]
        case Cast(x, _) | Field(x, _):
            return refs(x)
    return []


def cells_joined(left: DataFrame, right: DataFrame, a: Column, b: Column, on: Column) -> DataFrame:
    """An inner join on geometries as an equi-join over the one-degree cells of their boxes.

    A pair is taken in one cell only, that of the lower left corner that its boxes share; coordinates far outside the globe
    count as its rim.
    """
    cell = lambda c: F.floor(F.least(F.greatest(c, F.lit(-361.0)), F.lit(361.0)))
    names, sides = [f"g{next(_ids)}" for _ in range(6)], []
    for df, g, (box, x, y) in ((left, a, names[:3]), (right, b, names[3:])):
        df = df.withColumn(box, G.box_(g)).filter(F.col(box).isNotNull())
        for n, low, high in ((x, 0, 2), (y, 1, 3)):
            df = df.withColumn(n, F.explode(F.sequence(cell(F.col(box)[low]), cell(F.col(box)[high]))))
        sides.append(df)
    p, px, py, q, qx, qy = map(F.col, names)
    corner = (px == F.greatest(cell(p[0]), cell(q[0]))) & (py == F.greatest(cell(p[1]), cell(q[1])))
    return sides[0].join(sides[1], (px == qx) & (py == qy) & corner).filter(on).drop(*names)


def whole_windows(e) -> set[Call]:
    """The aggregates over all rows in an expression."""
    match e:
        case Call(name, args, _, _, over):
            if over is not None and over == Over() and name in A.NAMES:
                return {e}
            return {c for a in args for c in whole_windows(a)}
        case Cast(x, _) | Field(x, _):
            return whole_windows(x)
    return set()


def searchable(columns: list[tuple[Val, str]], query: str) -> Column:
    """Text and URL columns together hold all terms, or a number column equals the query."""
    texts = [v.col if v.type == "text" else c for v, _ in columns if v.type in ("text", "url") for c in ([v.col] if v.type == "text" else [v.col["url"], v.col["description"]])]
    test = search.matches(texts, query)
    try:
        number = float(query)
    except ValueError:
        return test
    for v, _ in columns:
        if v.type in ("number", "double"):
            test = test | F.coalesce(v.col.cast("double") == number, F.lit(False))
    return test


class Planner:
    def __init__(self, ctx: Context):
        self.ctx = ctx
        self.named: dict[str, Relation] = {}  # common table expressions in scope

    def query(self, q, current: Relation | None = None, outer: Env | None = None) -> Relation:
        match q:
            case Select():
                return self.select(q, current, outer)
            case Pipe(left, right):
                made = self.query(left, current, outer)
                if isinstance(left, Select) and left.materialized:
                    made = Relation(made.df.persist(), made.columns)
                    self.ctx.held.append(made.df)
                return self.select(right, made.named(None), outer)
            case SetOp(kind, left, right):
                return self.set_op(kind, self.query(left, current, outer), self.query(right, current, outer))
            case With(of, body):
                before = self.named
                for name, part in of:
                    self.named = self.named | {name: self.query(part, current, outer)}
                made, self.named = self.query(body, current, outer), before
                return made
            case Values(rows):
                return self.values(rows)
        raise QueryError(f"unexpected {q!r}")

    def values(self, rows: tuple) -> Relation:
        """Literal rows under the names column_1, column_2, ...; a column has the type of its first value that is not null."""
        env, one = Env(self.ctx, []), self.ctx.spark.range(1)
        vals = [[env.eval(e) for e in row] for row in rows]
        if len({len(row) for row in vals}) != 1:
            raise QueryError("rows of values differ in length")
        kinds = [next((v.type for v in column if not (v.literal and v.lit is None)), "text") for column in zip(*vals, strict=True)]
        whole = [all(v.integer for v in column) for column in zip(*vals, strict=True)]
        columns = [Output(None, f"column_{i + 1}", f"c{next(_ids)}", k, w) for i, (k, w) in enumerate(zip(kinds, whole, strict=True))]
        made = F.array(*(F.struct(*(cast(v, c.type).col.alias(c.physical) for v, c in zip(row, columns, strict=True))) for row in vals))
        return Relation(one.select(F.inline(made)), columns)

    def set_op(self, kind: str, a: Relation, b: Relation) -> Relation:
        if len(a.columns) != len(b.columns):
            raise QueryError("set operations need the same number of columns")
        for x, y in zip(a.columns, b.columns, strict=True):
            if x.type != y.type and {x.type, y.type} - {"number", "double", "null"} and "null" not in (x.type, y.type):
                raise QueryError(f"set operation of {x.type} with {y.type}")
        l, r = a.df.select(*(c.physical for c in a.columns)), b.df.select(*(c.physical for c in b.columns))
        made = {
            "union": lambda: l.union(r).distinct(), "union all": lambda: l.unionAll(r), "intersect": lambda: l.intersect(r), "intersect all": lambda: l.intersectAll(r),
            "minus": lambda: l.subtract(r), "minus all": lambda: l.exceptAll(r),
        }[kind]()
        return Relation(made, [replace(x, integer=x.integer and y.integer) for x, y in zip(a.columns, b.columns, strict=True)])

    def source(self, s: Source, current: Relation | None, outer: Env | None = None) -> Relation:
        if not isinstance(s.of, str):
            return self.query(s.of, current, outer).named(s.alias)
        if s.of == "this":
            if current is None:
                raise QueryError("@this has no input here")
            return self.fresh(current, s.alias)
        if s.of == "single_row":
            return Relation(self.ctx.spark.range(1).select(), [])
        if s.of in self.named:
            return self.fresh(self.named[s.of], s.alias or s.of)
        return relation(self.ctx.tables(s.of), s.alias or s.of, self.ctx.exact)

    @staticmethod
    def fresh(rel: Relation, alias: str | None) -> Relation:
        """Under fresh column names, so that one expression may be joined with itself."""
        columns = [replace(c, table=alias, physical=f"c{next(_ids)}") for c in rel.columns]
        return Relation(rel.df.select(*(F.col(a.physical).alias(b.physical) for a, b in zip(rel.columns, columns, strict=True))), columns)

    def select(self, q: Select, current: Relation | None, outer: Env | None) -> Relation:
        if q.source is not None:
            rel = self.source(q.source, current)
        elif current is not None:
            rel = current
        elif self.ctx.primary is not None:
            rel = relation(self.ctx.tables(self.ctx.primary), self.ctx.primary, self.ctx.exact)
        else:
            rel = Relation(self.ctx.spark.range(1).select(), [])
        for j in q.joins:
            rel = self.join(rel, j, current, outer)
        items = self.expand(q, rel)
        aliases = {i.alias: i.expr for i in items if i.alias}
        df, env = rel.df, Env(self.ctx, rel.columns, aliases, outer)
        if q.where is not None:
            df = df.filter(need(env.eval(q.where), "boolean").col)
        if q.search is not None and not q.search_output:
            df = df.filter(searchable([(Val(F.col(c.physical), c.type), c.name) for c in rel.columns], q.search))
        exprs = [i.expr for i in items] + [s.expr for s in q.order] + ([q.having] if q.having is not None else [])
        if q.group is not None or any(has_aggregate(aliases.get(e.name, e) if isinstance(e, Ref) else e) for e in exprs):
            df, env = self.grouped(q, df, env, items)
        return self.finish(q, items, self.totals(df, env, exprs), env)

    @staticmethod
    def totals(df: DataFrame, env: Env, exprs: list) -> DataFrame:
        """``df`` with the aggregates over all rows as columns: one row, joined to every row, instead of a window in one task."""
        found = {c for e in exprs for c in whole_windows(env.aliases.get(e.name, e) if isinstance(e, Ref) and env.find(e) is None else e)}
        made = {}
        for c in sorted(found, key=repr):
            star = bool(c.args) and isinstance(c.args[0], Star)
            where = env.eval(c.where).col if c.where is not None else None
            made[c] = f"t{next(_ids)}", A.aggregate(c.name, [] if star else [env.eval(a) for a in c.args], star, c.distinct, where)
        if not made:
            return df
        env.ready |= {c: Val(F.col(n), v.type, integer=v.integer) for c, (n, v) in made.items()}
        return df.crossJoin(F.broadcast(df.select(*(v.col.alias(n) for n, v in made.values()))))

    def join(self, left: Relation, j, current: Relation | None, outer: Env | None) -> Relation:
        right = self.source(j.source, current, Env(self.ctx, left.columns) if j.lateral else None)
        both = left.columns + right.columns
        on = need(Env(self.ctx, both, outer=outer).eval(j.on), "boolean")
        if j.lateral:
            made = left.df.lateralJoin(right.df, on.col, "inner" if j.kind == "inner" else "left")
        elif on.literal and on.lit is True and j.kind == "inner":
            made = left.df.crossJoin(right.df)
        elif j.kind == "inner" and (ends := self.spatial_ends(j.on, left, right)) is not None:
            made = cells_joined(left.df, right.df, *ends, on.col)
        else:
            made = left.df.join(right.df, on.col, j.kind)
        return Relation(made, both)

    def spatial_ends(self, on, left: Relation, right: Relation) -> tuple[Column, Column] | None:
        """The two geometries of a condition on one of either side, which holds only where their boxes meet."""
        if isinstance(on, Call) and on.name == "#and":
            return next(filter(None, (self.spatial_ends(a, left, right) for a in on.args)), None)
        if not isinstance(on, Call) or on.name not in BOXED or on.over is not None:
            return None
        sides = []
        for arg in on.args:
            hits = [[Env(self.ctx, r.columns).find(ref) is not None for r in (left, right)] for ref in refs(arg)]
            sides.append(0 if hits and all(h == [True, False] for h in hits) else 1 if hits and all(h == [False, True] for h in hits) else None)
        if sorted(map(str, sides)) != ["0", "1"]:
            return None
        both = Env(self.ctx, left.columns + right.columns)
        return tuple(S._geo(both.eval(on.args[sides.index(k)])).col for k in (0, 1))

    def expand(self, q: Select, rel: Relation) -> list[Item]:
        out, seen = [], set()
        for i in q.items:
            if isinstance(i.expr, Star):
                some = [c for c in rel.columns if i.expr.table in (None, c.table) and not (i.expr.table is None and c.name.startswith(":")) and c.name not in i.expr.without]
                out += [Item(Ref(c.name, c.table), c.name) for c in some]
            else:
                out.append(Item(i.expr, i.alias or name_of(i.expr)))
        unique = []
        for i in out:
            name, n = i.alias, 1
            while name in seen:
                name, n = f"{i.alias}_{n}", n + 1
            seen.add(name)
            unique.append(Item(i.expr, name))
        return unique

    def grouped(self, q: Select, df: DataFrame, env: Env, items: list[Item]) -> tuple[DataFrame, Env]:
        wanted = list(q.group or ())
        wanted = [env.aliases.get(e.name, e) if isinstance(e, Ref) and e.table is None and env.find(e) is None else e for e in wanted]
        wanted = [items[int(e.value) - 1].expr if isinstance(e, Lit) and not isinstance(e.value, (str, bool, type(None))) and 0 < e.value <= len(items) else e for e in wanted]
        keys = [e for e in wanted if not is_constant(e)]
        plain = Env(self.ctx, env.columns, env.aliases, env.outer)
        vals = [(e, f"k{next(_ids)}", plain.eval(e)) for e in keys or wanted]
        env.keys = {e: Val(F.col(n), v.type, integer=v.integer) for e, n, v in vals}
        for e, n, v in vals:
            if isinstance(e, Ref):  # a key may be named with or without its table
                env.keys |= {Ref(c.name, t): Val(F.col(n), v.type, integer=v.integer) for c in env.columns if c.name == e.name and e.table in (None, c.table) for t in (None, c.table)}
        for i in items:
            env.eval(i.expr)
        for s in q.order:
            env.eval(s.expr)
        if q.having is not None:
            env.eval(q.having)
        made = [v.col.alias(n) for n, v in env.aggregates.values()]
        by = [v.col.alias(n) for _, n, v in vals]
        if not made:
            df = df.select(*by).distinct()
        elif by:
            df = df.groupBy(*by).agg(*made)
        else:
            df = df.select(*made)
        if q.having is not None:
            df = df.filter(need(env.eval(q.having), "boolean").col)
        return df, env

    def finish(self, q: Select, items: list[Item], df: DataFrame, env: Env) -> Relation:
        vals = [env.eval(i.expr) for i in items]
        columns = [Output(None, i.alias, f"c{next(_ids)}", v.type, v.integer) for i, v in zip(items, vals, strict=True)]
        out = [v.col.alias(c.physical) for v, c in zip(vals, columns, strict=True)]
        sorts = []
        for s in q.order:
            if not is_constant(s.expr):
                place = next((c for i, c in zip(items, columns, strict=True) if s.expr == i.expr or isinstance(s.expr, Ref) and s.expr.table is None and s.expr.name == i.alias), None)
                if place is None:
                    sorts.append((env.eval(s.expr).col, f"s{next(_ids)}", s))
                else:
                    sorts.append((None, place.physical, s))
        hidden = [c.alias(n) for c, n, _ in sorts if c is not None]
        if q.distinct_on:
            on = [f"d{next(_ids)}" for _ in q.distinct_on]
            hidden += [env.eval(e).col.alias(n) for e, n in zip(q.distinct_on, on, strict=True)]
        df = df.select(*out, *hidden)
        order = [sort_column(_Columns(n), s) for _, n, s in sorts]
        if q.distinct_on:
            rank = f"r{next(_ids)}"
            df = df.withColumn(rank, F.row_number().over(Window.partitionBy(*on).orderBy(*(order or [F.lit(1)])))).filter(F.col(rank) == 1)
        if q.distinct:
            df = df.select(*(c.physical for c in columns), *(n for c, n, _ in sorts if c is not None)).distinct()
        if q.search is not None and q.search_output:
            df = df.filter(searchable([(Val(F.col(c.physical), c.type), c.name) for c in columns], q.search))
        if order:
            df = df.orderBy(*order)
        if q.offset is not None:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Relation(df.select(*(c.physical for c in columns)), columns)


class _Columns:
    """Evaluates any sort expression to one column that exists already."""

    def __init__(self, name: str):
        self.name = name

    def eval(self, e) -> Val:
        return Val(F.col(self.name), "text")


def uncounted(q):
    """A query without what does not change its number of rows."""
    match q:
        case Pipe(left, right):
            return Pipe(left, uncounted(right))
        case With(of, body):
            return With(of, uncounted(body))
        case Select():
            return replace(q, order=(), limit=None, offset=None)
    return q


def most_rows(q, given: int | None = None) -> int | None:
    """How many rows a query gives at most, as far as its limits and set operations show; ``given`` for its input."""
    least = lambda *n: min((x for x in n if x is not None), default=None)
    match q:
        case Pipe(left, right):
            return most_rows(right, most_rows(left, given))
        case With(_, body):
            return most_rows(body, given)
        case Values(rows):
            return len(rows)
        case SetOp(kind, left, right):
            a, b = most_rows(left, given), most_rows(right, given)
            if kind.startswith("union"):
                return None if a is None or b is None else a + b
            return least(a, b) if kind.startswith("intersect") else a
        case Select():
            source = q.source
            rows = given if source is None else 1 if source.of == "single_row" else given if source.of == "this" else None if isinstance(source.of, str) else most_rows(source.of, given)
            if q.joins:
                rows = None
            if q.group is None and any(has_aggregate(i.expr) for i in q.items):
                rows = 1
            if rows is not None and q.offset:
                rows = max(0, rows - q.offset)
            return least(rows, q.limit)
    return None


def reads_clock(e) -> bool:
    """Whether a syntax tree reads the time of the query."""
    if isinstance(e, Call) and e.name == "get_utc_date":
        return True
    if isinstance(e, tuple):
        return any(map(reads_clock, e))
    return hasattr(e, "__dataclass_fields__") and any(reads_clock(getattr(e, f)) for f in e.__dataclass_fields__)


HELD = 16  # persisted results of hints that an engine keeps


class Engine:
    """Runs query texts over named tables."""

    def __init__(self, spark: SparkSession, tables: Callable[[str], DataFrame] | dict[str, DataFrame], **options):
        get = tables.__getitem__ if isinstance(tables, dict) else tables

        def table(name: str) -> DataFrame:
            try:
                return get(name)
            except KeyError:
                raise QueryError(f"no such table: {name}") from None

        self.spark, self.tables, self.options = spark, table, options
        self.held: list[DataFrame] = []

    def plan(self, text: str, primary: str | None = None, **options) -> Relation:
        ctx = Context(self.spark, self.tables, primary, held=self.held, **(self.options | options))
        while len(self.held) > HELD:  # what goes is computed anew if it is read again
            self.held.pop(0).unpersist()
        return Planner(ctx).query(parse(text))

    def release(self) -> None:
        """Let go of what materialised hints persisted."""
        while self.held:
            self.held.pop().unpersist()

    def query(self, text: str, primary: str | None = None, **options) -> DataFrame:
        return self.plan(text, primary, **options).result()

    def row_count(self, text: str, primary: str | None = None, **options) -> int:
        """Rows of a query without its order, limit and offset."""
        ctx = Context(self.spark, self.tables, primary, **(self.options | options))
        return Planner(ctx).query(uncounted(parse(text))).df.count()

    def most_rows(self, text: str) -> int | None:
        """How many rows a query gives at most, as far as its text shows."""
        return most_rows(parse(text))

    def fingerprint(self, text: str, primary: str | None = None, versions: dict[str, int] | None = None, **options) -> str:
        """A hash that is equal for queries with equal results: of the syntax tree, output columns, options and data versions.

        The clock counts only for queries that read it.
        """
        tree = parse(text)
        rel = self.plan(text, primary, **options)
        given = {k: v for k, v in (self.options | options).items() if k != "now" or reads_clock(tree)}
        if reads_clock(tree) and "now" not in given:
            given["now"] = Context(self.spark, self.tables).now
        parts = (repr(tree), [(c.name, c.type) for c in rel.columns], primary, sorted(given.items(), key=lambda kv: kv[0]), sorted((versions or {}).items()))
        return hashlib.sha256(repr(parts).encode()).hexdigest()

    def collect(self, text: str, primary: str | None = None, seconds: float | None = None, **options) -> list:
        """The rows of a query; its jobs are cancelled and TimeoutError raised after ``seconds``."""
        with self.limited(seconds):
            return self.query(text, primary, **options).collect()

    @contextlib.contextmanager
    def limited(self, seconds: float | None):
        """Jobs begun inside are cancelled, and TimeoutError is raised, after ``seconds``; None sets no limit."""
        if seconds is None:
            yield
            return
        tag, late = f"q-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            self.spark.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(seconds, stop)
        self.spark.sparkContext.addJobTag(tag)
        timer.start()
        try:
            yield
        except Exception as x:
            if late.is_set():
                raise TimeoutError(f"the query took more than {seconds} s") from x
            raise
        finally:
            timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)

    def of_tree(self, tree, primary: str | None = None, **options) -> DataFrame:
        """The result of a syntax tree."""
        return Planner(Context(self.spark, self.tables, primary, held=self.held, **(self.options | options))).query(tree).result()

    def explain(self, text: str, primary: str | None = None, mode: str = "formatted") -> str:
        plan = self.query(text, primary)._jdf.queryExecution()
        return plan.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def schema_kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: type_of(f) for f in df.schema if isinstance(f, T.StructField)}
