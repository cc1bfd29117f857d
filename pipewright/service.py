"""Requests as data: queries over a catalog's datasets with headers, conditional answers, a result cache and limits.

No transport comes with it; an HTTP front end would hand its parameters to ``Service`` and stream the body that it gets.
"""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

from .operators.views import Views, tables_of
from .plans.lexer import QueryError
from .plans.parser import parse
from .plans.planner import Engine
from .sources.catalog import Catalog
from .sources.results import cjson, schema_document

CONCURRENT = 15  # queries of one dataset at a time
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 1 << 20  # of all cached results, and of one


@dataclass
class Request:
    dataset: str
    query: str
    context: dict[str, str] = field(default_factory=dict)
    copy: str | int | None = None
    view: str | None = None  # answers in the dataset's place
    allow_views: bool = True
    row_count: bool = False
    obfuscation_key: bytes | None = None
    seconds: float | None = None
    if_none_match: str | None = None
    case_sensitive: bool = True


@dataclass
class Response:
    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: Iterator[str] = iter(())


class Service:
    def __init__(self, catalog: Catalog, concurrent: int = CONCURRENT, cache_bytes: int = CACHE_BYTES, entry_bytes: int = ENTRY_BYTES):
        self.catalog, self.views = catalog, Views(catalog)
        self.concurrent, self.cache_bytes, self.entry_bytes = concurrent, cache_bytes, entry_bytes
        self.running: dict[str, int] = {}
        self.cache: OrderedDict[str, list[str]] = OrderedDict()
        self.lock = threading.Lock()

    # -- limits and cache
    def _enter(self, dataset: str) -> bool:
        with self.lock:
            if self.running.get(dataset, 0) >= self.concurrent:
                return False
            self.running[dataset] = self.running.get(dataset, 0) + 1
            return True

    def _leave(self, dataset: str) -> None:
        with self.lock:
            self.running[dataset] -= 1

    def _cached(self, tag: str) -> list[str] | None:
        with self.lock:
            if tag in self.cache:
                self.cache.move_to_end(tag)
            return self.cache.get(tag)

    def _remember(self, tag: str, lines: list[str]) -> None:
        size = lambda own: sum(map(len, own))
        with self.lock:
            self.cache[tag] = lines
            while sum(map(size, self.cache.values())) > self.cache_bytes:
                self.cache.popitem(last=False)

    # -- requests
    def _engine(self, r: Request) -> Engine:
        def table(name: str):
            if name == r.dataset:
                return self.catalog.table(f"{name}.{r.view}") if r.view else self.catalog.read(name, r.copy)
            return self.catalog.table(name)

        return Engine(self.catalog.spark, table, variables=r.context, obfuscation_key=r.obfuscation_key, case_sensitive=r.case_sensitive)

    def query(self, r: Request) -> Response:
        """200 with lines of compact JSON, 304, 400 for a bad query, 404, 408 for one that took too long, or 429."""
        if not self.catalog.exists(r.dataset):
            return Response(404, body=iter([f"no such dataset: {r.dataset}"]))
        if not self._enter(r.dataset):
            return Response(429)
        left = False
        try:
            engine, tree = self._engine(r), parse(r.query)
            states = {t: self.catalog.state(t, r.copy if t == r.dataset else None) for t in sorted(tables_of(tree, r.dataset)) if "." not in t}
            tag = engine.fingerprint(r.query, r.dataset, states | {"": f"{r.view} {r.row_count}"})
            version = self.catalog.version(r.dataset)
            headers = {"ETag": tag, "Data-Version": str(version)}
            if r.if_none_match == tag:
                return Response(304, headers)
            if (lines := self._cached(tag)) is not None:
                return Response(200, headers | {"Cached": "true"}, iter(lines))
            plan = self.views.substitute(tree, r.dataset) if r.allow_views and r.view is None and r.copy is None else tree
            df = engine.of_tree(plan, r.dataset)
            if plan != tree:
                headers["View"] = "true"
            with engine.limited(r.seconds):
                n = engine.row_count(r.query, r.dataset) if r.row_count else None
            left = True
            return Response(200, headers, self._lines(r, tag, engine, cjson(df, data_version=version, last_modified=self.catalog.meta(r.dataset).get("last_modified"), row_count=n)))
        except (QueryError, KeyError) as x:
            return Response(400, body=iter([str(x)]))
        except TimeoutError as x:
            return Response(408, body=iter([str(x)]))
        finally:
            if not left:
                self._leave(r.dataset)

    def _lines(self, r: Request, tag: str, engine: Engine, lines: Iterator[str]) -> Iterator[str]:
        held, size = [], 0
        try:
            with engine.limited(r.seconds):
                for line in lines:
                    size += len(line)
                    if size <= self.entry_bytes:
                        held.append(line)
                    yield line
            if size <= self.entry_bytes:
                self._remember(tag, held)
        finally:
            engine.release()
            self._leave(r.dataset)

    def info(self, r: Request) -> dict:
        """A query's columns and plan, without running it."""
        engine = self._engine(r)
        return {"columns": schema_document(engine.query(r.query, r.dataset)), "plan": engine.explain(r.query, r.dataset)}

    def schema(self, dataset: str, copy: str | int | None = None, names: bool = True) -> list[dict]:
        return schema_document(self.catalog.read(dataset, copy), names)

    def exists(self, dataset: str) -> bool:
        return self.catalog.exists(dataset)

    def rollups(self, dataset: str) -> list[str]:
        return self.catalog.views(dataset)

    def version(self, dataset: str) -> int:
        return self.catalog.version(dataset)
