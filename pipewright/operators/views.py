"""Materialised views over catalog datasets: building, refreshing with their inputs, and substitution.

A view is a query text. It is rebuilt when a dataset that it reads changes. A query whose tree, or that of the left
side of a pipe, equals a fresh view's is answered from the view; of several, the one with the fewest bytes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from ..plans.ast import Call, Item, Pipe, Ref, Select, SetOp, Source, Star, With
from ..plans.lexer import QueryError
from ..plans.parser import parse
from ..plans.planner import Context, Planner, has_aggregate, reads_clock
from ..sources.catalog import Catalog


def tables_of(q, primary: str | None) -> set[str]:
    """Names of the datasets that a query reads."""
    match q:
        case Pipe(left, right):
            return tables_of(left, primary) | (tables_of(right, None))
        case SetOp(_, left, right):
            return tables_of(left, primary) | tables_of(right, primary)
        case With(of, body):
            out, known = set(), set()
            for name, part in of:
                out |= tables_of(part, primary) - known
                known.add(name)
            return out | tables_of(body, primary) - known
        case Select():
            sources = [q.source, *(j.source for j in q.joins)]
            out = {primary} if q.source is None and primary else set()
            for s in filter(None, sources):
                out |= {s.of} - {"this", "single_row"} if isinstance(s.of, str) else tables_of(s.of, primary)
            return out
    return set()


def with_system(q, columns: list[str]):
    """A view over one dataset with its system columns kept beside the selected ones; where rows are grouped, the greatest of each."""
    if not isinstance(q, Select) or q.source is not None or q.joins or q.distinct or q.distinct_on:
        return q
    grouped = q.group is not None or any(has_aggregate(i.expr) for i in q.items)
    named = {i.alias for i in q.items} | {i.expr.name for i in q.items if isinstance(i.expr, Ref)}
    more = [Item(Call("max", (Ref(c),)) if grouped else Ref(c), c) for c in columns if c not in named]
    return replace(q, items=(*q.items, *more))


@dataclass
class Views:
    catalog: Catalog

    def create(self, dataset: str, name: str, query: str, force: bool = False) -> None:
        """Record a view; it is built at once if the dataset is published, the view held data before, or it is forced."""
        tree = parse(query)
        if reads_clock(tree):
            raise QueryError("a view must not read the clock")
        meta = self.catalog.meta(dataset)
        self.catalog.apply(dataset, meta["version"] + 1, [("view_created", name, query, sorted(tables_of(tree, dataset)))])
        published = any(c["stage"] == "published" for c in meta["copies"])
        held = meta["views"].get(name, {}).get("path")
        if force or published or held:
            self.refresh(dataset, name)

    def _versions(self, reads: list[str]) -> dict[str, str]:
        return {t: self.catalog.state(t) for t in reads}

    def refresh(self, dataset: str, name: str) -> bool:
        """Build a view if its inputs changed, else leave it where it is. Whether it was built.

        A query that no longer resolves drops the view's data and leaves the reason in ``error``.
        """
        meta = self.catalog.meta(dataset)
        view = meta["views"][name]
        seen = self._versions(view["reads"])
        if view["path"] and view.get("seen") == seen:
            return False
        path, error = f"{self.catalog.root}/{dataset}/view-{name}-{meta['version']}-{uuid.uuid4().hex[:8]}", None
        try:
            tree = with_system(parse(view["query"]), [c for c in self.catalog.schema(dataset) if c.startswith(":")])
            Planner(Context(self.catalog.spark, self.catalog.table, dataset)).query(tree).result().write.parquet(path)
        except (QueryError, AnalysisException, KeyError) as x:
            path, error = None, str(x)
        view |= {"path": path, "seen": seen, "error": error}
        self.catalog._save(dataset, meta)
        return path is not None

    def refresh_for(self, changed: str) -> list[tuple[str, str]]:
        """Rebuild every view, of any dataset, that reads the changed one."""
        out = []
        for dataset in self.catalog.names():
            for name, view in self.catalog.meta(dataset)["views"].items():
                if changed in view["reads"] and self.refresh(dataset, name):
                    out.append((dataset, name))
        return out

    def query(self, text: str, primary: str, view: str | None = None, **options) -> DataFrame:
        """Run a query, from views where they match; or with a named view in place of the dataset."""
        if view is not None:
            return Planner(Context(self.catalog.spark, self.catalog.table, f"{primary}.{view}", **options)).query(parse(text)).result()
        tree = self.substitute(parse(text), primary)
        return Planner(Context(self.catalog.spark, self.catalog.table, primary, **options)).query(tree).result()

    def substitute(self, tree, primary: str):
        fits = []
        for name, view in self.catalog.meta(primary)["views"].items():
            if view["path"] and view.get("seen") == self._versions(view["reads"]) and parse(view["query"]) == tree:
                path, fs = self.catalog._fs(view["path"])
                fits.append((fs.getContentSummary(path).getLength(), name))
        if fits:
            return Select(items=(Item(Star()),), source=Source(f"{primary}.{min(fits)[1]}", "view"))
        if isinstance(tree, Pipe):
            return Pipe(self.substitute(tree.left, primary), tree.right)
        return tree
