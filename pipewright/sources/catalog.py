"""Datasets as numbered copies in Parquet directories, fed by ordered change sets.

Metadata is a numbered JSON document per dataset, written beside its predecessors and moved into place only after
the data it names is written; the highest number counts. So a change set is applied as a whole or not at all, and of two writers
one fails. Row changes are kept as small tables beside a copy's rows and merged when it is read; the copy is
rewritten when many have come together, or when one of them is large.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import type_of
from ..plans.lexer import QueryError

ID = ":id"
DELTAS = 8  # change tables that a read merges; beyond, the copy is rewritten
LARGE = 100_000  # changes of one set from which, if they are over a third of the rows, the copy is rewritten
# Events that change neither rows nor what is kept about a dataset.
IGNORED = {"row_identifier_set", "row_identifier_cleared", "computation_strategy_created", "computation_strategy_removed"}


class VersionGap(ValueError):
    """A change set does not follow the dataset's version: it must be resynced."""


class Catalog:
    def __init__(self, spark: SparkSession, root: str, deltas: int = DELTAS):
        self.spark, self.root, self.deltas = spark, root.rstrip("/"), deltas

    # -- metadata
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, name: str) -> list[int]:
        path, fs = self._fs(f"{self.root}/{name}/meta")
        if not fs.exists(path):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(path))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def meta(self, name: str) -> dict:
        numbers = self._numbers(name)
        if not numbers:
            raise KeyError(name)
        path, fs = self._fs(f"{self.root}/{name}/meta/{numbers[-1]:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _save(self, name: str, meta: dict) -> None:
        """The next metadata document; what no document since the last but one names is deleted."""
        number = meta.get("number", 0) + 1
        known = self._numbers(name)
        if known and known[-1] >= number:
            raise VersionGap(f"{name} was changed by another writer")
        before = self.meta(name) if known else {}
        meta["number"] = number
        old, meta["unused"] = set(before.get("unused", ())), sorted(_paths(before) - _paths(meta))
        fresh, fs = self._fs(f"{self.root}/{name}/meta/{uuid.uuid4().hex}.new")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        path, _ = self._fs(f"{self.root}/{name}/meta/{number:012d}.json")
        if fs.exists(path) or not fs.rename(fresh, path):
            fs.delete(fresh, False)
            raise VersionGap(f"{name} was changed by another writer")
        for p in old - _paths(meta):  # readers of the document before may still use what it named
            gone, fs = self._fs(p)
            fs.delete(gone, True)
        for n in known[:-1]:
            gone, fs = self._fs(f"{self.root}/{name}/meta/{n:012d}.json")
            fs.delete(gone, False)

    def names(self) -> list[str]:
        root, fs = self._fs(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()) if fs.exists(root) else []

    # -- reading
    def copy(self, name: str, which: str | int | None = None) -> dict:
        """The latest, published or unpublished copy, or a numbered one; by default the published, else the latest."""
        copies = [c for c in self.meta(name)["copies"] if c["stage"] != "discarded"]
        by = {"published": [c for c in copies if c["stage"] == "published"], "unpublished": [c for c in copies if c["stage"] == "unpublished"], "latest": copies}
        found = by.get(which, [c for c in copies if c["number"] == which]) if which is not None else by["published"] or copies
        if not found:
            raise KeyError(f"{name} has no copy {which}")
        return found[-1]

    def _frame(self, copy: dict) -> DataFrame:
        """A copy's rows with its change tables merged: of each row id the last change counts."""
        base = self.spark.read.parquet(copy["path"])
        if not copy.get("deltas"):
            return base
        parts = [self.spark.read.parquet(p).withColumn("_seq", F.lit(i)) for i, p in enumerate(copy["deltas"])]
        last = Window.partitionBy(ID).orderBy(F.desc("_seq"), "_deleted")
        changes = reduce(DataFrame.unionByName, parts).withColumn("_n", F.row_number().over(last)).where("_n = 1")
        return base.join(changes.select(ID), ID, "left_anti").select(*base.columns).unionByName(changes.where("not _deleted").select(*base.columns))

    def read(self, name: str, which: str | int | None = None) -> DataFrame:
        return self._frame(self.copy(name, which))

    def state(self, name: str, which: str | int | None = None) -> str:
        """A text that changes whenever a copy's rows do."""
        copy = self.copy(name, which)
        return "+".join([copy["path"], *copy.get("deltas", ())])

    def exists(self, name: str) -> bool:
        return bool(self._numbers(name))

    def schema(self, name: str, which: str | int | None = None) -> dict[str, str]:
        """Column names and the dialect's types of a copy."""
        return {f.name: type_of(f) for f in self.read(name, which).schema}

    def views(self, name: str) -> list[str]:
        """The names of a dataset's materialised views that hold data."""
        return sorted(k for k, v in self.meta(name)["views"].items() if v["path"])

    def version(self, name: str) -> int:
        return self.meta(name)["version"]

    def metric(self, name: str) -> int:
        """Bytes of all of a dataset's files."""
        path, fs = self._fs(f"{self.root}/{name}")
        return fs.getContentSummary(path).getLength()

    def table(self, name: str) -> DataFrame:
        """A dataset by name, or a materialised view as ``dataset.view``."""
        dataset, _, view = name.partition(".")
        if view:
            path = self.meta(dataset)["views"][view]["path"]
            if path is None:
                raise KeyError(name)
            return self.spark.read.parquet(path)
        return self.read(dataset)

    # -- change sets
    def apply(self, name: str, version: int, events: list[tuple], **extra) -> dict:
        """Apply one version's events in order; returns the new metadata, to which ``extra`` is added. The version must follow the last one."""
        try:
            meta = self.meta(name)
        except KeyError:
            meta = {"version": 0, "copies": [], "views": {}}
        if version != meta["version"] + 1:
            raise VersionGap(f"{name} is at version {meta['version']}, not {version - 1}")
        working = self._working(meta)
        frame = self._frame(working) if working and working["path"] else None
        dirty = False  # the frame has to be written as a whole
        for kind, *args in events:
            if kind == "working_copy_created":
                working = {"number": len(meta["copies"]) + 1, "stage": "unpublished", "path": None, "deltas": []}
                meta["copies"].append(working)
                frame, dirty = self.spark.createDataFrame([], args[0] if args else f"`{ID}` long"), True
            elif kind == "data_copied":
                source = [c for c in meta["copies"] if c["stage"] == "published"]
                if not source:
                    raise VersionGap(f"{name} has no published copy")
                frame, dirty = self._frame(source[-1]), True
            elif kind == "working_copy_published":
                for c in meta["copies"]:
                    if c["stage"] == "published":
                        c["stage"] = "snapshotted"
                working["stage"] = "published"
            elif kind in ("working_copy_dropped", "snapshot_dropped"):
                number = args[0] if args else working["number"]
                next(c for c in meta["copies"] if c["number"] == number)["stage"] = "discarded"
                working = self._working(meta)
                frame, dirty = self._frame(working) if working and working["path"] else None, False
            elif kind == "last_modified_changed":
                meta["last_modified"] = args[0]
            elif kind in ("row_identifier_changed", "version_column_changed"):
                meta[kind.removesuffix("_changed")] = args[0]
            elif kind == "view_created":
                kept = meta["views"].get(args[0])
                meta["views"][args[0]] = {"query": args[1], "reads": args[2], "path": kept["path"] if kept and kept["query"] == args[1] else None}
                if kept and kept["query"] == args[1]:
                    meta["views"][args[0]]["seen"] = kept.get("seen")
            elif kind == "view_dropped":
                meta["views"].pop(args[0], None)
            elif kind == "index_created":
                meta.setdefault("indexes", {})[args[0]] = args[1]
            elif kind == "index_dropped":
                meta.get("indexes", {}).pop(args[0], None)
            elif kind == "index_directives_changed":
                meta.setdefault("index_directives", {})[args[0]] = args[1]
            elif kind == "rows_changed_preview":
                truncated, changes = args[0], sum(args[1:])
                dirty = dirty or truncated or changes > LARGE and changes > frame.count() / 3
            elif kind == "reindexed":
                dirty = dirty or frame is not None
            elif kind == "rows_changed" and not dirty and working and working["path"] and len(working["deltas"]) < self.deltas:
                path = f"{self.root}/{name}/changes-{working['number']}-{version}-{uuid.uuid4().hex[:8]}"
                _delta(frame, *args).write.parquet(path)
                working["deltas"].append(path)
                frame = self._frame(working)
            elif kind not in IGNORED:
                frame, dirty = _changed(frame, kind, args), True
        if dirty and working is not None:
            working["path"], working["deltas"] = f"{self.root}/{name}/copy-{working['number']}-{version}-{uuid.uuid4().hex[:8]}", []
            frame.write.parquet(working["path"])
        meta |= {"version": version} | extra
        self._save(name, meta)
        return meta

    @staticmethod
    def _working(meta: dict) -> dict | None:
        live = [c for c in meta["copies"] if c["stage"] in ("unpublished", "published")]
        return live[-1] if live else None

    def resync(self, name: str, version: int, df: DataFrame) -> dict:
        """Replace a dataset's rows by a full load, whatever its version."""
        path = f"{self.root}/{name}/copy-resync-{version}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        try:
            before = self.meta(name)
        except KeyError:
            before = {"views": {}}
        meta = {"number": before.get("number", 0), "version": version, "copies": [{"number": 1, "stage": "published", "path": path, "deltas": []}], "views": before["views"]}
        self._save(name, meta)
        return meta

    def drop(self, name: str) -> None:
        """Delete a dataset, and the views of other datasets that read it."""
        path, fs = self._fs(f"{self.root}/{name}")
        fs.delete(path, True)
        for other in self.names():
            meta = self.meta(other)
            gone = [k for k, v in meta["views"].items() if name in v["reads"]]
            if gone:
                meta["views"] = {k: v for k, v in meta["views"].items() if k not in gone}
                self._save(other, meta)

    def drop_copy(self, name: str, number: int) -> dict:
        """Discard one copy that is not the only one."""
        meta = self.meta(name)
        if sum(c["stage"] != "discarded" for c in meta["copies"]) < 2:
            raise QueryError(f"{number} is the last copy of {name}")
        next(c for c in meta["copies"] if c["number"] == number)["stage"] = "discarded"
        self._save(name, meta)
        return meta


def _paths(meta: dict) -> set[str]:
    """What a metadata document names."""
    live = [c for c in meta.get("copies", ()) if c["stage"] != "discarded" and c["path"]]
    return {p for c in live for p in (c["path"], *c.get("deltas", ()))} | {v["path"] for v in meta.get("views", {}).values() if v["path"]}


def _filled(frame: DataFrame, upserts: DataFrame) -> DataFrame:
    """Upserts with all columns; those that they lack keep the values that the rows have."""
    missing = [c for c in frame.columns if c not in upserts.columns]
    if missing:
        upserts = upserts.join(frame.select(ID, *(F.col(f"`{c}`") for c in missing)), ID, "left")
    return upserts.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) for f in frame.schema))


def _delta(frame: DataFrame, upserts: DataFrame | None, deletes: DataFrame | None) -> DataFrame:
    """One table of changes: whole rows, and row ids alone for deletions."""
    gone = [deletes.select(F.col(ID).cast(frame.schema[ID].dataType).alias(ID), *(F.lit(None).cast(f.dataType).alias(f.name) for f in frame.schema if f.name != ID)).select(*frame.columns).withColumn("_deleted", F.lit(True))] if deletes is not None else []
    fresh = [_filled(frame, upserts).withColumn("_deleted", F.lit(False))] if upserts is not None else []
    return reduce(DataFrame.unionByName, fresh + gone) if fresh or gone else frame.limit(0).withColumn("_deleted", F.lit(False))


def _changed(frame: DataFrame, kind: str, args: list) -> DataFrame:
    if frame is None:
        raise QueryError(f"{kind} without a working copy")
    if kind == "truncated":
        return frame.limit(0)
    if kind == "column_created":
        name, of, *kind = args  # a Spark type, and the dialect's where that does not follow from it
        return frame.withColumn(name, F.lit(None).cast(of).alias(name, metadata={"kind": kind[0]} if kind else {}))
    if kind == "column_removed":
        return frame.drop(args[0])
    if kind == "column_renamed":
        return frame.withColumnRenamed(*args)
    if kind == "rows_changed":
        upserts, deletes = args
        gone = [x.select(ID) for x in (upserts, deletes) if x is not None]
        kept = frame.join(reduce(DataFrame.union, gone).distinct(), ID, "left_anti").select(*frame.columns) if gone else frame
        return kept.unionByName(_filled(frame, upserts)) if upserts is not None else kept
    raise QueryError(f"unknown change {kind}")
