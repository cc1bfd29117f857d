"""Registered queries that go through the catalog, views, streams, sources and sinks, with DuckDB equivalents of what they must give."""

from __future__ import annotations

import gzip
import io
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..http import application
from ..operators.views import Views
from ..service import Request, Service
from ..session import configure
from ..sources.catalog import ID, Catalog, VersionGap
from ..sources.delimited import read_csv, replay_script, write_csv
from ..sources.results import cjson, gzipped_cjson, schema_document
from ..streaming.changes import replay
from .lexer import QueryError
from .planner import Engine

SCHEMA = f"`{ID}` bigint, name string, region int"


def shared_root(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which driver and executors share; a temporary one where local sessions name none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pipewright-")
    return f"{found.rstrip('/')}/store-{uuid.uuid4().hex}"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias(ID), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))


def _catalog(spark: SparkSession, sf_dir: str, **options) -> Catalog:
    """A catalog with the published dataset ``nations`` at version 1."""
    catalog = Catalog(configure(spark), shared_root(spark), **options)
    catalog.apply("nations", 1, [("working_copy_created", SCHEMA), ("rows_changed", _nations(spark, sf_dir), None), ("working_copy_published",)])
    return catalog


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed(ID, "id")


def _lines(spark: SparkSession, lines) -> DataFrame:
    return spark.createDataFrame([(line,) for line in lines], "line string")


def copy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _catalog(spark, sf_dir)
    return Engine(spark, catalog.table).query("select :id as id, name, region where region < 3", "nations")


def copy_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A working copy with changed columns beside the published one, each by its stage and number."""
    catalog = _catalog(spark, sf_dir)
    catalog.apply("nations", 2, [("working_copy_created", SCHEMA), ("data_copied",), ("column_renamed", "name", "title"), ("column_created", "note", "string"), ("column_removed", "region")])
    seen = [("published", "name"), ("unpublished", "title"), ("latest", "title"), (1, "name"), (None, "name")]
    made = [catalog.read("nations", which).select(F.lit(str(which)).alias("which"), F.col(ID).alias("id"), F.col(c).alias("name")) for which, c in seen]
    out = made[0]
    for m in made[1:]:
        out = out.union(m)
    return out.withColumn("columns", F.lit(",".join(catalog.schema("nations", "unpublished"))))


def copy_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishing turns the copies round; a dropped working copy leaves the published one."""
    catalog = _catalog(spark, sf_dir)
    catalog.apply("nations", 2, [("working_copy_created", SCHEMA), ("data_copied",), ("rows_changed", None, _nations(spark, sf_dir).where("region = 1"))])
    catalog.apply("nations", 3, [("working_copy_published",)])
    catalog.apply("nations", 4, [("working_copy_created", SCHEMA)])
    catalog.apply("nations", 5, [("working_copy_dropped",)])
    catalog.apply("nations", 6, [("snapshot_dropped", 1)])
    stages = ",".join(c["stage"] for c in catalog.meta("nations")["copies"])
    return _plain(catalog.read("nations")).withColumn("stages", F.lit(stages))


def rows_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts, upserts that lack a column, deletions and a row that comes back, over several change sets."""
    catalog, rows = _catalog(spark, sf_dir), _nations(spark, sf_dir)
    catalog.apply("nations", 2, [("rows_changed", rows.where("`:id` < 3").withColumn("name", F.concat(F.lit("NEW_"), F.col(ID))), rows.where("`:id` in (5, 6, 20)").select(ID))])
    catalog.apply("nations", 3, [("rows_changed", rows.where("`:id` = 7").select(ID, F.lit("PART").alias("name")), None), ("rows_changed", rows.where("`:id` = 1").withColumn("region", F.lit(99)), rows.where("`:id` = 8").select(ID))])
    catalog.apply("nations", 4, [("rows_changed", rows.where("`:id` = 20"), None)])
    return _plain(catalog.read("nations"))


def rows_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows before and after the change tables are merged for good."""
    catalog, rows = _catalog(spark, sf_dir, deltas=2), _nations(spark, sf_dir)
    for i in range(5):
        catalog.apply("nations", 2 + i, [("rows_changed", rows.where(f"`:id` = {i}").withColumn("region", F.lit(100 + i)), rows.where(f"`:id` = {10 + i}").select(ID))])
    catalog.apply("nations", 7, [("reindexed",)])
    return _plain(catalog.read("nations")).withColumn("deltas", F.lit(len(catalog.copy("nations")["deltas"])))


def rows_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, rows = _catalog(spark, sf_dir), _nations(spark, sf_dir)
    catalog.apply("nations", 2, [("rows_changed_preview", True, 5, 0, 0), ("truncated",), ("rows_changed", rows.where("region = 2"), None)])
    return _plain(catalog.read("nations"))


def resynced(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _catalog(spark, sf_dir)
    catalog.resync("nations", 40, _nations(spark, sf_dir).where("`:id` % 2 = 0"))
    catalog.apply("nations", 41, [("last_modified_changed", "2024-01-01")])
    return _plain(catalog.read("nations")).withColumn("version", F.lit(catalog.version("nations")))


def catalog_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What metadata events leave behind, gaps refused, and lookups."""
    catalog = _catalog(spark, sf_dir)
    events = [("index_created", "by_name", "name"), ("index_created", "gone", "region"), ("index_dropped", "gone"), ("index_directives_changed", "name", "search"), ("row_identifier_set", "name"), ("computation_strategy_created", "x")]
    meta = catalog.apply("nations", 2, [*events, ("last_modified_changed", "2024-02-29"), ("row_identifier_changed", ":id"), ("version_column_changed", ":version"), ("rows_changed_preview", False, 1, 1, 1)])
    try:
        catalog.apply("nations", 9, [])
        gap = False
    except VersionGap:
        gap = True
    catalog.resync("other", 1, _nations(spark, sf_dir))
    Views(catalog).create("nations", "of_other", "select count(*) as n from @other")
    catalog.drop("other")
    catalog.apply("nations", 4, [("working_copy_created", SCHEMA)])
    catalog.drop_copy("nations", 2)
    try:
        catalog.drop_copy("nations", 1)
        last = "dropped"
    except QueryError:
        last = "kept"
    facts = {"indexes": ",".join(meta["indexes"]), "directives": str(meta["index_directives"]["name"]), "modified": meta["last_modified"], "id": meta["row_identifier"], "version": str(catalog.version("nations")), "copy": str(catalog.copy("nations")["number"]), "gap": str(gap), "views": str(catalog.meta("nations")["views"]), "last copy": last, "exists": f"{catalog.exists('nations')},{catalog.exists('other')}", "bytes": str(catalog.metric("nations") > 0)}
    return spark.createDataFrame(sorted(facts.items()), "fact string, value string")


_TOTALS = "select region, count(*) as n, min(name) as first group by region"


def view_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A materialised view by its name, kept while nothing changes and rebuilt when its dataset does."""
    catalog, rows = _catalog(spark, sf_dir), _nations(spark, sf_dir)
    views = Views(catalog)
    views.create("nations", "totals", _TOTALS)
    kept = not views.refresh("nations", "totals")
    catalog.apply("nations", 3, [("rows_changed", None, rows.where("`:id` < 7").select(ID))])
    built = views.refresh_for("nations")
    return Engine(spark, catalog.table).query("select region, n, first, :id as top from @nations.totals").withColumn("state", F.lit(f"{kept},{len(built)},{','.join(catalog.views('nations'))}"))


def view_substituted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query whose left side is a view's is answered from the view: the view's files hold a mark that the dataset has not."""
    catalog = _catalog(spark, sf_dir)
    views = Views(catalog)
    views.create("nations", "totals", _TOTALS)
    meta = catalog.meta("nations")
    path = meta["views"]["totals"]["path"] + "-marked"
    catalog.table("nations.totals").withColumn("first", F.concat(F.lit("view "), "first")).write.parquet(path)
    meta["views"]["totals"]["path"] = path
    catalog._save("nations", meta)
    whole = views.query(_TOTALS, "nations").columns
    if whole != ["region", "n", "first"]:
        raise ValueError(f"system columns in the result: {whole}")
    used = views.query(_TOTALS + " |> select region, first where n > 2", "nations")
    other = views.query("select region, max(name) as first group by region", "nations")
    named = views.query("select region, first where region = 4", "nations", view="totals")
    return used.union(other).union(named)


def view_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view of one dataset that reads another is rebuilt when that changes, and dropped when it no longer resolves."""
    catalog, rows = _catalog(spark, sf_dir), _nations(spark, sf_dir)
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias(ID), F.col("r_regionkey").alias("key"), F.col("r_name").alias("title"))
    catalog.resync("regions", 1, regions)
    views = Views(catalog)
    views.create("regions", "sizes", "select title, count(*) as n join @nations as n on key = @n.region group by title")
    views.create("regions", "later", "select title, @n.name as name join @nations as n on key = @n.region")
    catalog.apply("nations", 2, [("rows_changed", None, rows.where("region = 0 and `:id` > 5").select(ID))])
    built = views.refresh_for("nations")
    catalog.apply("nations", 3, [("column_renamed", "name", "label")])
    views.refresh_for("nations")
    return catalog.table("regions.sizes").withColumn("state", F.lit(f"{len(built)},{','.join(catalog.views('regions'))}"))


def view_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of unpublished datasets wait unless forced; the clock is forbidden."""
    catalog = Catalog(configure(spark), shared_root(spark))
    catalog.apply("nations", 1, [("working_copy_created", SCHEMA), ("rows_changed", _nations(spark, sf_dir), None)])
    views = Views(catalog)
    views.create("nations", "waits", _TOTALS)
    views.create("nations", "forced", _TOTALS, force=True)
    try:
        views.create("nations", "clock", "select get_utc_date() as t")
        clock = "allowed"
    except QueryError:
        clock = "forbidden"
    before = ",".join(catalog.views("nations"))
    catalog.apply("nations", catalog.version("nations") + 1, [("working_copy_published",)])
    views.refresh_for("nations")
    after = ",".join(catalog.views("nations"))
    catalog.apply("nations", catalog.version("nations") + 1, [("view_dropped", "forced")])
    return spark.createDataFrame([("before", before), ("after", after), ("clock", clock), ("dropped", ",".join(catalog.views("nations")))], "fact string, value string")


def streamed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change files replayed into a dataset, one version a micro-batch, and not twice after a restart."""
    catalog, rows = _catalog(spark, sf_dir), _nations(spark, sf_dir)
    root = shared_root(spark)
    change = lambda df, deleted, seq: df.withColumn("deleted", F.lit(deleted)).withColumn("seq", F.lit(seq).cast("long"))
    parts = [change(rows.where("`:id` < 4").withColumn("name", F.lit("first")), False, 1), change(rows.where("`:id` < 2").withColumn("name", F.lit("second")), False, 2), change(rows.where("`:id` > 20"), True, 1)]
    parts[0].union(parts[1]).union(parts[2]).coalesce(1).write.parquet(f"{root}/changes")
    stream = lambda: spark.readStream.schema(parts[0].schema).parquet(f"{root}/changes")
    for _ in range(2):
        replay(stream(), catalog, "nations", f"{root}/checkpoint").awaitTermination()
    return _plain(catalog.read("nations")).withColumn("version", F.lit(catalog.version("nations")))


def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows written as delimited text and read back with their types."""
    path = f"{shared_root(spark)}/csv"
    engine = Engine(configure(spark), lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    rows = engine.query("select o_orderkey, o_orderstatus = 'F' as done, o_totalprice, o_orderdate, (o_orderdate::text || 'Z')::fixed_timestamp as f, o_orderdate.date as d, point(1, o_custkey) as p, 'a \"quoted\", text' as t", "orders")
    write_csv(rows, path)
    kinds = {"o_orderkey": "number", "done": "boolean", "o_totalprice": "double", "o_orderdate": "floating_timestamp", "f": "fixed_timestamp", "d": "date", "p": "point", "t": "text"}
    given = read_csv(spark, path, kinds | {"p": "text"})  # the sink writes geometries in base 64
    given = given.withColumn("p", F.unbase64("p"))
    return Engine(spark, {"t": given}).query("select o_orderkey::double as k, done, o_totalprice, o_orderdate, f::text as f, d::text as d, t", "t")


def csv_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms in which a database prints values: short offsets, t and f, hexadecimal geometries, quotes."""
    path = f"{shared_root(spark)}/plain"
    lines = ["n,f,g,b,p,j,t", '12.50,2024-01-02 03:04:05.678+00,2024-01-02 03:04:05,t,0101000000000000000000F03F0000000000000040,"{""k"": [1, 2]}","say ""x"", y"', "-3,2024-01-02 03:04:05-05,1999-12-31 23:59:59.999,f,,,", ",,,,,,"]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    rows = read_csv(spark, path, {"n": "number", "f": "fixed_timestamp", "g": "floating_timestamp", "b": "boolean", "p": "point", "j": "json", "t": "text"})
    return Engine(configure(spark), {"t": rows}).query("select n::double as n, f::text as f, g::text as g, b, p::text as p, j.k::text as j, t", "t")


def script_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mutation script: columns, rows of several types, a later deletion."""
    catalog = Catalog(configure(spark), shared_root(spark))
    replay_script(catalog, "wings", '[{ c: "create", user: "test" }, { c: "add column", id: "code", type: "text", field_name: "code" }, { c: "add column", id: "price", type: "number" }, { c: "add column", id: "at", type: "floating_timestamp" }, { c: "add column", id: "spot", type: "point" }, { c: "row data" }, {"code": "a", "price": 2.5, "at": "2008-08-01T15:12:34.000", "spot": "POINT (1 2)"}, {"code": "00", "price": -1}, {"code": "c"}, { c: "publish" }]')
    replay_script(catalog, "wings", '[{"c": "row data"}, {"code": "d", "price": 7}, [2]]')
    return Engine(spark, catalog.table).query("select :id as id, code, price::double as price, at::text as at, spot::text as spot", "wings")


def result_cjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _catalog(spark, sf_dir)
    lines = cjson(Engine(spark, catalog.table).query("select name, region, region > 2 as big, '2024-01-01T00:00:00'::floating_timestamp as t order by name", "nations"), data_version=3, last_modified="2024-01-01", row_count=25)
    return _lines(spark, lines)


def result_gzipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _catalog(spark, sf_dir)
    data = b"".join(gzipped_cjson(Engine(spark, catalog.table).query("select name order by name limit 3", "nations")))
    return _lines(spark, gzip.decompress(data).decode().splitlines()[1:])


def result_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Engine(configure(spark), lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")).query("select n_name, n_nationkey, n_nationkey / 2.0::double as d, n_nationkey > 1 as b, point(1, 2) as p, '2024-01-01'::date as t, 'P1D'::interval as i", "nation")
    return spark.createDataFrame([(i, e["name"], e["type"]) for i, e in enumerate(schema_document(rows))], "place int, name string, kind string")


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(configure(spark), lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    texts = {"limited": "select o_orderkey order by o_totalprice limit 3", "grouped": "select o_custkey, count(*) group by o_custkey limit 1", "union": "select o_custkey as k union select c_custkey as k from @customer", "piped": "select o_custkey limit 7 |> select o_custkey limit 2"}
    return spark.createDataFrame([(k, engine.row_count(t, "orders")) for k, t in texts.items()], "name string, n long")


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that analysis refuses."""
    engine = Engine(configure(spark), lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    out = []
    for text in ("select nothing", "select coalesce(n_name, n_nationkey)", "select n_name group by n_regionkey", "select n_name union select r_name, r_regionkey from @region", "select n_name union select r_regionkey from @region", "select nofunction(n_name)", "select n_name where n_name", "select n_name"):
        try:
            engine.query(text, "nation")
            out.append((text, "accepted"))
        except QueryError:
            out.append((text, "refused"))
    return spark.createDataFrame(out, "text string, fate string")


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Engine(configure(spark), lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")).explain("select n_name where n_regionkey = 3", "nation")
    return spark.createDataFrame([("scan", "Scan parquet" in plan), ("pushed", "EqualTo(n_regionkey,3)" in plan), ("columns", "ReadSchema: struct<n_name:string,n_regionkey:int>" in plan)], "part string, there boolean")


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests: rows, conditional answers, cached ones, bad ones, too many, too long."""
    catalog = _catalog(spark, sf_dir)
    service = Service(catalog, concurrent=1)
    ask = lambda text, **more: service.query(Request("nations", text, **more))
    out = []
    note = lambda name, *facts: out.append((name, ",".join(map(str, facts))))
    first = ask("select name where region = get_context('r')::number order by name", context={"r": "2"}, row_count=True)
    waiting = ask("select name")
    rows = list(first.body)
    note("first", first.status, len(rows) - 2, '"approximate_row_count": 5' in rows[0])
    note("too many", waiting.status)
    again = ask("select  name where region = get_context('r')::number ORDER BY name", context={"r": "2"}, row_count=True)
    note("cached", again.status, again.headers.get("Cached"), list(again.body) == rows)
    note("unchanged", ask("select name where region = get_context('r')::number order by name", context={"r": "2"}, row_count=True, if_none_match=first.headers["ETag"]).status)
    note("other context", ask("select name where region = get_context('r')::number order by name", context={"r": "3"}, row_count=True, if_none_match=first.headers["ETag"]).status)
    service.running.clear()
    note("bad", ask("select nothing").status)
    note("missing", service.query(Request("other", "select 1")).status)
    Views(catalog).create("nations", "totals", _TOTALS)
    viewed = ask(_TOTALS)
    note("view", viewed.headers.get("View"), len(list(viewed.body)) - 2)
    named = ask("select n order by n", view="totals")
    note("named view", len(list(named.body)) - 2)
    note("numbered copy", len(list(ask("select name", copy=1).body)) - 2)
    note("lookups", service.exists("nations"), service.version("nations"), service.rollups("nations"), len(service.schema("nations")), service.info(Request("nations", "select name"))["columns"])
    return spark.createDataFrame(out, "name string, facts string")


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most rows that a query's text shows."""
    engine = Engine(configure(spark), {})
    texts = ("select a", "select a limit 5", "select a limit 5 |> select b limit 9", "select a limit 9 offset 2 |> select b offset 4", "select a limit 5 union all select b limit 3", "select a limit 5 union select b", "select a limit 5 intersect select b limit 3", "select a limit 5 minus select b", "select count(*)", "select count(*) group by a", "select 1 from @single_row", "values (1), (2)", "select a from @this as t limit 4", "select a limit 3 |> select a join @b as b on true")
    return spark.createDataFrame([(t, engine.most_rows(t)) for t in texts], "text string, most long")


def http(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service through WSGI: statuses, headers and bodies of its paths."""
    app = application(Service(_catalog(spark, sf_dir)))

    def ask(path: str, query: str = "", body: str | None = None, **headers) -> tuple[str, dict, bytes]:
        seen = {}
        environ = {"PATH_INFO": path, "QUERY_STRING": query, "REQUEST_METHOD": "GET" if body is None else "POST", "wsgi.input": io.BytesIO((body or "").encode()), "CONTENT_LENGTH": str(len(body or ""))} | headers
        data = b"".join(app(environ, lambda status, h: seen.update(status=status, headers=dict(h))))
        return seen["status"], seen["headers"], data

    out = []
    note = lambda name, *facts: out.append((name, ",".join(map(str, facts))))
    status, headers, data = ask("/query", "dataset=nations&query=select+name+where+region+%3D+2+order+by+name&rowCount=approximate")
    note("query", status, data.decode().count("\n"), headers["Content-Type"])
    note("unchanged", ask("/query", "dataset=nations&query=select+name+where+region+%3D+2+order+by+name&rowCount=approximate", HTTP_IF_NONE_MATCH=headers["ETag"])[0])
    status, headers, data = ask("/new-query", body="dataset=nations&query=select+name+where+name+%3D+get_context('n')&context.n=NATION_3")
    note("new query", status, headers["Content-Encoding"], gzip.decompress(data).decode().splitlines()[1])
    note("bad", ask("/query", "dataset=nations&query=select+x")[0])
    note("missing", ask("/query", "dataset=none&query=select+x")[0], ask("/elsewhere")[0])
    note("lookups", *(ask(p, "dataset=nations")[2].decode().strip() for p in ("/exists", "/version", "/rollups")))
    note("schema", ask("/schema", "dataset=nations")[2].decode().strip())
    note("info", '"columns": [{"type": "text", "name": "name"}]' in ask("/info", body="dataset=nations&query=select+name")[2].decode())
    return spark.createDataFrame(out, "name string, facts string")


_KEYS = "n_nationkey::BIGINT AS id, n_name AS name, n_regionkey AS region"
#: name -> (function, SQL)
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "copy_scan": (copy_scan, f"SELECT {_KEYS} FROM nation WHERE n_regionkey < 3"),
    "copy_stages": (copy_stages, "SELECT which, n_nationkey::BIGINT AS id, n_name AS name, ':id,title,note' AS columns FROM nation, (VALUES ('published'), ('unpublished'), ('latest'), ('1'), ('None')) t(which)"),
    "copy_published": (copy_published, f"SELECT {_KEYS}, 'discarded,published,discarded' AS stages FROM nation WHERE n_regionkey <> 1"),
    "rows_changed": (rows_changed, "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey IN (0, 2) THEN 'NEW_' || n_nationkey WHEN n_nationkey = 7 THEN 'PART' ELSE n_name END AS name, CASE WHEN n_nationkey = 1 THEN 99 ELSE n_regionkey END AS region FROM nation WHERE n_nationkey NOT IN (5, 6, 8)"),
    "rows_compacted": (rows_compacted, "SELECT n_nationkey::BIGINT AS id, n_name AS name, CASE WHEN n_nationkey < 5 THEN 100 + n_nationkey ELSE n_regionkey END AS region, 0 AS deltas FROM nation WHERE n_nationkey NOT BETWEEN 10 AND 14"),
    "rows_truncated": (rows_truncated, f"SELECT {_KEYS} FROM nation WHERE n_regionkey = 2"),
    "resynced": (resynced, f"SELECT {_KEYS}, 41 AS version FROM nation WHERE n_nationkey % 2 = 0"),
    "catalog_state": (catalog_state, "SELECT * FROM (VALUES ('indexes', 'by_name'), ('directives', 'search'), ('modified', '2024-02-29'), ('id', ':id'), ('version', '4'), ('copy', '1'), ('views', '{}'), ('last copy', 'kept'), ('gap', 'True'), ('exists', 'True,False'), ('bytes', 'True')) t(fact, value)"),
    "view_scan": (view_scan, "SELECT n_regionkey AS region, count(*) AS n, min(n_name) AS first, max(n_nationkey)::BIGINT AS top, 'True,1,totals' AS state FROM nation WHERE n_nationkey >= 7 GROUP BY n_regionkey"),
    "view_substituted": (view_substituted, "SELECT n_regionkey AS region, 'view ' || min(n_name) AS first FROM nation GROUP BY n_regionkey HAVING count(*) > 2 UNION ALL SELECT n_regionkey, max(n_name) FROM nation GROUP BY n_regionkey UNION ALL SELECT n_regionkey, 'view ' || min(n_name) FROM nation WHERE n_regionkey = 4 GROUP BY n_regionkey"),
    "view_cascade": (view_cascade, "SELECT r_name AS title, count(*) AS n, '2,sizes' AS state FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 0 OR n_nationkey <= 5 GROUP BY r_name"),
    "view_policy": (view_policy, "SELECT * FROM (VALUES ('before', 'forced'), ('after', 'forced,waits'), ('clock', 'forbidden'), ('dropped', 'waits')) t(fact, value)"),
    "streamed_changes": (streamed_changes, "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey < 2 THEN 'second' WHEN n_nationkey < 4 THEN 'first' ELSE n_name END AS name, n_regionkey AS region, 2 AS version FROM nation WHERE n_nationkey <= 20"),
    "csv_source": (csv_source, "SELECT o_orderkey::DOUBLE AS k, o_orderstatus = 'F' AS done, o_totalprice, o_orderdate, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS f, o_orderdate::DATE::VARCHAR AS d, 'a \"quoted\", text' AS t FROM orders"),
    "csv_formats": (csv_formats, """SELECT * FROM (VALUES (12.5::DOUBLE, '2024-01-02T03:04:05.678Z', '2024-01-02T03:04:05.000', true, 'POINT (1 2)', '[1,2]', 'say "x", y'), (-3::DOUBLE, '2024-01-02T08:04:05.000Z', '1999-12-31T23:59:59.999', false, NULL, NULL, NULL), (NULL, NULL, NULL, NULL, NULL, NULL, NULL)) t(n, f, g, b, p, j, t)"""),
    "script_source": (script_source, """SELECT * FROM (VALUES (1::BIGINT, 'a', 2.5::DOUBLE, '2008-08-01T15:12:34.000', 'POINT (1 2)'), (3, 'c', NULL, NULL, NULL), (4, 'd', 7, NULL, NULL)) t(id, code, price, "at", spot)"""),
    "result_cjson": (result_cjson, """SELECT '[{"approximate_row_count": 25, "data_version": 3, "last_modified": "2024-01-01", "locale": "en_US", "schema": [{"type": "text", "name": "name"}, {"type": "number", "name": "region"}, {"type": "boolean", "name": "big"}, {"type": "floating_timestamp", "name": "t"}]}' AS line UNION ALL SELECT ',["' || n_name || '", ' || n_regionkey || ', ' || (n_regionkey > 2)::VARCHAR || ', "2024-01-01T00:00:00.000"]' FROM nation UNION ALL SELECT ']'"""),
    "result_gzipped": (result_gzipped, """SELECT ',["' || n_name || '"]' AS line FROM (SELECT n_name FROM nation ORDER BY n_name LIMIT 3) UNION ALL SELECT ']'"""),
    "result_schema": (result_schema, "SELECT * FROM (VALUES (0, 'n_name', 'text'), (1, 'n_nationkey', 'number'), (2, 'd', 'double'), (3, 'b', 'boolean'), (4, 'p', 'point'), (5, 't', 'date'), (6, 'i', 'interval')) t(place, name, kind)"),
    "row_counts": (row_counts, "SELECT 'limited' AS name, count(*) AS n FROM orders UNION ALL SELECT 'grouped', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'union', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer) UNION ALL SELECT 'piped', 7"),
    "refused": (refused, "SELECT * FROM (VALUES ('select nothing', 'refused'), ('select coalesce(n_name, n_nationkey)', 'refused'), ('select n_name group by n_regionkey', 'refused'), ('select n_name union select r_name, r_regionkey from @region', 'refused'), ('select n_name union select r_regionkey from @region', 'refused'), ('select nofunction(n_name)', 'refused'), ('select n_name where n_name', 'refused'), ('select n_name', 'accepted')) t(text, fate)"),
    "explained": (explained, "SELECT * FROM (VALUES ('scan', true), ('pushed', true), ('columns', true)) t(part, there)"),
    "limits": (limits, "SELECT text, most::BIGINT AS most FROM (VALUES ('select a', NULL), ('select a limit 5', 5), ('select a limit 5 |> select b limit 9', 5), ('select a limit 9 offset 2 |> select b offset 4', 5), ('select a limit 5 union all select b limit 3', 8), ('select a limit 5 union select b', NULL), ('select a limit 5 intersect select b limit 3', 3), ('select a limit 5 minus select b', 5), ('select count(*)', 1), ('select count(*) group by a', NULL), ('select 1 from @single_row', 1), ('values (1), (2)', 2), ('select a from @this as t limit 4', 4), ('select a limit 3 |> select a join @b as b on true', NULL)) t(text, most)"),
    "http": (http, """SELECT * FROM (VALUES ('query', '200 OK,7,application/json'), ('unchanged', '304 Not Modified'), ('new query', '200 OK,gzip,,["NATION_3"]'), ('bad', '400 Bad Request'), ('missing', '404 Not Found,404 Not Found'), ('lookups', 'true,1,[]'), ('schema', '[{"type": "row_identifier", "name": ":id"}, {"type": "text", "name": "name"}, {"type": "number", "name": "region"}]'), ('info', 'True')) t(name, facts)"""),
    "served": (served, """SELECT * FROM (VALUES ('first', '200,5,True'), ('too many', '429'), ('cached', '200,true,True'), ('unchanged', '304'), ('other context', '200'), ('bad', '400'), ('missing', '404'), ('view', 'true,5'), ('named view', '5'), ('numbered copy', '25'), ('lookups', 'True,2,[''totals''],3,[{''type'': ''text'', ''name'': ''name''}]')) t(name, facts)"""),
}
