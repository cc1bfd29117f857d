"""Semantics that no SQL comparison covers: names, nulls, errors, geometry, locations, views, change sets."""

import pytest

from pipewright.functions import geometry as G
from pipewright.functions.stem import stem
from pipewright.operators.views import Views, tables_of
from pipewright.plans.lexer import QueryError
from pipewright.plans.parser import parse
from pipewright.plans.planner import Engine
from pipewright.session import configure
from pipewright.sources.catalog import Catalog, VersionGap
from pipewright.sources.results import cjson


@pytest.fixture(scope="module")
def engine(spark):
    configure(spark)
    wings = spark.createDataFrame([("APCO", "Karma", "EN-A", 45), ("APCO", "Vista", None, 46), ("OZONE", "Rush", "EN-C", 50), ("zNA", None, "EN-B", None)], "make string, name string, class string, v_max int")
    return Engine(spark, {"wings": wings})


def one(engine, text):
    return engine.query(text, "wings").collect()


def test_automatic_names(engine):
    assert engine.query("select count(name), v_max::text, 1, coalesce(max(v_max), 1) group by v_max::text", "wings").columns == ["count_name", "v_max_text", "_1", "coalesce_max_v_max_1"]


def test_null_order_is_last_ascending_and_first_descending(engine):
    assert [r[0] for r in one(engine, "select v_max order by v_max")][-1] is None
    assert [r[0] for r in one(engine, "select v_max order by v_max desc")][0] is None
    assert [r[0] for r in one(engine, "select v_max order by v_max nulls first")][0] is None


def test_median_and_text_median(engine):
    assert one(engine, "select median(v_max) as a, median(make) as b")[0][:] == (46.0, "APCO")


def test_search(engine):
    assert [r[0] for r in one(engine, "select name search 'karma'")] == ["Karma"]
    assert [r[0] for r in one(engine, "select name search '46'")] == ["Vista"]
    assert one(engine, "select v_max |> select v_max search 'x'") == []


def test_exact_numbers(engine, spark):
    """Integers outgrow 64 bits; floating-point columns count as decimals where asked for."""
    assert one(engine, "select sum(v_max * 10000000000 * 10000000000) as s")[0].s == 141 * 10**20
    assert one(engine, "select 2000000000 + 2000000000 as a, 3000000000 * 4000000000 * 5 as b limit 1")[0][:] == (4 * 10**9, 6 * 10**19)
    money = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "m double")
    assert str(engine.spark and Engine(spark, {"t": money}, exact=True).query("select sum(m) as s, sum(m)::text as t", "t").first().t) == "0.6"


def test_stems():
    """Pairs from the stemmer's published vocabulary."""
    known = "consign consign consigned consign consistency consist knightly knight kneeling kneel knives knive generously generous happily happili relational relat hopefulness hope cries cri ties tie running run hoping hope hopping hop sky sky dying die news news proceed proceed sensibility sensibl digitizer digit conditional condit caresses caress gas gas kiwis kiwi luxuriated luxuri argument argument agreement agreement cooked cook communism communism skating skate controlling control".split()
    assert {w: stem(w) for w in known[::2]} == dict(zip(known[::2], known[1::2], strict=True))


def test_hulls_and_lines():
    from pipewright.functions import hulls

    points = [(float(x), float(y)) for x in range(5) for y in range(5) if (x, y) not in ((2, 4), (2, 3))]
    assert sum(hulls._turn(*t) for t in hulls.triangulate(points)) / 2 == 16
    ring = hulls.concave_hull(points, 0.0)
    assert ring[0] == ring[-1] and len(set(ring)) == len(ring) - 1 and set(ring) <= set(points)
    assert hulls.concave_hull([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], 0.5) == [] and len(hulls.concave_hull(points, 1.0)) >= 5
    assert hulls.union_of_lines([[(0.0, 0.0), (4.0, 0.0)], [(1.0, 0.0), (2.0, 0.0)], [(4.0, 0.0), (0.0, 0.0)]]) == [[(0.0, 0.0), (1.0, 0.0)], [(1.0, 0.0), (2.0, 0.0)], [(2.0, 0.0), (4.0, 0.0)]]


def test_errors(engine):
    for text in ("select nothing", "select coalesce(make, v_max)", "select make group by name", "select nofunction(make)", "select 'x"):
        with pytest.raises(QueryError):
            engine.query(text, "wings")


def test_row_count_ignores_limit(engine):
    assert engine.row_count("select make order by make limit 1", "wings") == 4
    assert engine.row_count("select make, count(*) group by make", "wings") == 3


def test_literals_convert(engine):
    assert one(engine, "select 'PT36H'::interval::text as a, 'P1Y2M'::interval::text as b limit 1")[0][:] == ("PT36H", "P1Y2M")
    assert one(engine, "select '10:30:00'::time + 'PT14H' = '00:30:00'::time as a limit 1")[0][0]


def test_geometry_functions(engine):
    got = one(engine, "select distance_in_meters('POINT (-0.1278 51.5074)'::point, 'POINT (-74.006 40.7128)'::point) as d, within_polygon('POINT (1 1)'::point, 'POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))'::polygon) as w, num_points('LINESTRING (0 0, 1 1)'::line) as n limit 1")[0]
    assert abs(got.d - 5585233.58) < 60 and got.w and got.n == 2
    assert one(engine, "select within_box('POINT (1 2)'::point, 3, 0, 0, 3) as a, is_empty('POINT EMPTY'::point) as e, convex_hull('MULTIPOINT (0 0, 2 0, 1 1, 1 3)'::multipoint)::text as h limit 1")[0][:] == (True, True, "MULTIPOLYGON (((0 0, 2 0, 1 3, 0 0)))")


SQUARES = "values (1, 'POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))'::polygon), (1, 'POLYGON ((1 1, 3 1, 3 3, 1 3, 1 1))'::polygon), (2, null) |> "


def test_polygon_overlays(engine):
    got = {r[0]: r[1:] for r in one(engine, SQUARES + "select column_1, count(*), spatial_union(column_2)::text, extent(column_2)::text group by column_1")}
    assert got[1] == (2, "MULTIPOLYGON (((0 0, 0 2, 1 2, 1 3, 3 3, 3 1, 2 1, 2 0, 0 0)))", "MULTIPOLYGON (((0 0, 0 3, 3 3, 3 0, 0 0)))")
    assert got[2][1] is None
    text = "select extent(column_2) over (partition by column_1)::text as e, spatial_union(column_2) over (partition by column_1)::text as u, intersection(column_2, column_2)::text as i, spatial_union(column_2, column_2)::text as t"
    rows = one(engine, SQUARES + text + " order by column_1")
    assert rows[0].e == rows[1].e == got[1][2] and rows[0].u == got[1][1] and rows[2].e is None
    assert {r.i for r in rows[:2]} == {r.t for r in rows[:2]} == {"MULTIPOLYGON (((0 0, 0 2, 2 2, 2 0, 0 0)))", "MULTIPOLYGON (((1 1, 1 3, 3 3, 3 1, 1 1)))"}


def test_curated_region(engine):
    got = one(engine, SQUARES + "select column_1, curated_region_test(column_2, 10) as a, curated_region_test(column_2, 1) as b, make_valid(column_2)::text as c order by column_1")
    assert [r.a for r in got] == [None, None, "empty"] and got[0].b == "too complex" and got[2].c is None


def test_common_table_expressions_and_values(engine):
    assert sorted(map(tuple, one(engine, "with @fast as (select make, v_max where v_max > 45), @n as (select count(*) as n from @fast) select a.make, b.make as other, @n.n from @fast as a join @fast as b on a.v_max = b.v_max join @n on true"))) == [("APCO", "APCO", 2), ("OZONE", "OZONE", 2)]
    assert [tuple(r) for r in one(engine, "values (1, 'a'), (2, null) |> select column_2, column_1 order by column_1 desc")] == [(None, 2), ("a", 1)]
    assert engine.row_count("with @t as (values (1), (2)) select * from @t limit 1") == 2
    with pytest.raises(QueryError):
        engine.query("values (1), (2, 3)")


def test_row_ids(spark):
    """The cipher's published vector, the text form, and ids in queries with and without a key."""
    import numpy as np

    from pipewright.functions import obfuscate

    assert int(obfuscate.Cipher(bytes(8)).encrypt(np.array([0])).view(np.uint64).byteswap()[0]) == 0x4EF997456198DD78
    assert obfuscate.shown(0x1234567890ABCDEF) == "rmhh.h4ac-6f4q" and obfuscate.number_of("rmhh.h4ac-6f4q") == 0x1234567890ABCDEF
    ids = [0, 1, 2**62 + 1, -7, None]
    engine = Engine(spark, {"t": spark.createDataFrame([(i,) for i in ids], "`:id` long")})
    found = dict(map(tuple, engine.query("select :id as n, :id::text as t", "t", obfuscation_key=b"key").collect()))
    assert found[None] is None and {obfuscate.clear(found[i], b"key", "row") for i in ids[:4]} == set(ids[:4])
    assert [r[0] for r in engine.query(f"select :id as n where :id = '{found[2**62 + 1]}'", "t", obfuscation_key=b"key").collect()] == [2**62 + 1]
    assert [r[0] for r in engine.query("select :id::text as n where :id in ('row-1', 'row-0') order by :id", "t").collect()] == ["row-0", "row-1"]
    with pytest.raises(QueryError):
        engine.query("select :id where :id = 'row-1'", "t", obfuscation_key=b"key")


def test_fingerprint_and_time_limit(engine):
    same = [engine.fingerprint(t, "wings", {"wings": 1}) for t in ("select make", "SELECT  make")]
    assert same[0] == same[1] != engine.fingerprint("select make", "wings", {"wings": 2})
    assert len(engine.collect("select make", "wings", seconds=60)) == 4
    slow = Engine(engine.spark, {"t": engine.spark.range(1, 1 << 40).withColumnRenamed("id", "n")})
    with pytest.raises(TimeoutError):
        slow.collect("select max(n % 7 * n) as m", "t", seconds=1)


@pytest.mark.parametrize("text,kind", [("POINT (1 2.5)", "point"), ("LINESTRING (0 0, 1 1)", "line"), ("POLYGON ((0 0, 1 0, 1 1, 0 0))", "polygon"), ("MULTIPOINT (1 2, 3 4)", "multipoint"), ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))", "multipolygon")])
def test_wkt_round_trip(text, kind):
    got = G.wkt(G.load(G.wkb_of_wkt(text, kind)))
    assert G.wkb_of_wkt(got, kind) == G.wkb_of_wkt(text, kind)
    assert G.wkb_of_wkt(text, "multiline") is None


def test_cjson(engine):
    lines = list(cjson(engine.query("select make, v_max order by v_max limit 1", "wings"), row_count=4))
    assert lines[1:] == [',["APCO", 45]', "]"] and '"approximate_row_count": 4' in lines[0]


def test_catalog_writers_and_leftovers(spark, tmp_path):
    """Of two writers one fails, an unfinished document changes nothing, and what is no longer named goes."""
    import os

    configure(spark)
    catalog = Catalog(spark, f"file://{tmp_path}", deltas=1)
    rows = lambda *r: spark.createDataFrame(r, "`:id` long, make string")
    catalog.apply("wings", 1, [("working_copy_created", "`:id` long, make string"), ("rows_changed", rows((1, "A")), None), ("working_copy_published",)])
    stale = catalog.meta("wings")
    catalog.apply("wings", 2, [("rows_changed", rows((2, "B")), None)])
    with pytest.raises(VersionGap):
        catalog._save("wings", stale)
    (tmp_path / "wings" / "meta" / "half.new").write_text('{"version": 7')
    assert catalog.version("wings") == 2 and len(catalog.copy("wings")["deltas"]) == 1
    for i in range(3, 9):
        catalog.apply("wings", i, [("rows_changed", rows((i, "C")), rows((1, "")) if i == 5 else None)])
    assert sorted(r[0] for r in catalog.read("wings").select(":id").collect()) == [2, 3, 4, 5, 6, 7, 8]
    left = os.listdir(tmp_path / "wings")
    assert len([x for x in left if x.startswith(("copy", "changes"))]) <= 4 and len([x for x in os.listdir(tmp_path / "wings" / "meta") if x.endswith(".json")]) == 2


def test_materialised_hints_are_let_go(engine):
    engine.query("select hint(materialized) make, v_max |> select make", "wings")
    assert len(engine.held) == 1 and engine.held[0].is_cached
    kept = engine.held[0]
    engine.release()
    assert not engine.held and not kept.is_cached


def test_change_sets_and_views(spark, tmp_path):
    configure(spark)
    catalog = Catalog(spark, f"file://{tmp_path}")
    rows = lambda *r: spark.createDataFrame(r, "`:id` long, make string, price int")
    catalog.apply("wings", 1, [("working_copy_created", "`:id` long, make string, price int"), ("rows_changed", rows((1, "A", 10), (2, "B", 20)), None), ("working_copy_published",)])
    views = Views(catalog)
    text = "select make, sum(price) as total group by make"
    views.create("wings", "totals", text)
    version = catalog.meta("wings")["version"]
    catalog.apply("wings", version + 1, [("rows_changed", rows((2, "A", 5)), rows((9, "x", 0))), ("column_created", "note", "string")])
    assert views.substitute(parse(text), "wings").source is None  # stale
    assert views.refresh_for("wings") == [("wings", "totals")]
    assert sorted(map(tuple, views.query(text + " |> select * where total > 1", "wings").collect())) == [("A", 15)]
    assert catalog.exists("wings") and not catalog.exists("other") and catalog.views("wings") == ["totals"]
    assert catalog.schema("wings") == {":id": "row_identifier", "make": "text", "price": "number", "note": "text"}
    assert tables_of(parse("with @t as (select * from @other) select * from @t join @wings on true"), "wings") == {"other", "wings"}
    with pytest.raises(VersionGap):
        catalog.apply("wings", 99, [])
    with pytest.raises(QueryError):
        views.create("wings", "clock", "select get_utc_date() as t")
