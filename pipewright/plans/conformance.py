"""Registered queries for the typed parts of the dialect: dates, times, intervals, JSON, documents, locations, geometry.

Values come from the star-schema tables where DuckDB can compute the same; results of geometry on fixed shapes
are written out, worked by hand or known from geodesy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_L, _O, _C, _P, _E, _N = "lineitem", "orders", "customer", "part", "events", "nation"
_MS = "'%Y-%m-%dT%H:%M:%S.%g'"


def typed_tables(spark: SparkSession, sf_dir: str) -> dict:
    """Tables of kinds that no Parquet file here has, made from those that are there."""
    nation = lambda: spark.read.parquet(f"{sf_dir}/nation.parquet")

    def files() -> DataFrame:
        document = F.struct(F.concat(F.lit("id-"), "n_nationkey").alias("file_id"), F.concat("n_name", F.lit(".pdf")).alias("filename"), F.lit("application/pdf").alias("content_type"))
        return nation().select("n_nationkey", F.when(F.col("n_nationkey") > 0, document).alias("file"))

    def numbered() -> DataFrame:
        return nation().select(F.col("n_nationkey").cast("long").alias(":id"), (F.col("n_nationkey").cast("long") * 10).alias(":version"), "n_name", F.col("n_regionkey").alias("order"))

    return {"files": files, "numbered": numbered}


#: name -> (primary table, text in the dialect, SQL)
QUERIES: dict[str, tuple[str, str, str]] = {
    # predicates
    "pred_null": (_C, "select c_custkey, nullif(c_mktsegment, 'BUILDING') is null as a, nullif(c_mktsegment, 'BUILDING') is not null as b, null is null as c", "select c_custkey, nullif(c_mktsegment, 'BUILDING') is null as a, nullif(c_mktsegment, 'BUILDING') is not null as b, true as c from customer"),
    "pred_ranges": (_O, "select o_orderkey where o_totalprice not between 1000 and 200000 and o_orderpriority not in ('1-URGENT', '5-LOW') and o_totalprice >= 500 and o_orderstatus == 'F' and o_custkey != 3", "select o_orderkey from orders where o_totalprice not between 1000 and 200000 and o_orderpriority not in ('1-URGENT', '5-LOW') and o_totalprice >= 500 and o_orderstatus = 'F' and o_custkey <> 3"),
    "pred_caseless": (_C, "select c_custkey, caseless_one_of(c_mktsegment, 'building', 'Machinery') as a, caseless_not_one_of(c_mktsegment, 'building') as b, caseless_ne(c_mktsegment, 'building') as c, caseless_starts_with(c_name, 'cUSTOMER#00000000') as d", "select c_custkey, c_mktsegment in ('BUILDING', 'MACHINERY') as a, c_mktsegment <> 'BUILDING' as b, c_mktsegment <> 'BUILDING' as c, starts_with(c_name, 'Customer#00000000') as d from customer"),
    "pred_like_wildcards": (_N, "select n_nationkey where n_name like 'NATION__' and n_name like '%1%'", "select n_nationkey from nation where n_name like 'NATION__' and n_name like '%1%'"),
    "number_operators": (_L, "select l_orderkey, l_linenumber, l_orderkey / 7 as a, l_quantity / 3 as b, l_quantity % 7 as c, l_quantity ^ 2 as d, +l_quantity as e, (l_linenumber * 2)::text as f, (l_orderkey * 100000 * 1000000000 * 1000000000)::text as g", "select l_orderkey, l_linenumber, l_orderkey / 7 as a, l_quantity / 3 as b, l_quantity % 7 as c, pow(l_quantity, 2) as d, l_quantity as e, (l_linenumber * 2)::VARCHAR as f, (l_orderkey::HUGEINT * 100000 * 1000000000 * 1000000000)::VARCHAR as g from lineitem"),
    "number_sums": (_L, "select l_returnflag, sum(l_orderkey * 1000000000000000)::text as a, sum(l_linenumber)::text as b, sum(distinct l_linenumber)::text as c, (count(*) * 10000000000000000000)::text as d group by l_returnflag", "select l_returnflag, sum(l_orderkey::HUGEINT * 1000000000000000)::HUGEINT::VARCHAR as a, sum(l_linenumber)::VARCHAR as b, sum(distinct l_linenumber)::VARCHAR as c, (count(*)::HUGEINT * 10000000000000000000)::VARCHAR as d from lineitem group by l_returnflag"),
    "text_trim_accents": (_P, "select p_partkey, trim_leading('  ' || p_brand || ' ') as a, trim_trailing(' ' || p_brand || '  ') as b, unaccent('Ünïß' || p_brand || 'çÉøñ') as c", "select p_partkey, p_brand || ' ' as a, ' ' || p_brand as b, 'Uniss' || p_brand || 'cEon' as c from part"),
    # dates, times, intervals
    "date_type_parts": (_O, "select o_orderkey, o_orderdate.date as d |> select o_orderkey, date_trunc_ymd(d)::text as td, date_trunc_ym(d)::text as tm, date_trunc_y(d)::text as ty, date_extract_y(d) as y, date_extract_m(d) as m, date_extract_d(d) as dd, date_extract_dow(d) as w, date_extract_woy(d) as k, date_extract_iso_y(d) as iy, d.year as y2, d.month as m2, d.day as d2, d.day_of_week as w2, d.week_of_year as k2, d.iso_year as iy2", "select o_orderkey, d::VARCHAR as td, date_trunc('month', d)::DATE::VARCHAR as tm, date_trunc('year', d)::DATE::VARCHAR as ty, year(d)::INT as y, month(d)::INT as m, day(d)::INT as dd, extract(dow from d)::INT as w, week(d)::INT as k, isoyear(d)::INT as iy, year(d)::INT as y2, month(d)::INT as m2, day(d)::INT as d2, extract(dow from d)::INT as w2, week(d)::INT as k2, isoyear(d)::INT as iy2 from (select o_orderkey, o_orderdate::DATE as d from orders)"),
    "stamp_fields": (_E, "select event_id, ts.month as m, ts.day as d, ts.hour as h, ts.minute as i, ts.second::double as s, ts.week_of_year as k, ts.iso_year as y, ts.time::text as t", "select event_id, month(ts)::INT as m, day(ts)::INT as d, hour(ts)::INT as h, minute(ts)::INT as i, (extract(microseconds from ts) / 1000000)::DOUBLE as s, week(ts)::INT as k, isoyear(ts)::INT as y, strftime(ts, '%H:%M:%S.%g') as t from events"),
    "time_fields": (_E, "select event_id, ts.time as t |> select event_id, t.hour as h, t.minute as m, t.second::double as s, date_extract_hh(t) as h2, date_extract_mm(t) as m2, date_extract_ss(t)::double as s2", "select event_id, hour(ts)::INT as h, minute(ts)::INT as m, (extract(microseconds from ts) / 1000000)::DOUBLE as s, hour(ts)::INT as h2, minute(ts)::INT as m2, (extract(microseconds from ts) / 1000000)::DOUBLE as s2 from events"),
    "time_arithmetic": (_E, "select event_id, date_trunc_ymd(ts).time as z, ts.time as t |> select event_id, z::text as z, (t + 'PT14H') = ('PT14H'::interval + t) as same, (t + 'PT14H').hour as h, (t - 'PT1H30M').hour as g, (t - t)::text as nil, t - z = t - z as e", "select event_id, '00:00:00.000' as z, true as same, hour(ts + INTERVAL 14 HOUR)::INT as h, hour(ts - INTERVAL 90 MINUTE)::INT as g, 'PT0S' as nil, true as e from events"),
    "time_constants": ("region", "select r_name, ('12:34:56.5'::time - '10:00:00'::time)::text as a, ('10:30:00'::time + 'PT14H')::text as b, ('00:30:00'::time - 'PT1H')::text as c, '23:59:59.25'::time::text as d", "select r_name, 'PT2H34M56.5S' as a, '00:30:00.000' as b, '23:30:00.000' as c, '23:59:59.250' as d from region"),
    "date_arithmetic": (_O, "select o_orderkey, o_orderdate.date as d |> select o_orderkey, d + 'P1M2D' as a, 'P1M'::interval + d as b, d - 'P1Y' as c, d - '1995-06-17'::date as n, date_diff_d(d, '1995-06-17'::date) as m, d + '10:30:00'::time as e, '10:30:00'::time + d as f, date_diff_business_days(d, '1995-06-17'::date) as w", "select o_orderkey, d + INTERVAL 1 MONTH + INTERVAL 2 DAY as a, d + INTERVAL 1 MONTH as b, d - INTERVAL 1 YEAR as c, (d - DATE '1995-06-17')::INT as n, (d - DATE '1995-06-17')::INT as m, d + INTERVAL 630 MINUTE as e, d + INTERVAL 630 MINUTE as f, len(list_filter(generate_series(least(d, DATE '1995-06-17')::TIMESTAMP, greatest(d, DATE '1995-06-17')::TIMESTAMP, INTERVAL 1 DAY), lambda x: isodow(x) < 6))::BIGINT as w from (select o_orderkey, o_orderdate::DATE as d from orders)"),
    "interval_text": (_P, "select p_partkey, ('P' || p_size || 'DT' || p_size || 'H')::interval::text as a, '2020-01-31T00:00:00'::floating_timestamp + ('P' || p_size || 'D')::interval as b, 'P1Y2M3DT4H5M6.5S'::interval::text as c, '-P1M'::interval::text as d, 'P2W'::interval::text as e", "select p_partkey, 'P' || p_size || 'DT' || p_size || 'H' as a, TIMESTAMP '2020-01-31' + p_size * INTERVAL 1 DAY as b, 'P1Y2M3DT4H5M6.5S' as c, 'P-1M' as d, 'P14D' as e from part"),
    "fixed_trunc": (_E, "select event_id, (ts::text || 'Z')::fixed_timestamp as f |> select event_id, f::text as t, date_trunc_ymd(f)::text as a, date_trunc_ym(f)::text as b, date_trunc_y(f)::text as c, date_trunc_ymd(f, 'PST')::text as d, date_trunc_ym(f, 'PST')::text as e, date_trunc_y(f, 'PST')::text as g", f"select event_id, strftime(ts, {_MS}) || 'Z' as t, strftime(date_trunc('day', ts)::TIMESTAMP, {_MS}) || 'Z' as a, strftime(date_trunc('month', ts)::TIMESTAMP, {_MS}) || 'Z' as b, strftime(date_trunc('year', ts)::TIMESTAMP, {_MS}) || 'Z' as c, strftime(date_trunc('day', ts - INTERVAL 8 HOUR)::TIMESTAMP, {_MS}) as d, strftime(date_trunc('month', ts - INTERVAL 8 HOUR)::TIMESTAMP, {_MS}) as e, strftime(date_trunc('year', ts - INTERVAL 8 HOUR)::TIMESTAMP, {_MS}) as g from events"),
    "fixed_arithmetic": (_O, "select o_orderkey, (o_orderdate::text || 'Z')::fixed_timestamp as f |> select o_orderkey, epoch_seconds(f)::double as s, date_diff_d(f, '1995-06-17T00:00:00Z'::fixed_timestamp) as d, date_diff_business_days(f, '1995-06-17T12:00:00Z'::fixed_timestamp, 'PST') as w, (f + 'P1DT1H')::text as a, (f - 'PT30M')::text as b, date_add(f, 'PT90S')::text as c, to_floating_timestamp(f, 'EST') as e", f"select o_orderkey, epoch_us(o_orderdate) / 1000000.0 as s, trunc((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-06-17')) / 86400000000.0)::BIGINT as d, len(list_filter(generate_series(least((o_orderdate - INTERVAL 8 HOUR)::DATE, DATE '1995-06-17')::TIMESTAMP, greatest((o_orderdate - INTERVAL 8 HOUR)::DATE, DATE '1995-06-17')::TIMESTAMP, INTERVAL 1 DAY), lambda x: isodow(x) < 6))::BIGINT as w, strftime(o_orderdate + INTERVAL 25 HOUR, {_MS}) || 'Z' as a, strftime(o_orderdate - INTERVAL 30 MINUTE, {_MS}) || 'Z' as b, strftime(o_orderdate + INTERVAL 90 SECOND, {_MS}) || 'Z' as c, o_orderdate - INTERVAL 5 HOUR as e from orders"),
    "stamp_from_text": (_O, "select o_orderkey, (o_orderdate::text)::floating_timestamp as a, '1999-12-31T23:59:59.999'::floating_timestamp as b, '2020-02-29'::date::text as c", "select o_orderkey, o_orderdate as a, TIMESTAMP '1999-12-31 23:59:59.999' as b, '2020-02-29' as c from orders"),
    "utc_date": (_N, "select n_nationkey, get_utc_date()::text as a, get_utc_date() > '2024-02-29T11:00:00Z' as b", "select n_nationkey, '2024-02-29T12:00:00.000Z' as a, true as b from nation"),
    # casts that keep text
    "cast_opaque": (_N, "select n_nationkey, n_name::blob::text as a, n_name::photo::text as b, 'yes'::boolean as c, (n_nationkey::text)::number + 0.5 = n_nationkey + 0.5 as d", "select n_nationkey, n_name as a, n_name as b, true as c, true as d from nation"),
    "row_ids": ("numbered", "select :id::text as i, :version::text as v, n_name where :id in ('row-3', 'row-5') or :version = 'rv-70' or :id = 'row-9'::row_identifier or :version = 'rv-10'::row_version", "select 'row-' || n_nationkey as i, 'rv-' || n_nationkey * 10 as v, n_name from nation where n_nationkey in (1, 3, 5, 7, 9)"),
    "system_columns": ("numbered", "select @n.:id as a, @n.n_name join @numbered as n on :id = @n.:id where :id > 20", "select n_nationkey::BIGINT as a, n_name from nation where n_nationkey > 20"),
    "unreserved_alias": ("numbered", "select count(*) as rows, max(order) as first, min(order) as following, sum(order)::text as partition", "select count(*) as rows, max(n_regionkey) as first, min(n_regionkey) as following, sum(n_regionkey)::VARCHAR as partition from nation"),
    # JSON, documents, urls
    "json_parts": (_E, "select event_id, props::json as j |> select event_id, j.k::text as k, j.none::text as n, j::text as t, '[\"a\", {\"b\": 5}]'::json[0]::text as a, '[\"a\", {\"b\": 5}]'::json[1].b::text as b", "select event_id, (props::JSON->>'$.k') as k, NULL::VARCHAR as n, replace(props, ' ', '') as t, '\"a\"' as a, '5' as b from events"),
    "document_parts": ("files", "select n_nationkey, file.filename as a, file.file_id as b, file.content_type as c, file is null as d", "select n_nationkey, case when n_nationkey > 0 then n_name || '.pdf' end as a, case when n_nationkey > 0 then 'id-' || n_nationkey end as b, case when n_nationkey > 0 then 'application/pdf' end as c, n_nationkey = 0 as d from nation"),
    "url_parts": ("pages", "select page_id, url(url, 'page').description as a, ('{\"url\": \"' || url || '\", \"description\": \"d\"}')::url as u |> select page_id, a, u.url as b, u.description as c, u::text as d, count(u) over (partition by page_id) as n", "select page_id, 'page' as a, url as b, 'd' as c, 'd (' || url || ')' as d, count(*) over (partition by page_id) as n from pages"),
    # locations
    "location_parts": (_N, "select n_nationkey, location(point(n_nationkey, n_regionkey * 10), n_name, 'Town', 'ST', '12345') as l |> select n_nationkey, l.latitude as a, l.longitude as b, location_latitude(l) as c, location_longitude(l) as d, l.address as e, l.city as f, l.zip as g, location_human_address(l) as h, l::point.latitude as i", """select n_nationkey, n_nationkey::DOUBLE as a, (n_regionkey * 10)::DOUBLE as b, n_nationkey::DOUBLE as c, (n_regionkey * 10)::DOUBLE as d, n_name as e, 'Town' as f, '12345' as g, '{"address": "' || n_name || '", "city": "Town", "state": "ST", "zip": "12345"}' as h, n_nationkey::DOUBLE as i from nation"""),
    "location_tests": (_N, "select n_nationkey, location(point(n_nationkey, n_regionkey), n_name, null, null, null) as l |> select n_nationkey, within_box(l, 10, 0, 3, 2) as a, within_polygon(l, 'MULTIPOLYGON (((-1 -1, 2.5 -1, 2.5 12.5, -1 12.5, -1 -1)))') as b, within_circle(l, 0, 0, 300000) as c, round(distance_in_meters(l, 'POINT (0 0)'), 0) = 0 as d", "select n_nationkey, n_nationkey between 3 and 10 and n_regionkey between 0 and 2 as a, n_nationkey < 12.5 and n_regionkey < 2.5 as b, n_nationkey * n_nationkey + n_regionkey * n_regionkey <= 7 as c, n_nationkey = 0 and n_regionkey = 0 as d from nation"),
    "location_from_text": ("region", """select r_name, '{"latitude": "1.5", "longitude": "-2", "human_address": "{\\"address\\": \\"1 Main\\", \\"city\\": \\"Ur\\", \\"state\\": \\"S\\", \\"zip\\": \\"9\\"}"}'::location as l |> select r_name, l.latitude as a, l.longitude as b, l.address as c, l::text as d""", "select r_name, 1.5::DOUBLE as a, -2::DOUBLE as b, '1 Main' as c, '1 Main' || chr(10) || 'Ur, S 9' || chr(10) || '(1.5, -2)' as d from region"),
    # geometry
    "geo_points": (_N, "select n_nationkey, point(n_nationkey, n_regionkey * 10 + 0.5) as p |> select n_nationkey, p.latitude as a, p.longitude as b, p::text as t, num_points(p) as n, is_empty(p) as e, is_empty('POINT EMPTY'::point) as f, ('POINT (' || n_nationkey || ' 2)')::point.longitude as x", "select n_nationkey, n_nationkey::DOUBLE as a, n_regionkey * 10 + 0.5::DOUBLE as b, 'POINT (' || (n_regionkey * 10) || '.5 ' || n_nationkey || ')' as t, 1 as n, false as e, true as f, n_nationkey::DOUBLE as x from nation"),
    "geo_from_text": ("region", "select r_name, 'MULTIPOINT ((1 2), (3 4))'::multipoint::text as a, 'LINESTRING (0 0, 1 1)'::line::text as b, 'MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))'::multiline::text as c, 'POLYGON ((0 0, 1 0, 1 1, 0 0))'::polygon::text as d, 'MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))'::multipolygon::text as e, 'POINT (1 2)'::line is null as f", "select r_name, 'MULTIPOINT ((1 2), (3 4))' as a, 'LINESTRING (0 0, 1 1)' as b, 'MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))' as c, 'POLYGON ((0 0, 1 0, 1 1, 0 0))' as d, 'MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))' as e, true as f from region"),
    "geo_multi": ("region", "select r_name, geo_multi('POINT (1 2)'::point)::text as a, geo_multi('LINESTRING (0 0, 1 1)'::line)::text as b, geo_multi('POLYGON ((0 0, 1 0, 1 1, 0 0))'::polygon)::text as c, geo_multi('MULTIPOINT (1 2)'::multipoint)::text as d, geo_multi('MULTILINESTRING ((0 0, 1 1))'::multiline)::text as e, geo_multi('MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))'::multipolygon)::text as f", "select r_name, 'MULTIPOINT ((1 2))' as a, 'MULTILINESTRING ((0 0, 1 1))' as b, 'MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))' as c, 'MULTIPOINT ((1 2))' as d, 'MULTILINESTRING ((0 0, 1 1))' as e, 'MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))' as f from region"),
    "geo_extract": ("region", "select r_name, geo_collection_extract('POINT (1 2)'::point)::text as a, geo_collection_extract('LINESTRING (0 0, 1 1)'::line)::text as b, geo_collection_extract('POLYGON ((0 0, 1 0, 1 1, 0 0))'::polygon)::text as c", "select r_name, 'MULTIPOINT ((1 2))' as a, 'MULTILINESTRING ((0 0, 1 1))' as b, 'MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))' as c from region"),
    "geo_relations": (_N, "select n_nationkey, point(n_nationkey, n_nationkey) as p, ('LINESTRING (0 ' || n_nationkey || ', 10 ' || n_nationkey || ')')::line as l |> select n_nationkey, intersects(p, 'POLYGON ((0 0, 5 0, 5 5, 0 5, 0 0))'::polygon) as a, within_polygon(p, 'POLYGON ((0 0, 5 0, 5 5, 0 5, 0 0))'::polygon) as b, crosses(l, 'POLYGON ((5 -1, 20 -1, 20 3.5, 5 3.5, 5 -1))'::polygon) as c, intersects(l, 'LINESTRING (5 0, 5 7)'::line) as d", "select n_nationkey, n_nationkey <= 5 as a, n_nationkey > 0 and n_nationkey < 5 as b, n_nationkey < 3.5 as c, n_nationkey <= 7 as d from nation"),
    "geo_overlaps": (_N, "select n_nationkey, ('POLYGON ((' || n_nationkey || ' 0, ' || (n_nationkey + 2) || ' 0, ' || (n_nationkey + 2) || ' 2, ' || n_nationkey || ' 2, ' || n_nationkey || ' 0))')::polygon as g |> select n_nationkey, overlaps(g, 'POLYGON ((3 0, 7 0, 7 2, 3 2, 3 0))'::polygon) as a, intersects(g, 'POLYGON ((3 0, 7 0, 7 2, 3 2, 3 0))'::polygon) as b", "select n_nationkey, n_nationkey in (2, 6) as a, n_nationkey between 1 and 7 as b from nation"),
    "geo_boxes": (_N, "select n_nationkey, point(n_nationkey, n_regionkey) as p |> select n_nationkey, within_box(p, 10, 1, 3, 3) as a, within_circle(p, 0, 0, 600000) as b", "select n_nationkey, n_nationkey between 3 and 10 and n_regionkey between 1 and 3 as a, n_nationkey * n_nationkey + n_regionkey * n_regionkey < 29 as b from nation"),
    "geo_distance": ("region", "select r_name, round(distance_in_meters('POINT (0 0)'::point, 'POINT (1 0)'::point), 2) as a, round(distance_in_meters('POINT (0 0)'::point, 'POINT (0 1)'::point), 2) as b, distance_in_meters('POINT (3 4)'::point, 'POINT (3 4)'::point) as c, round(distance_in_meters('POINT (0 0)'::point, 'POINT (0 90)'::point), 0) as d", "select r_name, 111319.49::DOUBLE as a, 110574.39::DOUBLE as b, 0::DOUBLE as c, 10001966::DOUBLE as d from region"),
    "geo_area": ("region", "select r_name, area('POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))'::polygon) between 12300000000 and 12320000000 as a, area('POINT (0 0)'::point) = 0 as b, area('POLYGON ((0 0, 2 0, 2 1, 0 1, 0 0))'::polygon) / area('POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))'::polygon) between 1.99 and 2.01 as c", "select r_name, true as a, true as b, true as c from region"),
    "geo_unions": ("region", "select r_name, spatial_union('POINT (1 2)'::point, 'MULTIPOINT (1 2, 0 0)'::multipoint)::text as a, spatial_union('LINESTRING (0 0, 1 1)'::line, 'LINESTRING (2 2, 3 3)'::line)::text as b, spatial_union('POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))'::polygon, 'POLYGON ((1 0, 3 0, 3 2, 1 2, 1 0))'::polygon)::text as c, spatial_union('LINESTRING (0 0, 2 2)'::line, 'LINESTRING (0 2, 2 0)'::line)::text as d", "select r_name, 'MULTIPOINT ((0 0), (1 2))' as a, 'MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))' as b, 'MULTIPOLYGON (((0 0, 0 2, 1 2, 2 2, 3 2, 3 0, 2 0, 1 0, 0 0)))' as c, 'MULTILINESTRING ((0 0, 1 1), (1 1, 2 2), (0 2, 1 1), (1 1, 2 0))' as d from region"),
    "geo_intersection": (_N, "select n_nationkey, ('POLYGON ((0 0, ' || (n_nationkey + 1) || ' 0, ' || (n_nationkey + 1) || ' 2, 0 2, 0 0))')::polygon as g |> select n_nationkey, intersection(g, 'POLYGON ((-1 1, 100 1, 100 5, -1 5, -1 1))'::polygon)::text as a", "select n_nationkey, 'MULTIPOLYGON (((0 1, 0 2, ' || (n_nationkey + 1) || ' 2, ' || (n_nationkey + 1) || ' 1, 0 1)))' as a from nation"),
    "geo_shapes": ("region", "select r_name, simplify('LINESTRING (0 0, 1 0.01, 2 0)'::line, 0.1)::text as a, simplify_preserve_topology('POLYGON ((0 0, 1 0.01, 2 0, 2 2, 0 2, 0 0))'::polygon, 0.1)::text as b, snap_to_grid('LINESTRING (0.1 0.2, 1.4 0.9)'::line, 1)::text as c, reduce_precision('POINT (1.26 3.14)'::point, 0.5)::text as d, convex_hull('MULTIPOINT (0 0, 2 0, 1 1, 1 3)'::multipoint)::text as e, num_points('POLYGON ((0 0, 1 0, 1 1, 0 0))'::polygon) as f", "select r_name, 'LINESTRING (0 0, 2 0)' as a, 'POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))' as b, 'LINESTRING (0 0, 1 1)' as c, 'POINT (1.5 3)' as d, 'MULTIPOLYGON (((0 0, 2 0, 1 3, 0 0)))' as e, 4 as f from region"),
    "geo_concave_hull": ("region", "select r_name, concave_hull('MULTIPOINT (0 0, 6 0, 5 4, 1 4, 3 0.5)'::multipoint, 1)::text as a, concave_hull('MULTIPOINT (0 0, 6 0, 5 4, 1 4, 3 0.5)'::multipoint, 0.3)::text as b, concave_hull('POINT (1 1)'::point, 0.5) is null or is_empty(concave_hull('POINT (1 1)'::point, 0.5)) as c", "select r_name, 'MULTIPOLYGON (((0 0, 6 0, 5 4, 1 4, 0 0)))' as a, 'MULTIPOLYGON (((0 0, 3 0.5, 6 0, 5 4, 1 4, 0 0)))' as b, true as c from region"),
    "geo_validity": ("region", "select r_name, make_valid('POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))'::polygon)::text as a, curated_region_test('POLYGON ((0 0, 1 0, 1 1, 0 0))'::polygon, 100) as b, curated_region_test('POLYGON ((0 0, 1 0, 1 1, 0 0))'::polygon, 3) as c, curated_region_test('POLYGON ((0 0, 500 0, 1 1, 0 0))'::polygon, 100) as d, curated_region_test(null::polygon, 100) as e", "select r_name, 'MULTIPOLYGON (((0 0, 0 2, 1 1, 0 0)), ((1 1, 2 2, 2 0, 1 1)))' as a, NULL::VARCHAR as b, 'too complex' as c, 'out of bounds' as d, 'empty' as e from region"),
    "geo_visible": (_N, "select n_nationkey, visible_at(('POLYGON ((0 0, ' || (n_nationkey + 1) || ' 0, 1 1, 0 0))')::polygon, 10) as a, visible_at(point(1, 1), 1000) as b, visible_at(('LINESTRING (0 0, 0 ' || n_nationkey || ')')::line, 5) as c", "select n_nationkey, n_nationkey + 1 >= 10 as a, true as b, n_nationkey >= 5 as c from nation"),
    "join_geometry": (_N, "select n_nationkey, @r.r_name join (select r_name, ('POLYGON ((' || (r_regionkey * 5) || ' -1, ' || (r_regionkey * 5 + 7.5) || ' -1, ' || (r_regionkey * 5 + 7.5) || ' 30, ' || (r_regionkey * 5) || ' 30, ' || (r_regionkey * 5) || ' -1))')::polygon as g from @region) as r on within_polygon(point(n_nationkey, n_nationkey + 0.25), @r.g) and n_nationkey > 2", "select n_nationkey, r_name from nation join region on n_nationkey + 0.25 > r_regionkey * 5 and n_nationkey + 0.25 < r_regionkey * 5 + 7.5 and n_nationkey > 2"),
    "join_geometry_areas": (_N, "select n_nationkey, @b.k as other join (select n_nationkey as k, ('LINESTRING (' || n_nationkey || ' 0, ' || (n_nationkey + 2.5) || ' 3)')::line as l from @nation) as b on intersects(@b.l, ('LINESTRING (' || n_nationkey || ' 3, ' || (n_nationkey + 2.5) || ' 0)')::line)", "select a.n_nationkey, b.n_nationkey as other from nation a join nation b on abs(a.n_nationkey - b.n_nationkey) <= 2.5"),
    "geo_aggregates": (_N, "select n_regionkey, extent(point(n_nationkey, n_regionkey))::text as e, spatial_union(point(n_nationkey, n_regionkey))::text as u group by n_regionkey", "select n_regionkey, 'MULTIPOLYGON (((' || x || ' ' || lo || ', ' || x || ' ' || hi || ', ' || x || ' ' || hi || ', ' || x || ' ' || lo || ', ' || x || ' ' || lo || ')))' as e, 'MULTIPOINT (' || u || ')' as u from (select n_regionkey, n_regionkey as x, min(n_nationkey) as lo, max(n_nationkey) as hi, string_agg('(' || n_regionkey || ' ' || n_nationkey || ')', ', ' order by n_nationkey) as u from nation group by n_regionkey)"),
    "geo_aggregate_areas": (_N, "select n_regionkey, spatial_union(('POLYGON ((' || n_nationkey || ' 0, ' || (n_nationkey + 30) || ' 0, ' || (n_nationkey + 30) || ' 1, ' || n_nationkey || ' 1, ' || n_nationkey || ' 0))')::polygon)::text as u, num_points(spatial_union(('LINESTRING (0 ' || n_nationkey || ', 1 ' || n_nationkey || ')')::line)) as n group by n_regionkey", "select n_regionkey, 'MULTIPOLYGON (((' || r || ' 0, ' || array_to_string(list_transform([0, 5, 10, 15, 20, 30, 35, 40, 45, 50], lambda x: (r + x) || ' 1'), ', ') || ', ' || array_to_string(list_transform([50, 45, 40, 35, 30, 20, 15, 10, 5, 0], lambda x: (r + x) || ' 0'), ', ') || ')))' as u, 10 as n from (select n_regionkey, min(n_nationkey) as r from nation group by n_regionkey)"),
    # windows, sets, sources
    "window_empty": (_N, "select n_nationkey, count(*) over () as n, max(n_nationkey) over () as m, (sum(n_regionkey) over ())::text as s", "select n_nationkey, count(*) over () as n, max(n_nationkey) over () as m, (sum(n_regionkey) over ())::VARCHAR as s from nation"),
    "window_over_groups": (_N, "select n_regionkey, count(*) as c, sum(count(*)) over ()::text as t, max(n_nationkey) over () - min(n_nationkey) as d, avg(count(*)) filter (where n_regionkey > 1) over () as a group by n_regionkey, n_nationkey", "select n_regionkey, count(*) as c, (sum(count(*)) over ())::VARCHAR as t, max(n_nationkey) over () - min(n_nationkey) as d, avg(count(*)) filter (where n_regionkey > 1) over () as a from nation group by n_regionkey, n_nationkey"),
    "window_offsets": (_O, "select o_orderkey, lead(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as a, lag(o_totalprice, 2) over (partition by o_custkey order by o_orderdate, o_orderkey) as b, lag(o_totalprice, 1, o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as c, lead(o_orderstatus, 3, o_orderpriority) over (partition by o_custkey order by o_orderdate, o_orderkey) as d, lag(o_totalprice, 3, -1) over (partition by o_custkey order by o_orderdate, o_orderkey) as e", "select o_orderkey, lead(o_totalprice) over w as a, lag(o_totalprice, 2) over w as b, lag(o_totalprice, 1, o_orderkey) over w as c, lead(o_orderstatus, 3, o_orderpriority) over w as d, lag(o_totalprice, 3, -1) over w as e from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)"),
    "window_distinct": (_O, "select o_orderkey, count(distinct o_orderstatus) over (partition by o_custkey) as n, median_disc(o_totalprice) over (partition by o_custkey) as m", "select o_orderkey, n, m from orders join (select o_custkey, count(distinct o_orderstatus) as n, quantile_disc(o_totalprice, 0.5) as m from orders group by o_custkey) using (o_custkey)"),
    "set_intersect_all": (_C, "select c_nationkey as k intersect all select s_nationkey as k from @supplier", "select c_nationkey as k from customer intersect all select s_nationkey from supplier"),
    "set_lateral": ("region", "select r_name, @n.n join lateral (select count(*) as n from @nation where n_regionkey = r_regionkey) as n on true union all select n_name as r_name, n_nationkey as n from @nation", "select r_name, (select count(*) from nation where n_regionkey = r_regionkey) as n from region union all select n_name, n_nationkey from nation"),
    "join_nested": (_C, "select c_custkey, @t.r_name join (select n_nationkey, @r.r_name from @nation join @region as r on n_regionkey = @r.r_regionkey) as t on c_nationkey = @t.n_nationkey", "select c_custkey, r_name from customer join (select n_nationkey, r_name from nation join region on n_regionkey = r_regionkey) on c_nationkey = n_nationkey"),
    "join_set": (_N, "select n_name, @u.k join (select c_nationkey as k from @customer union select s_nationkey as k from @supplier) as u on n_nationkey = @u.k", "select n_name, k from nation join (select c_nationkey as k from customer union select s_nationkey from supplier) on n_nationkey = k"),
    "from_single_row": (None, "select 1 as one, 'x' as t from @single_row", "select 1 as one, 'x' as t"),
    "join_single_row": (_N, "select n_name, @s.two join (select 2 as two from @single_row) as s on true", "select n_name, 2 as two from nation"),
    "from_this": (_N, "select n_name, n_regionkey where n_nationkey > 3 |> select @t.n_name, @o.n_name as other from @this as t join @this as o on @t.n_regionkey = @o.n_regionkey", "select a.n_name, b.n_name as other from (select * from nation where n_nationkey > 3) a join (select * from nation where n_nationkey > 3) b on a.n_regionkey = b.n_regionkey"),
    "from_values": (None, "values (1, 'a'), (2, null), (3, 'c') |> select column_1, column_2, (column_1 * 2)::text as d", "select column_1, column_2, (column_1 * 2)::VARCHAR as d from (values (1, 'a'), (2, NULL), (3, 'c')) t(column_1, column_2)"),
    "from_with": (_N, "with @big as (select c_nationkey, count(*) as n from @customer group by c_nationkey) select n_name, @b.n join @big as b on n_nationkey = @b.c_nationkey", "select n_name, n from nation join (select c_nationkey, count(*) as n from customer group by 1) on n_nationkey = c_nationkey"),
    "automatic_names": (_N, "select count(n_name), max(n_nationkey)::text, n_regionkey group by n_regionkey", "select count(n_name) as count_n_name, max(n_nationkey)::VARCHAR as max_n_nationkey_text, n_regionkey from nation group by n_regionkey"),
    "clauses_order": (_N, "select n_name order by n_name offset 3 limit 4", "select n_name from nation order by n_name limit 4 offset 3"),
    "nulls_first": (_C, "select distinct nullif(c_mktsegment, 'BUILDING') as s order by s nulls first limit 3", "select distinct nullif(c_mktsegment, 'BUILDING') as s from customer order by s nulls first limit 3"),
    "quoting": (_N, "select 'it''s ' || n_name as `a name`, n_name as `b-c`", "select 'it''s ' || n_name as \"a name\", n_name as \"b-c\" from nation"),
    # full-text search
    "search_words": (_P, "select p_partkey, p_name search 'gear'", "select p_partkey, p_name from part where list_contains(string_split(p_name, ' '), 'gear')"),
    "search_all_terms": (_P, "select p_partkey, p_name search 'Widgets the RED'", "select p_partkey, p_name from part where list_contains(string_split(p_name, ' '), 'widget') and list_contains(string_split(p_name, ' '), 'red')"),
    "search_across_columns": (_P, "select p_partkey search 'bolt economy'", "select p_partkey from part where list_contains(string_split(p_name, ' '), 'bolt') and p_type = 'ECONOMY'"),
    "search_output": (_P, "select p_type, p_size, count(*) as n group by p_type, p_size search '7'", "select p_type, p_size, count(*) as n from part group by p_type, p_size having p_size = 7 or count(*) = 7"),
    "search_numbers": (_P, "select p_partkey, p_size search '12'", "select p_partkey, p_size from part where p_size = 12 or p_partkey = 12 or p_retailprice = 12 or list_contains(string_split(p_brand, '#'), '12')"),
    "search_nothing": (_P, "select p_partkey, p_size |> select p_partkey search 'gear'", "select p_partkey from part where false"),
    "search_phrases_of_stems": (None, "values ('running horses'), ('the run of a horse'), ('ran horse'), ('RUNS, horse-drawn'), (null) |> select column_1 search 'horse run'", "select column_1 from (values ('running horses'), ('the run of a horse'), ('RUNS, horse-drawn')) t(column_1)"),
}
