"""Registered queries over the star-schema tables, each in the dialect and as DuckDB SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from . import conformance, stores
from .planner import Engine

_L, _O, _C, _P, _E = "lineitem", "orders", "customer", "part", "events"


def _q(primary: str, text: str, sql: str | None = None):
    """A query; without ``sql`` the text itself is SQL once @ is dropped and FROM is added."""
    if sql is None:
        sql = text.replace("@", "")
        head, *rest = _clause(sql)
        sql = f"{head} FROM {primary} {' '.join(rest)}" if " from " not in f" {sql.lower()} " else sql
    return primary, text, sql


def _clause(sql: str) -> list[str]:
    """The select list, and the rest from the first clause outside parentheses."""
    depth = 0
    for i, c in enumerate(sql):
        depth += (c == "(") - (c == ")")
        if not depth and sql[i:].lower().startswith((" join ", " left outer join ", " where ", " group by ", " order by ", " limit ", " having ")):
            return [sql[:i], sql[i:]]
    return [sql, ""]


QUERIES: dict[str, tuple[str, str, str]] = {
    # grouping and aggregates
    "pricing_summary": _q(_L, "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, avg(l_extendedprice) as avg_price, count(*) as n where l_shipdate <= '1998-09-02' group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus"),
    "agg_min_max": _q(_P, "select p_brand, min(p_retailprice) as lo, max(p_retailprice) as hi, count(p_name) as n group by p_brand"),
    "agg_filter": _q(_O, "select o_orderstatus, count(*) filter (where o_totalprice > 100000) as big, sum(o_totalprice) filter (where o_orderpriority = '1-URGENT') as urgent group by o_orderstatus"),
    "agg_distinct": _q(_O, "select o_orderpriority, count(distinct o_custkey) as customers group by o_orderpriority"),
    "agg_median": _q(_L, "select l_returnflag, median(l_quantity) as med group by l_returnflag", "select l_returnflag, median(l_quantity)::DOUBLE as med from lineitem group by l_returnflag"),
    "agg_median_text": _q(_P, "select p_size, median(p_brand) as med group by p_size", "select p_size, quantile_disc(p_brand, 0.5) as med from part group by p_size"),
    "agg_stddev": _q(_L, "select l_returnflag, stddev_pop(l_quantity) as sp, stddev_samp(l_quantity) as ss group by l_returnflag"),
    "agg_regr": _q(_L, "select regr_slope(l_extendedprice, l_quantity) as slope, regr_intercept(l_extendedprice, l_quantity) as icept, regr_r2(l_extendedprice, l_quantity) as r2"),
    "agg_having_alias": _q(_O, "select o_custkey, sum(o_totalprice) as total group by o_custkey having total > 200000", "select o_custkey, sum(o_totalprice) as total from orders group by o_custkey having sum(o_totalprice) > 200000"),
    "agg_group_expression": _q(_O, "select date_trunc_ym(o_orderdate) as month, count(*) as n group by month", "select date_trunc('month', o_orderdate)::TIMESTAMP as month, count(*) as n from orders group by 1"),
    "agg_global": _q(_L, "select count(*) as n, sum(l_quantity) as q, avg(l_discount) as d"),
    "agg_mixed_expression": _q(_O, "select upper(o_orderstatus) || '-' || o_orderpriority as k, max(o_totalprice) - min(o_totalprice) as spread group by o_orderstatus, o_orderpriority", "select upper(o_orderstatus) || '-' || o_orderpriority as k, max(o_totalprice) - min(o_totalprice) as spread from orders group by o_orderstatus, o_orderpriority"),
    # filters and predicates
    "filter_predicates": _q(_L, "select l_orderkey, l_linenumber where l_quantity between 10 and 12 and l_returnflag in ('A', 'R') and not l_linestatus = 'O' and l_discount <> 0.05"),
    "filter_like": _q(_P, "select p_partkey, p_name where p_name like '%gear%' or p_type not like 'S%'"),
    "filter_caseless": _q(_C, "select c_custkey where caseless_eq(c_mktsegment, 'building') or caseless_contains(c_name, 'CUSTOMER#00000001')", "select c_custkey from customer where upper(c_mktsegment) = 'BUILDING' or contains(upper(c_name), 'CUSTOMER#00000001')"),
    "filter_nulls": _q(_C, "select c_custkey, nullif(c_mktsegment, 'BUILDING') as s where nullif(c_mktsegment, 'MACHINERY') is not null"),
    "filter_least_greatest": _q(_L, "select l_orderkey, l_linenumber, least(l_quantity, l_tax * 100) as lo, greatest(l_quantity, 25) as hi where l_linenumber = 1"),
    # text
    "text_functions": _q(_P, "select p_partkey, lower(p_name) as lo, upper(p_type) as up, length(p_name) as n, replace(p_brand, 'Brand', 'B') as b, starts_with(p_type, 'P') as s, contains(p_name, 'a') as c", "select p_partkey, lower(p_name) as lo, upper(p_type) as up, length(p_name)::INT as n, replace(p_brand, 'Brand', 'B') as b, starts_with(p_type, 'P') as s, contains(p_name, 'a') as c from part"),
    "text_pad_split": _q(_P, "select p_partkey, left_pad(p_brand, 12, '*') as l, right_pad(p_brand, 12, '-') as r, split_part(p_type, ' ', 2) as s, trim('  ' || p_brand || ' ') as t", "select p_partkey, lpad(p_brand, 12, '*') as l, rpad(p_brand, 12, '-') as r, split_part(p_type, ' ', 2) as s, trim('  ' || p_brand || ' ') as t from part"),
    "text_substring": _q(_P, "select p_partkey, substring(p_name, 3) as a, substring(p_name, 2, 4) as b, substring(p_name, 0, 3) as c, substring(p_name, -2, 4) as d", "select p_partkey, substr(p_name, 3) as a, substr(p_name, 2, 4) as b, substr(p_name, 1, 2) as c, substr(p_name, 1, 1) as d from part"),
    "text_chr": _q(_P, "select p_partkey, chr(8364) || chr(p_size + 64) as c", "select p_partkey, chr(8364) || chr(p_size + 64) as c from part"),
    # numbers
    "number_functions": _q(_L, "select l_orderkey, l_linenumber, abs(-l_quantity) as a, ceil(l_tax * 10) as c, floor(l_tax * 10) as f, round(l_extendedprice, 1) as r, l_orderkey % 7 as m, ln(l_quantity) as l, 2 ^ l_linenumber as p", "select l_orderkey, l_linenumber, abs(-l_quantity) as a, ceil(l_tax * 10)::BIGINT as c, floor(l_tax * 10)::BIGINT as f, round(l_extendedprice, 1) as r, l_orderkey % 7 as m, ln(l_quantity) as l, pow(2, l_linenumber) as p from lineitem"),
    "number_magnitude": _q(_C, "select c_custkey, signed_magnitude_10(c_acctbal) as m10, signed_magnitude_linear(c_acctbal, 100) as lin, width_bucket(c_acctbal, 0, 10000, 10) as wb", "select c_custkey, sign(c_acctbal) * length(floor(abs(c_acctbal))::BIGINT::VARCHAR) as m10, sign(c_acctbal) * floor(abs(c_acctbal) / 100 + 1) as lin, case when c_acctbal < 0 then 0 when c_acctbal >= 10000 then 11 else floor(c_acctbal / 1000) + 1 end::BIGINT as wb from customer"),
    "number_precedence": _q(_L, "select l_orderkey, l_linenumber, 2 * 3 ^ 2 + l_linenumber * (1 - l_discount) as x", "select l_orderkey, l_linenumber, 2 * pow(3, 2) + l_linenumber * (1 - l_discount) as x from lineitem"),
    # dates
    "date_extract": _q(_O, "select o_orderkey, date_extract_y(o_orderdate) as y, date_extract_m(o_orderdate) as m, date_extract_d(o_orderdate) as d, date_extract_dow(o_orderdate) as w, date_extract_woy(o_orderdate) as k, date_extract_iso_y(o_orderdate) as iy", "select o_orderkey, year(o_orderdate)::INT as y, month(o_orderdate)::INT as m, day(o_orderdate)::INT as d, extract(dow from o_orderdate)::INT as w, week(o_orderdate)::INT as k, isoyear(o_orderdate)::INT as iy from orders"),
    "date_extract_time": _q(_E, "select event_id, date_extract_hh(ts) as h, date_extract_mm(ts) as m, date_extract_ss(ts)::double as s", "select event_id, hour(ts)::INT as h, minute(ts)::INT as m, (extract(microseconds from ts) / 1000000)::DOUBLE as s from events"),
    "date_fields": _q(_O, "select o_orderkey, o_orderdate.year as y, o_orderdate.day_of_week as w, o_orderdate.date::text as d", "select o_orderkey, year(o_orderdate)::INT as y, extract(dow from o_orderdate)::INT as w, o_orderdate::DATE::VARCHAR as d from orders"),
    "date_trunc": _q(_E, "select event_id, date_trunc_ymd(ts) as d, date_trunc_ym(ts) as m, date_trunc_y(ts) as y", "select event_id, date_trunc('day', ts)::TIMESTAMP as d, date_trunc('month', ts)::TIMESTAMP as m, date_trunc('year', ts)::TIMESTAMP as y from events"),
    "date_diff": _q(_L, "select l_orderkey, l_linenumber, date_diff_d(l_shipdate, '1995-06-17') as d, date_diff_business_days(l_shipdate, '1995-06-17') as b", "select l_orderkey, l_linenumber, trunc((epoch_us(l_shipdate) - epoch_us(TIMESTAMP '1995-06-17')) / 86400000000.0)::BIGINT as d, len(list_filter(generate_series(least(l_shipdate::DATE, DATE '1995-06-17')::TIMESTAMP, greatest(l_shipdate::DATE, DATE '1995-06-17')::TIMESTAMP, INTERVAL 1 DAY), lambda x: isodow(x) < 6))::BIGINT as b from lineitem"),
    "date_interval": _q(_O, "select o_orderkey, o_orderdate + 'P1M2DT3H' as a, o_orderdate - 'P1Y' as b, date_add(o_orderdate, 'PT90S') as c", "select o_orderkey, o_orderdate + INTERVAL 1 MONTH + INTERVAL 2 DAY + INTERVAL 3 HOUR as a, o_orderdate - INTERVAL 1 YEAR as b, o_orderdate + INTERVAL 90 SECOND as c from orders"),
    # conversions
    "cast_numbers": _q(_P, "select p_partkey, p_size::text as t, p_retailprice::text as d, p_size::double as f, ('12.5'::number + p_size)::double as n", "select p_partkey, p_size::VARCHAR as t, p_retailprice::VARCHAR as d, p_size::DOUBLE as f, (12.5 + p_size)::DOUBLE as n from part"),
    "cast_stamps": _q(_O, "select o_orderkey, o_orderdate::text as t, o_orderdate::date::text as d", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.') || lpad((extract(ms from o_orderdate) % 1000)::INT::VARCHAR, 3, '0') as t, o_orderdate::DATE::VARCHAR as d from orders"),
    "cast_boolean": _q(_C, "select c_custkey, (c_acctbal > 0)::text as t, 'on'::boolean and c_acctbal > 100 as b", "select c_custkey, (c_acctbal > 0)::VARCHAR as t, c_acctbal > 100 as b from customer"),
    # conditions
    "case_functions": _q(_C, "select c_custkey, case(c_acctbal < 0, 'debt', c_acctbal < 1000, 'low', true, 'ok') as a, case when c_nationkey = 1 then 'one' else 'other' end as b, iif(c_acctbal > 5000, 1, 0) as c, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as d", "select c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal < 1000 then 'low' else 'ok' end as a, case when c_nationkey = 1 then 'one' else 'other' end as b, case when c_acctbal > 5000 then 1 else 0 end as c, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as d from customer"),
    # joins
    "join_inner": _q(_O, "select o_orderkey, @c.c_name, @n.n_name join @customer as c on o_custkey = @c.c_custkey join @nation as n on @c.c_nationkey = @n.n_nationkey where o_totalprice > 100000", "select o_orderkey, c.c_name, n.n_name from orders join customer c on o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey where o_totalprice > 100000"),
    "join_left": _q(_C, "select c_custkey, @o.o_orderkey left outer join @orders as o on c_custkey = @o.o_custkey and @o.o_totalprice > 200000", "select c_custkey, o.o_orderkey from customer left join orders o on c_custkey = o.o_custkey and o.o_totalprice > 200000"),
    "join_full": _q("supplier", "select s_suppkey, @c.c_custkey full outer join @customer as c on s_nationkey = @c.c_nationkey and @c.c_acctbal > 9000", "select s_suppkey, c.c_custkey from supplier full join customer c on s_nationkey = c.c_nationkey and c.c_acctbal > 9000"),
    "join_theta": _q("nation", "select n_name, @b.n_name as other join @nation as b on n_regionkey = @b.n_regionkey and n_nationkey < @b.n_nationkey", "select a.n_name, b.n_name as other from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey"),
    "join_cross": _q("region", "select r_name, @n.n_name join @nation as n on true", "select r_name, n.n_name from region cross join nation n"),
    "join_subquery": _q(_C, "select c_name, @t.total join (select o_custkey, sum(o_totalprice) as total from @orders group by o_custkey |> select * where total > 150000) as t on c_custkey = @t.o_custkey", "select c_name, t.total from customer join (select o_custkey, sum(o_totalprice) as total from orders group by o_custkey having sum(o_totalprice) > 150000) t on c_custkey = t.o_custkey"),
    "join_lateral": _q("nation", "select n_name, @c.n join lateral (select count(*) as n from @customer where c_nationkey = n_nationkey) as c on true", "select n_name, c.n from nation, lateral (select count(*) as n from customer where c_nationkey = n_nationkey) c"),
    # windows
    "window_rank": _q(_O, "select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn, rank() over (partition by o_orderpriority order by o_orderdate) as rk, dense_rank() over (partition by o_orderstatus order by o_orderpriority) as dr"),
    "window_lag_lead": _q(_O, "select o_orderkey, lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as a, lead(o_totalprice, 2, 0) over (partition by o_custkey order by o_orderdate, o_orderkey) as b"),
    "window_frame": _q(_O, "select o_orderkey, sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row) as s, first_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as f, last_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as l"),
    "window_filter": _q(_O, "select o_orderkey, count(*) filter (where o_orderstatus = 'F') over (partition by o_custkey) as n, avg(o_totalprice) over (partition by o_orderpriority) as a"),
    "window_ntile": _q(_O, "select o_orderkey, ntile(4) over (partition by o_orderstatus order by o_totalprice, o_orderkey) as q"),
    "window_median": _q(_O, "select o_orderkey, median(o_totalprice) over (partition by o_orderpriority) as m", "select o_orderkey, median(o_totalprice) over (partition by o_orderpriority) as m from orders"),
    "window_then_filter": _q(_O, "select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn |> select o_custkey, o_orderkey where rn <= 2", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) where rn <= 2"),
    # order, limit, distinct
    "top_k": _q(_O, "select o_orderkey, o_totalprice order by o_totalprice desc, o_orderkey limit 10 offset 5"),
    "distinct_rows": _q(_C, "select distinct c_nationkey, c_mktsegment"),
    "distinct_on": _q(_O, "select distinct on (o_custkey) o_custkey, o_orderkey order by o_custkey, o_totalprice desc, o_orderkey", "select distinct on (o_custkey) o_custkey, o_orderkey from orders order by o_custkey, o_totalprice desc, o_orderkey"),
    # set operations, pipes
    "set_union": _q("nation", "select n_regionkey as k union select r_regionkey as k from @region", "select n_regionkey as k from nation union select r_regionkey from region"),
    "set_union_all": _q("nation", "select n_regionkey as k union all select r_regionkey as k from @region", "select n_regionkey as k from nation union all select r_regionkey from region"),
    "set_intersect_minus": _q(_C, "(select c_nationkey as k intersect select s_nationkey as k from @supplier) minus select n_nationkey as k from @nation where n_regionkey = 1", "(select c_nationkey as k from customer intersect select s_nationkey from supplier) except select n_nationkey from nation where n_regionkey = 1"),
    "set_multi": _q(_C, "select c_nationkey as k minus all select s_nationkey as k from @supplier", "select c_nationkey as k from customer except all select s_nationkey from supplier"),
    "set_then_pipe": _q("nation", "select n_name as x union all select r_name as x from @region |> select length(x) as n, count(*) as c group by n", "select length(x)::INT as n, count(*) as c from (select n_name as x from nation union all select r_name from region) group by 1"),
    "pipe_chain": _q(_L, "select l_orderkey, sum(l_extendedprice * (1 - l_discount)) as rev group by l_orderkey |> select rev / 1000 as k |> select floor(k / 10) as bucket, count(*) as n group by bucket", "select floor(rev / 1000 / 10)::BIGINT as bucket, count(*) as n from (select sum(l_extendedprice * (1 - l_discount)) as rev from lineitem group by l_orderkey) group by 1"),
    "star_except": _q("nation", "select * (except n_regionkey)", "select n_nationkey, n_name from nation"),
    "pipe_materialized": _q("nation", "select hint(materialized) n_name, n_regionkey |> select n_regionkey, count(*) as n group by n_regionkey", "select n_regionkey, count(*) as n from nation group by 1"),
    # search, JSON, context
    "search_leading": _q(_P, "select p_partkey search 'rings'", "select p_partkey from part where list_contains(string_split(p_name, ' '), 'ring')"),
    "context_lookup": _q("region", "select r_name, get_context('user') as u, get_context('none') as v", "select r_name, 'ann' as u, NULL::VARCHAR as v from region"),
    "utc_zone": _q(_E, "select event_id, to_floating_timestamp('2024-07-01T12:00:00Z'::fixed_timestamp, 'PDT') as t", "select event_id, TIMESTAMP '2024-07-01 05:00:00' as t from events"),
    "location_address": _q(_C, "select c_custkey, human_address(c_name, c_mktsegment, null, '1') as a", """select c_custkey, '{"address": "' || c_name || '", "city": "' || c_mktsegment || '", "state": "", "zip": "1"}' as a from customer"""),
    "url_text": _q("pages", "select page_id, url(url, 'page')::text as t, url(url, 'page').url as u", "select page_id, 'page (' || url || ')' as t, url as u from pages"),
}


QUERIES |= conformance.QUERIES
NOW = datetime.datetime(2024, 2, 29, 12, tzinfo=datetime.timezone.utc)


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    made = conformance.typed_tables(spark, sf_dir)
    table = lambda name: made[name]() if name in made else spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return Engine(configure(spark), table, variables={"user": "ann"}, now=NOW)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, d, p=primary, t=text: engine(spark, d).query(t, p)) for name, (primary, text, _) in QUERIES.items()} | {name: fn for name, (fn, _) in stores.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in QUERIES.items()} | {name: sql for name, (_, sql) in stores.QUERIES.items()}
