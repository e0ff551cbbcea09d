"""The engine's operators as queries over the synthetic tables, with the same in DuckDB's SQL.

Each entry: the engine's SQL, and the oracle's where it differs. Bare table names are Parquet tables of the
folder that the query is run on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flatsql.api import Engine
from flatsql.sources.csv import spool
from flatsql.sources.parquet import read_parquet

_SPAN = "SELECT o_orderkey AS k, {0} AS v FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"
_GAP = "(floor(epoch(l_shipdate)) - floor(epoch(o_orderdate)))"


def _scalar(expr: str, table: str, key: str, oracle: str | None = None) -> tuple[str, str]:
    text = "SELECT {1} AS k, {0} AS v FROM {2}"
    return text.format(expr, key, table), text.format(oracle or expr, key, table)


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "month": 2592000, "year": 31536000}

SQL: dict[str, str | tuple[str, str]] = {
    # scan and projection
    "flagship": "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag ORDER BY q DESC LIMIT 2",
    "select_star": "SELECT * FROM nation",
    "select_cols": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "select_alias": "SELECT c_name AS who, c_acctbal AS balance FROM customer",
    "limit_ordered": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10",
    "limit_zero": "SELECT c_custkey FROM customer LIMIT 0",
    # predicates
    "cmp_eq": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 25",
    "cmp_ne": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber != 1",
    "cmp_ne_angle": "SELECT n_name FROM nation WHERE n_regionkey <> 2",
    "cmp_gt": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > 50000",
    "cmp_ge": "SELECT s_suppkey FROM supplier WHERE s_suppkey >= 50",
    "cmp_lt": "SELECT p_partkey FROM part WHERE p_size < 5",
    "cmp_le": "SELECT p_partkey FROM part WHERE p_retailprice <= 1000.5",
    "cmp_text_eq": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    "cmp_text_bare": ("SELECT c_custkey FROM customer WHERE c_mktsegment = BUILDING", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "cmp_text_gt": "SELECT c_custkey FROM customer WHERE c_mktsegment > 'FURNITURE'",
    "cmp_number_in_quotes": "SELECT p_partkey FROM part WHERE p_size = '7'",
    "cmp_timestamp": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= '1998-01-01'",
    "like_prefix": "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'S%'",
    "like_suffix": "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%R'",
    "like_contains": "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%'",
    "like_underscore": "SELECT c_custkey FROM customer WHERE c_name LIKE 'Customer#00000__1_'",
    "ilike": "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b%g'",
    "in_text": "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "in_num": "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9)",
    "not_in": "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 5, 9)",
    "not_like": "SELECT p_partkey FROM part WHERE p_type NOT LIKE 'S%'",
    "between_num": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12",
    "between_text": "SELECT c_custkey FROM customer WHERE c_mktsegment BETWEEN 'B' AND 'G'",
    "between_date": "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN '1997-01-01' AND '1997-03-31'",
    "is_null": "SELECT c_custkey FROM customer WHERE c_name IS NULL",
    "is_not_null": "SELECT count(*) AS n FROM customer WHERE c_name IS NOT NULL",
    "and_or_paren": "SELECT p_partkey FROM part WHERE (p_size < 10 OR p_size > 40) AND p_retailprice > 1200",
    "or_binds_last": "SELECT p_partkey FROM part WHERE p_size = 3 OR p_size = 4 AND p_retailprice > 1200",
    "not_pred": "SELECT p_partkey FROM part WHERE NOT p_size > 10 AND p_retailprice > 1000",
    "null_and_between": "SELECT p_partkey FROM part WHERE p_name IS NOT NULL AND p_size BETWEEN 3 AND 6",
    "where_datediff": (
        "SELECT l_orderkey, l_linenumber FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE DATEDIFF('day', o_orderdate, l_shipdate) > 60",
        f"SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {_GAP} / 86400 > 60",
    ),
    "where_extract": "SELECT o_orderkey FROM orders WHERE EXTRACT(month FROM o_orderdate) = 12",
    "where_dateadd": ("SELECT o_orderkey FROM orders WHERE DATEADD('day', 10, o_orderdate) >= '1998-06-01'", "SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 10 DAY >= TIMESTAMP '1998-06-01'"),
    # joins
    "join2": ("SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "join_on_reversed": ("SELECT c.c_custkey, n.n_name FROM customer c INNER JOIN nation n ON n.n_nationkey = c.c_nationkey", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "join_where": "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_acctbal > 5000",
    "join3": "SELECT c_custkey, r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'",
    "join4": "SELECT o.o_orderkey, r.r_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey",
    "join_star": "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey",
    "join_limit": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY n_name LIMIT 5",
    "join_large": "SELECT o_orderpriority AS p, COUNT(*) AS n, SUM(l_extendedprice) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority",
    "join_group_order": "SELECT n_name, COUNT(*) AS n, SUM(c_acctbal) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY s DESC LIMIT 5",
    "join_distinct": "SELECT DISTINCT r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "join_scalar": "SELECT UPPER(r_name) AS r, LOWER(n_name) AS n FROM nation JOIN region ON n_regionkey = r_regionkey",
    # aggregates
    "count_star": "SELECT COUNT(*) AS n FROM lineitem",
    "count_col": "SELECT COUNT(l_returnflag) AS n FROM lineitem",
    "count_distinct": "SELECT COUNT(DISTINCT l_suppkey) AS n FROM lineitem",
    "sum_avg_min_max": "SELECT SUM(l_quantity) AS s, AVG(l_quantity) AS a, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi FROM lineitem",
    "sum_of_none": ("SELECT SUM(l_quantity) AS s, AVG(l_quantity) AS a, MIN(l_quantity) AS lo, COUNT(*) AS n FROM lineitem WHERE l_quantity > 1000", "SELECT coalesce(SUM(l_quantity), 0) AS s, coalesce(AVG(l_quantity), 0) AS a, MIN(l_quantity) AS lo, COUNT(*) AS n FROM lineitem WHERE l_quantity > 1000"),
    "min_max_text": "SELECT MIN(c_name) AS lo, MAX(c_mktsegment) AS hi FROM customer",
    "min_max_date": "SELECT MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi FROM lineitem",
    "round_agg": ("SELECT l_returnflag AS f, ROUND(AVG(l_extendedprice), 2) AS a FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag AS f, round(AVG(l_extendedprice) * 100) / 100 AS a FROM lineitem GROUP BY l_returnflag"),
    "case_sum": "SELECT l_linestatus AS s, SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r FROM lineitem GROUP BY l_linestatus",
    "case_avg": "SELECT AVG(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS share FROM lineitem",
    "case_count_min_max": "SELECT COUNT(CASE WHEN p_size > 25 THEN p_size END) AS n, MIN(CASE WHEN p_size > 25 THEN p_size ELSE 99 END) AS lo, MAX(CASE WHEN p_size > 25 THEN 0 ELSE p_size END) AS hi FROM part",
    "group1": "SELECT c_mktsegment AS m, COUNT(*) AS n, SUM(c_acctbal) AS s, AVG(c_acctbal) AS a FROM customer GROUP BY c_mktsegment",
    "group2": "SELECT l_returnflag AS f, l_linestatus AS s, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_where": "SELECT event_type AS e, COUNT(*) AS n, SUM(value) AS v FROM events WHERE value > 10 GROUP BY event_type",
    "group_star": ("SELECT * FROM customer GROUP BY c_mktsegment", "SELECT DISTINCT c_mktsegment FROM customer"),
    "group_alias": ("SELECT EXTRACT(year FROM o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY y", "SELECT CAST(EXTRACT(year FROM o_orderdate) AS INTEGER) AS y, COUNT(*) AS n FROM orders GROUP BY 1"),
    "group_strftime": ("SELECT STRFTIME('%Y-%m', o_orderdate) AS m, COUNT(*) AS n, SUM(o_totalprice) AS s FROM orders GROUP BY STRFTIME('%Y-%m', o_orderdate)", "SELECT strftime(o_orderdate, '%Y-%m') AS m, COUNT(*) AS n, SUM(o_totalprice) AS s FROM orders GROUP BY 1"),
    "group_substr": "SELECT SUBSTR(p_brand, 1, 7) AS b, COUNT(*) AS n FROM part GROUP BY SUBSTR(p_brand, 1, 7)",
    "group_scalar_key": "SELECT LOWER(c_mktsegment) AS m, COUNT(*) AS n FROM customer GROUP BY c_mktsegment",
    "group_order_limit": "SELECT l_suppkey AS s, SUM(l_quantity) AS q FROM lineitem GROUP BY l_suppkey ORDER BY q DESC, s LIMIT 7",
    "having_agg": "SELECT l_suppkey AS s, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 600",
    "having_alias": ("SELECT n_regionkey AS r, COUNT(*) AS n FROM nation GROUP BY n_regionkey HAVING n >= 5", "SELECT n_regionkey AS r, COUNT(*) AS n FROM nation GROUP BY n_regionkey HAVING COUNT(*) >= 5"),
    "having_hidden": "SELECT c_nationkey AS k FROM customer GROUP BY c_nationkey HAVING AVG(c_acctbal) > 4500 AND COUNT(*) > 10",
    "having_global": "SELECT COUNT(*) AS n FROM customer HAVING COUNT(*) > 10",
    "global_where": "SELECT COUNT(*) AS n, SUM(l_extendedprice) AS s FROM lineitem WHERE l_discount >= 0.05 AND l_quantity < 24",
    "avg_datediff": (
        "SELECT o_orderpriority AS p, AVG(DATEDIFF('day', o_orderdate, l_shipdate)) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority",
        f"SELECT o_orderpriority AS p, AVG({_GAP} / 86400) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority",
    ),
    # distinct and order
    "distinct1": "SELECT DISTINCT c_mktsegment FROM customer",
    "distinct2": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "distinct_star": "SELECT DISTINCT * FROM region",
    "distinct_where": "SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9000",
    "distinct_scalar": "SELECT DISTINCT SUBSTR(c_name, 1, 12) AS p FROM customer",
    "distinct_order_limit": "SELECT DISTINCT p_size FROM part ORDER BY p_size DESC LIMIT 5",
    "distinct_group": "SELECT DISTINCT COUNT(*) AS n FROM nation GROUP BY n_regionkey",
    "order_asc": "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal",
    "order_multi": "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_returnflag DESC, l_extendedprice, l_orderkey, l_linenumber LIMIT 20",
    "order_alias": "SELECT c_custkey AS k, c_acctbal AS b FROM customer ORDER BY b DESC, k LIMIT 15",
    "order_position": "SELECT c_custkey, c_acctbal FROM customer ORDER BY 2, 1 LIMIT 15",
    "order_unselected": "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15",
    "order_text": "SELECT c_custkey, c_name FROM customer ORDER BY c_name DESC LIMIT 12",
    "topk_where": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity > 30 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10",
    # scalars
    "upper": _scalar("UPPER(c_name)", "customer", "c_custkey"),
    "lower": _scalar("LOWER(c_mktsegment)", "customer", "c_custkey"),
    "trim": _scalar("TRIM(c_name)", "customer", "c_custkey"),
    "length": _scalar("LENGTH(text)", "documents", "doc_id", "strlen(text)"),
    "substr": _scalar("SUBSTR(c_name, 10, 4)", "customer", "c_custkey"),
    "substr_rest": _scalar("SUBSTRING(c_name, 10)", "customer", "c_custkey", "substr(c_name, 10)"),
    "substr_end": _scalar("SUBSTR(c_name, -4)", "customer", "c_custkey", "right(c_name, 4)"),
    "abs": _scalar("ABS(c_acctbal)", "customer", "c_custkey"),
    "ceil": _scalar("CEIL(c_acctbal)", "customer", "c_custkey"),
    "floor": _scalar("FLOOR(c_acctbal)", "customer", "c_custkey"),
    "mod": _scalar("MOD(c_custkey, 7)", "customer", "c_custkey", "c_custkey % 7"),
    "mod_floored": _scalar("MOD(c_acctbal, 7)", "customer", "c_custkey", "c_acctbal - floor(c_acctbal / 7) * 7"),
    "round": _scalar("ROUND(c_acctbal)", "customer", "c_custkey", "CAST(round(c_acctbal) AS BIGINT)"),
    "round_n": _scalar("ROUND(l_extendedprice, 1)", "lineitem", "l_orderkey, l_linenumber", "round(l_extendedprice * 10) / 10"),
    "coalesce": _scalar("COALESCE(c_name, c_mktsegment, 'none')", "customer", "c_custkey"),
    "cast_int": _scalar("CAST(c_acctbal AS INT)", "customer", "c_custkey", "CAST(trunc(c_acctbal) AS BIGINT)"),
    "cast_float": _scalar("CAST(p_size AS DOUBLE)", "part", "p_partkey"),
    "cast_text": _scalar("CAST(p_size AS VARCHAR)", "part", "p_partkey"),
    "nested": _scalar("UPPER(SUBSTR(c_mktsegment, 1, 3))", "customer", "c_custkey"),
    # dates
    **{f"datediff_{u}": (_SPAN.format(f"DATEDIFF('{u}', o_orderdate, l_shipdate)"), _SPAN.format(f"{_GAP} / {n}.0")) for u, n in _UNITS.items()},
    **{f"dateadd_{u}": (f"SELECT o_orderkey AS k, DATEADD('{u}', 3, o_orderdate) AS v FROM orders", f"SELECT o_orderkey AS k, o_orderdate + INTERVAL {3 * n} SECOND AS v FROM orders") for u, n in _UNITS.items()},
    **{f"extract_{p}": (f"SELECT event_id AS k, EXTRACT({p} FROM ts) AS v FROM events", f"SELECT event_id AS k, CAST(EXTRACT({p} FROM ts) AS INTEGER) AS v FROM events") for p in ("year", "month", "day", "hour", "minute", "second")},
    "strftime_select": ("SELECT event_id AS k, STRFTIME('%d/%m/%Y %H:%M:%S', ts) AS v FROM events", "SELECT event_id AS k, strftime(ts, '%d/%m/%Y %H:%M:%S') AS v FROM events"),
}

#: Positional mode, each with its oracle.
SIMPLE: dict[str, tuple[list[str], str]] = {
    "simple_all": (["nation", "", "", "0"], "SELECT * FROM nation"),
    "simple_mode": (["customer", "c_custkey,c_acctbal", "c_acctbal>5000 AND c_custkey<900", "10", "c_acctbal:desc"], "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_custkey < 900 ORDER BY c_acctbal DESC LIMIT 10"),
    "simple_default_limit": (["part", "p_partkey", "p_size=7", "", "p_partkey"], "SELECT p_partkey FROM part WHERE p_size = 7 ORDER BY p_partkey LIMIT 10"),
}

#: Texts that are written to CSV files and read from there: blanks, short and long rows, quotes, line breaks, mixed numbers and dates.
CSV = {
    "people": 'id,name,age,city,note\n1,Ann,30,Rome,"a, b"\n2,Bob,,Oslo,"say ""hi"""\n3,cid,1e2,rome,\n\n4,Dan, 41 ,Oslo,"two\nlines"\n5,Ève,abc,,0x10\n6,Flo\n7,Gus,25,Oslo,1d,extra\n',
    "depts": "city,dept\nRome,A\nOslo,B\n,C\n",
    "spans": "id,a,b\n1,2026-01-31T03:30:00Z,02/01/2026 00:00\n2,31.01.2026 03:30,20260201000000\n3,,2026-02-01\n4,x,2026-02-01 06:00:00\n",
    "wide": "k,v\n1,1e20\n2,-1e20\n3,9007199254740994\n4,2.5\n5,\n",
}
#: The same as tables for the oracle.
_VALUES = {
    "people": "(VALUES ('1', 'Ann', '30', 'Rome', 'a, b'), ('2', 'Bob', '', 'Oslo', 'say \"hi\"'), ('3', 'cid', '1e2', 'rome', ''), ('4', 'Dan', ' 41 ', 'Oslo', 'two' || chr(10) || 'lines'), ('5', 'Ève', 'abc', '', '0x10'), ('6', 'Flo', '', '', ''), ('7', 'Gus', '25', 'Oslo', '1d')) people(id, name, age, city, note)",
    "depts": "(VALUES ('Rome', 'A'), ('Oslo', 'B'), ('', 'C')) depts(city, dept)",
    "spans": "(VALUES ('1', TIMESTAMP '2026-01-31 03:30:00', TIMESTAMP '2026-02-01'), ('2', TIMESTAMP '2026-01-31 03:30:00', TIMESTAMP '2026-02-01'), ('3', NULL, TIMESTAMP '2026-02-01'), ('4', NULL, TIMESTAMP '2026-02-01 06:00:00')) spans(id, a, b)",
    "wide": "(VALUES ('1', 1e20::DOUBLE), ('2', -1e20::DOUBLE), ('3', 9007199254740994::DOUBLE), ('4', 2.5::DOUBLE), ('5', NULL)) wide(k, v)",
}
_AGE = "try_cast(trim(age) AS DOUBLE)"
CSV_SQL: dict[str, tuple[str, str]] = {
    "csv_rows": ("SELECT * FROM people", "SELECT * FROM people"),
    "csv_line_break": ("SELECT id, note FROM people WHERE note LIKE 'two%'", "SELECT id, note FROM people WHERE note LIKE 'two%'"),
    "csv_number_filter": ("SELECT id FROM people WHERE age > 29", f"SELECT id FROM people WHERE {_AGE} > 29"),
    "csv_not_filter": ("SELECT id FROM people WHERE NOT age = 30", f"SELECT id FROM people WHERE NOT coalesce({_AGE} = 30, false)"),
    "csv_is_null": ("SELECT id FROM people WHERE age IS NULL", "SELECT id FROM people WHERE age = ''"),
    "csv_counts": (
        "SELECT COUNT(*) AS n, COUNT(age) AS c, COUNT(DISTINCT city) AS d, SUM(age) AS s, AVG(age) AS a, MIN(age) AS lo, MAX(name) AS hi FROM people",
        f"SELECT count(*) AS n, count(nullif(age, '')) AS c, count(DISTINCT city) AS d, sum({_AGE}) AS s, avg({_AGE}) AS a, CAST(CAST(min({_AGE}) AS BIGINT) AS VARCHAR) AS lo, max(name) AS hi FROM people",
    ),
    "csv_case": ("SELECT id, CASE WHEN city = 'Oslo' THEN 'o' WHEN age IS NULL THEN 'none' ELSE 'x' END AS k FROM people", "SELECT id, CASE WHEN city = 'Oslo' THEN 'o' WHEN age = '' THEN 'none' ELSE 'x' END AS k FROM people"),
    "csv_group_case": (
        "SELECT CASE WHEN Age > 29 THEN 'old' ELSE 'young' END AS k, COUNT(*) AS n FROM people GROUP BY CASE WHEN age > 29 THEN 'old' ELSE 'young' END",
        f"SELECT CASE WHEN {_AGE} > 29 THEN 'old' ELSE 'young' END AS k, count(*) AS n FROM people GROUP BY 1",
    ),
    "csv_group_blank": ("SELECT city, COUNT(*) AS n FROM people GROUP BY city HAVING n > 1", "SELECT city, count(*) AS n FROM people GROUP BY city HAVING count(*) > 1"),
    "csv_order_mixed": ("SELECT id FROM people ORDER BY age DESC, id LIMIT 3", f"SELECT id FROM people ORDER BY age <> '' AND {_AGE} IS NULL DESC, {_AGE} DESC NULLS LAST, id LIMIT 3"),
    "csv_length": ("SELECT id, LENGTH(name) AS n FROM people", "SELECT id, strlen(name) AS n FROM people"),
    "csv_coalesce": ("SELECT id, COALESCE(note, city, 'none') AS v FROM people", "SELECT id, coalesce(nullif(note, ''), nullif(city, ''), 'none') AS v FROM people"),
    "csv_join": ("SELECT p.id, d.dept FROM people p JOIN depts d ON p.city = d.city", "SELECT id, dept FROM people JOIN depts USING (city)"),
    "csv_datediff": ("SELECT id, DATEDIFF('hour', a, b) AS h FROM spans", "SELECT id, coalesce((epoch(b) - epoch(a)) / 3600, 0.0) AS h FROM spans"),
    "csv_extract": ("SELECT id, EXTRACT(hour FROM b) AS h, EXTRACT(month FROM a) AS m FROM spans", "SELECT id, CAST(EXTRACT(hour FROM b) AS INTEGER) AS h, CAST(coalesce(EXTRACT(month FROM a), 0) AS INTEGER) AS m FROM spans"),
    "csv_wide_whole": ("SELECT k, CEIL(v) AS c, FLOOR(v) AS f, ROUND(v) AS r FROM wide", "SELECT k, ceil(v) AS c, floor(v) AS f, try_cast(round(v) AS BIGINT) AS r FROM wide"),
    "csv_wide_mod": ("SELECT k, MOD(v, 7) AS m FROM wide", "SELECT k, v - floor(v / 7) * 7 AS m FROM wide"),
    "csv_wide_text": ("SELECT k, CAST(CAST(v AS DOUBLE) AS VARCHAR) AS t FROM wide WHERE v IS NOT NULL", "SELECT k, CASE k WHEN '4' THEN '2.5' ELSE CAST(CAST(v AS HUGEINT) AS VARCHAR) END AS t FROM wide WHERE v IS NOT NULL"),
    "csv_wide_literal": ("SELECT k FROM wide WHERE v < 99999999999999999999999", "SELECT k FROM wide WHERE v < 99999999999999999999999"),
}


def _csv(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        for name, content in CSV.items():
            if name in text:
                engine.register(name, engine.resolver(spool(spark, [content])))
        return engine.sql(text)

    return run


def _csv_oracle(text: str) -> str:
    return "WITH " + ", ".join(f"{name} AS (SELECT * FROM {values})" for name, values in _VALUES.items() if name in text) + " " + text


def join_date_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date column meets a timestamp column."""
    days = read_parquet(spark, f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return Engine(spark, base=sf_dir).register("days", days).sql("SELECT o_orderkey, day FROM orders JOIN days ON o_orderdate = day")


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark, base=sf_dir).sql(text)


def _simple(args: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark, base=sf_dir).simple(args)


QUERIES = {name: _sql(sql if isinstance(sql, str) else sql[0]) for name, sql in SQL.items()} | {name: _simple(args) for name, (args, _) in SIMPLE.items()}
QUERIES |= {name: _csv(sql) for name, (sql, _) in CSV_SQL.items()} | {"join_date_time": join_date_time}
ORACLE_SQL = {name: sql if isinstance(sql, str) else sql[1] for name, sql in SQL.items()} | {name: sql for name, (_, sql) in SIMPLE.items()}
ORACLE_SQL |= {name: _csv_oracle(sql) for name, (_, sql) in CSV_SQL.items()}
ORACLE_SQL["join_date_time"] = "SELECT o_orderkey, day FROM orders JOIN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) d ON o_orderdate = day"
