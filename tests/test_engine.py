import pytest

from flatsql import Engine, QueryError
from flatsql.sinks.text import text_of

PEOPLE = "id,name,age,city,note\n1,Ann,30,Rome,\"a, b\"\n2,Bob,,Oslo,\"say \"\"hi\"\"\"\n3,cid,1e2,rome,\n\n4,Dan, 41 ,Oslo,x\n5,Ève,abc,,0x10\n6,Flo\n7,Gus,25,Oslo,1d,extra\n"


@pytest.fixture
def engine(spark, tmp_path):
    (tmp_path / "people.csv").write_text(PEOPLE)
    (tmp_path / "depts.csv").write_text("city,dept\nRome,A\nOslo,B\n,C\n")
    e = Engine(spark)
    e.path = lambda n: f"'{tmp_path}/{n}.csv'"
    e.rows = lambda sql: [tuple(r) for r in e.sql(sql.replace("people", e.path("people")).replace("depts", e.path("depts"))).collect()]
    return e


def test_reading(engine):
    rows = engine.rows("SELECT * FROM people ORDER BY id")
    assert len(rows) == 7 and rows[0][4] == "a, b" and rows[1][4] == 'say "hi"'
    assert rows[5] == ("6", "Flo", "", "", "") and rows[6][4] == "1d"


@pytest.mark.parametrize(
    ("where", "ids"),
    [
        ("age > 29", "134"),
        ("age = 41", "4"),
        ("age = '100'", "3"),
        ("age != 30", "347"),
        ("NOT age = 30", "234567"),
        ("age IS NULL", "26"),
        ("age IS NOT NULL AND city = Oslo", "47"),
        ("city = 'Rome' OR city = 'Oslo' AND age < 30", "17"),
        ("(city = 'Rome' OR city = 'Oslo') AND age < 30", "7"),
        ("name LIKE '_ob'", "2"),
        ("name LIKE '%o%'", "26"),
        ("name NOT LIKE '%o%'", "13457"),
        ("city ILIKE 'ROME'", "13"),
        ("note LIKE 'a, %'", "1"),
        ("id IN (1, '3', 9)", "13"),
        ("age IN (30.0)", ""),
        ("age BETWEEN 25 AND 41", "147"),
        ("name BETWEEN 'B' AND 'E'", "24"),
        ("note = '0x10'", "5"),
        ("note > 0", ""),
        ("city != 'Rome'", "234567"),
        ("city < 'P'", "24567"),
        ("LENGTH(name) = 4", "5"),
        ("name <> 'Ann' AND id <= 3", "23"),
    ],
)
def test_where(engine, where, ids):
    assert "".join(r[0] for r in engine.rows(f"SELECT id FROM people WHERE {where} ORDER BY id")) == ids


def test_aggregates_skip_what_is_no_number(engine):
    assert engine.rows("SELECT COUNT(*), COUNT(age), COUNT(DISTINCT city), SUM(age), AVG(age), MIN(age), MAX(name) FROM people") == [(7, 5, 4, 196.0, 49.0, "25", "Ève")]
    assert engine.rows("SELECT SUM(age), AVG(age), MIN(age) FROM people WHERE id > 99") == [(0.0, 0.0, None)]
    assert engine.rows("SELECT SUM(CASE WHEN city = 'Oslo' THEN age ELSE 0 END) FROM people") == [(66.0,)]


def test_group_order_limit(engine):
    assert engine.rows("SELECT city, COUNT(*) AS n FROM people GROUP BY city ORDER BY n DESC, city LIMIT 2") == [("Oslo", 3), ("", 2)]
    assert engine.rows("SELECT UPPER(city) AS u, COUNT(*) AS n FROM people GROUP BY u HAVING n > 1 ORDER BY u") == [("", 2), ("OSLO", 3), ("ROME", 2)]
    assert engine.rows("SELECT DISTINCT city FROM people ORDER BY city LIMIT 2") == [("",), ("Oslo",)]
    assert engine.rows("SELECT city FROM people GROUP BY city LIMIT 0") == []


def test_order_of_mixed_text(engine):
    assert [r[0] for r in engine.rows("SELECT id FROM people ORDER BY age, id")] == ["2", "6", "7", "1", "4", "3", "5"]
    assert [r[0] for r in engine.rows("SELECT id FROM people ORDER BY age DESC, id")] == ["5", "3", "4", "1", "7", "2", "6"]


def test_joins(engine):
    rows = engine.rows("SELECT p.id, d.dept FROM people p JOIN depts d ON p.city = d.city WHERE d.dept != 'A' ORDER BY p.id")
    assert rows == [("2", "B"), ("4", "B"), ("5", "C"), ("6", "C"), ("7", "B")]
    df = engine.sql(f"SELECT * FROM {engine.path('people')} p JOIN {engine.path('depts')} d ON d.city = p.city")
    assert df.columns == ["id", "name", "age", "city", "note", "city", "dept"]
    for bad in ("SELECT city FROM people p JOIN depts d ON p.city = d.city", "SELECT x.id FROM people p JOIN depts d ON p.city = d.city"):
        with pytest.raises(QueryError):
            engine.rows(bad)


@pytest.mark.parametrize("sql", ["SELECT nope FROM people", "SELECT id FROM people WHERE nope = 1", "SELECT id, COUNT(*) FROM people", "SELECT id FROM people GROUP BY city", "SELECT NOPE(id) FROM people", "SELECT id FROM people ORDER BY 9", "SELECT id FROM 'missing'", "SELECT SUM(DISTINCT id) FROM people"])
def test_errors(engine, sql):
    with pytest.raises(QueryError):
        engine.rows(sql)


@pytest.mark.parametrize(
    ("expr", "value"),
    [
        ("UPPER(t)", "  AB C "), ("TRIM(t)", "aB c"), ("LENGTH(u)", 3), ("SUBSTR(w, 2, 3)", "bcd"), ("SUBSTR(w, 0, 2)", "ab"), ("SUBSTR(w, -3)", "def"), ("SUBSTR(w, -9, 3)", "abc"),
        ("ABS(n)", 7.5), ("CEIL(n)", -7.0), ("FLOOR(n)", -8.0), ("MOD(n, 3)", 1.5), ("MOD(n, 0)", None), ("ROUND(n)", -8), ("ROUND(m, 2)", 1.0), ("CAST(n AS INT)", -7), ("CAST(w AS INT)", None),
        ("COALESCE(blank, w)", "abcdef"), ("COALESCE(blank, 'x')", "x"), ("DATEDIFF('hour', d1, d2)", 20.5), ("DATEDIFF('day', d1, w)", 0.0), ("DATEDIFF('nope', d1, d2)", 0.0),
        ("DATEADD('day', 1, d1)", "2026-02-01 03:30:00"), ("DATEADD('month', 1, d1)", "2026-03-02 03:30:00"), ("DATEADD('day', 1, w)", "abcdef"),
        ("EXTRACT(month FROM d3)", 12), ("EXTRACT(day FROM d4)", 25), ("EXTRACT(hour FROM d5)", 13), ("EXTRACT(year FROM w)", 0), ("EXTRACT(minute FROM d1)", 30), ("STRFTIME('%Y-%m', d1)", "2026-01"), ("STRFTIME('%d.%m', d1)", "31.01"),
        ("UPPER(SUBSTR(w, 1, 2))", "AB"),
    ],
)
def test_scalars(spark, expr, value):
    columns = {"t": "  aB c ", "u": "é1", "w": "abcdef", "n": "-7.5", "m": "1.005", "blank": "  ", "d1": "2026-01-31T03:30:00Z", "d2": "2026-02-01 00:00:00.750", "d3": "12/25/2026", "d4": "25.12.2026 01:02", "d5": "20261225130000"}
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
    got = Engine(spark).register("x", df).sql(f"SELECT {expr} AS v FROM x").first()[0]
    assert got == value


def test_dates_that_do_not_exist(spark):
    df = spark.createDataFrame([("2026-02-30",), ("2026-13-01",), ("2026",), ("",), (None,)], "d string")
    assert {r[0] for r in Engine(spark).register("x", df).sql("SELECT EXTRACT(year FROM d) FROM x").collect()} == {0}


def test_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert [tuple(r) for r in Engine(spark).sql(f"SELECT a, b FROM '{tmp_path}/m.csv' ORDER BY a").collect()] == [("1", "x\ny"), ("2", "z")]


def test_partitions_do_not_matter(spark):
    df = spark.range(1000).selectExpr("cast(id % 7 as string) k", "cast(id as string) v")
    sql = "SELECT k, COUNT(v) AS n, SUM(v) AS s, MAX(v) AS m FROM x GROUP BY k ORDER BY s DESC LIMIT 3"
    found = [[tuple(r) for r in Engine(spark).register("x", df.repartition(n)).sql(sql).collect()] for n in (1, 9)]
    assert found[0] == found[1] and len(found[0]) == 3


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as string) t", "cast(id as double) x").write.parquet(f"{tmp_path}/p.parquet")
    e = Engine(spark, base=str(tmp_path))
    plan = e.sql("SELECT id FROM p WHERE id > 3 AND x <= 7.5 AND t LIKE '5%'")._jdf.queryExecution().toString()
    for part in ("GreaterThan(id,3)", "LessThanOrEqual(x,7.5)", "StringStar"):
        assert part in plan
    plan = e.sql("SELECT SUM(x) AS s FROM p")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<x:double>" in plan
    plan = e.sql("SELECT id FROM p ORDER BY x DESC LIMIT 3")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_text_output(spark):
    df = spark.createDataFrame([(1, 2.0, 'q"x', None), (2, 1e7, "a,b", "007"), (3, 1e-4, "l\nm", "5")], "i int, d double, s string, t string")
    e = Engine(spark).register("x", df)
    out = e.sql("SELECT i, d, s, t, CEIL(d) AS c FROM x ORDER BY i")
    assert text_of(out) == 'i,d,s,t,c\n1,2,"q""x",,2.0\n2,10000000,"a,b",007,10000000.0\n3,0.0001,"l\nm",5,1.0\n'
    assert text_of(out, header=False).startswith("1,2,")
    assert text_of(out, "jsonl").splitlines()[1] == '{"i":2,"d":10000000,"s":"a,b","t":"007","c":10000000.0}'
    assert text_of(e.sql("SELECT i FROM x WHERE i > 9"), "json") == "[]\n"
    assert text_of(e.sql("SELECT i, t FROM x WHERE i > 1"), "json") == '[\n{"i":2,"t":"007"},\n{"i":3,"t":5}\n]\n'
