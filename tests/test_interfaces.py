import io
import json

import pytest

import flatsql
from flatsql import Engine
from flatsql.cli import main
from flatsql.mcp import handle, serve
from flatsql.sinks.table import render_table
from flatsql.sinks.text import write_csv
from flatsql.streaming.query import csv_stream, start


@pytest.fixture
def people(tmp_path):
    path = tmp_path / "people.csv"
    path.write_text("name,age,city\nAnn,30,Rome\nBob,20,Oslo\nCid,45,Rome\n")
    return path


def run(*args, stdin=""):
    out, err = io.StringIO(), io.StringIO()
    return main(list(args), io.StringIO(stdin), out, err), out.getvalue(), err.getvalue()


def test_command_line(spark, people):
    assert run(f"SELECT name FROM '{people}' WHERE age > 25 ORDER BY name")[1] == "name\nAnn\nCid\n"
    assert run(str(people), "name,age", "age>25", "5", "age:desc")[1] == "name,age\nCid,45\nAnn,30\n"
    assert run(f"SELECT name FROM '{people}' LIMIT 1", "--no-header")[1] == "Ann\n"
    assert run("SELECT a FROM '-' WHERE b = 2", "-d", "\\t", stdin="a\tb\nx\t1\ny\t2\n")[1] == "a\ny\n"
    assert json.loads(run(f"SELECT name, age FROM '{people}' ORDER BY age", "--json")[1])[0] == {"name": "Bob", "age": 20}
    assert run(stdin=f"SELECT COUNT(*) AS n FROM '{people}'")[1] == "n\n3\n"
    assert "│ Rome" in run(f"SELECT city FROM '{people}'", "--table")[1]
    code, out, err = run(f"SELECT nope FROM '{people}'")
    assert code == 1 and out == "" and "nope" in err
    code, out, _ = run("--schema", str(people))
    assert code == 0 and "Rows: 3" in out and "INTEGER" in out and "TEXT" in out and "Size: 50 B" in out


def test_library(spark, people):
    sql = f"SELECT city, COUNT(*) AS n FROM '{people}' GROUP BY city ORDER BY n DESC"
    assert flatsql.query(sql) == [{"city": "Rome", "n": 2}, {"city": "Oslo", "n": 1}]
    assert flatsql.query_tuples(sql) == (["city", "n"], [("Rome", 2), ("Oslo", 1)])
    assert flatsql.query_csv(sql) == "city,n\nRome,2\nOslo,1\n"
    assert list(flatsql.query_df(sql).columns) == ["city", "n"]


def test_tools(spark, people):
    call = lambda n, m, **p: handle({"jsonrpc": "2.0", "id": n, "method": m, "params": p})
    assert call(1, "initialize")["result"]["capabilities"] == {"tools": {}}
    assert [t["name"] for t in call(2, "tools/list")["result"]["tools"]] == ["csv_query", "csv_schema", "csv_list"]
    got = call(3, "tools/call", name="csv_query", arguments={"sql": f"SELECT age FROM '{people}' WHERE name = 'Bob'"})["result"]
    assert json.loads(got["content"][0]["text"]) == [{"age": 20}] and not got["isError"]
    assert call(4, "tools/call", name="csv_query", arguments={"sql": "SELECT"})["result"]["isError"]
    assert len(json.loads(call(5, "tools/call", name="csv_schema", arguments={"file": str(people)})["result"]["content"][0]["text"])) == 3
    assert json.loads(call(6, "tools/call", name="csv_list", arguments={"directory": str(people.parent)})["result"]["content"][0]["text"]) == ["people.csv"]
    assert call(7, "tools/call", name="nope")["error"]["code"] == -32602
    assert call(8, "tools/call", name="csv_query", arguments={})["error"]["code"] == -32602
    assert call(9, "nope")["error"]["code"] == -32601
    assert handle({"jsonrpc": "2.0", "method": "notifications/initialized"}) is None
    out = io.StringIO()
    serve(io.StringIO('{"jsonrpc":"2.0","id":1,"method":"ping"}\nnot json\n\n'), out)
    assert [json.loads(x).get("result", "error") for x in out.getvalue().splitlines()] == [{}, "error"]


def test_tables():
    assert render_table(["a", "bb"], [["1", "2"], ["3", "é"]]) == "┌───┬────┐\n│ a │ bb │\n├───┼────┤\n│ 1 │ 2  │\n├───┼────┤\n│ 3 │ é  │\n└───┴────┘\n"
    assert render_table(["a"], [["x"]], "markdown") == "| a |\n|---|\n| x |\n"
    cut = render_table(["aaaa", "bbbb", "cccc"], [["1", "2", "3"]], "ascii", width=20)
    assert "+1" in cut and "…" in cut and "cccc" not in cut and max(map(len, cut.splitlines())) <= 20
    wrapped = render_table(["aaaa", "b"], [["x" * 30, "2"]], "ascii", width=20, wrap=True)
    assert wrapped.count("xxx") > 1 and max(map(len, wrapped.splitlines())) <= 20
    with pytest.raises(ValueError):
        render_table(["a"], [], "nope")


def test_large_output_is_written_by_executors(spark, tmp_path):
    write_csv(spark.createDataFrame([(1, 2.0), (2, None)], "a int, b double"), f"{tmp_path}/out")
    assert sorted(tuple(r) for r in Engine(spark).sql(f"SELECT * FROM '{tmp_path}/out/*.csv'").collect()) == [("1", "2"), ("2", "")]


def test_profile(spark, tmp_path):
    (tmp_path / "t.csv").write_text("i,f,t,e\n1,1.5,x,\n2,2,,\n")
    assert [(c["type"], c["non_empty"], c["empty"]) for c in Engine(spark).profile(f"{tmp_path}/t.csv")] == [("INTEGER", 2, 0), ("FLOAT", 2, 0), ("TEXT", 1, 1), ("TEXT", 0, 2)]


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("k,v\nx,1\ny,2\nx,3\n")
    source = csv_stream(spark, str(folder), ["k", "v"])
    for name, sql, rows in (
        ("plain", "SELECT UPPER(k) AS k, v FROM '-' WHERE v > 1", {("Y", "2"), ("X", "3")}),
        ("seen", "SELECT DISTINCT k FROM '-'", {("x",), ("y",)}),
        ("grouped", "SELECT k, COUNT(*) AS n, SUM(v) AS s FROM '-' GROUP BY k", {("x", 2, 4.0), ("y", 1, 2.0)}),
    ):
        query = start(Engine(spark), sql, source, f"stream_{name}", checkpoint=f"{tmp_path}/{name}")
        query.awaitTermination(120)
        assert {tuple(r) for r in spark.table(f"stream_{name}").collect()} == rows


def test_streams_of_aggregates(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    source = csv_stream(spark, str(folder), ["k", "v"])
    for name, sql, rows in (
        ("all", "SELECT COUNT(*) AS n, SUM(v) AS s FROM '-'", [{(2, 3.0)}, {(3, 6.0)}]),
        ("kept", "SELECT k FROM '-' WHERE v > 1", [{("y",)}, {("y",), ("z",)}]),
    ):
        for file, text, want in (("a", "k,v\nx,1\ny,2\n", rows[0]), ("b", "k,v\nz,3\n", rows[1])):
            (folder / f"{file}.csv").write_text(text)
            start(Engine(spark), sql, source, f"sink_{name}", checkpoint=f"{tmp_path}/{name}-state", path=f"{tmp_path}/{name}").awaitTermination(120)
            assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()} == want
        for file in "ab":
            (folder / f"{file}.csv").unlink()


def test_piped_input_has_the_rows_of_a_file(spark, tmp_path):
    text = "k,v\n" + "".join(f'{n},"{"é" * 90}\nx"\n' for n in range(20_000))
    (tmp_path / "f.csv").write_text(text)
    sql = "SELECT COUNT(*) AS n, MIN(k) AS lo, MAX(LENGTH(v)) AS hi FROM {}"
    assert run(sql.format("'-'"), stdin=text)[1] == run(sql.format(f"'{tmp_path}/f.csv'"))[1] == "n,lo,hi\n20000,0,182\n"


def test_schemas_of_changed_tables(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(2).selectExpr("id p", "id a").write.partitionBy("p").parquet(path)
    assert Engine(spark).sql(f"SELECT * FROM '{path}'").columns == ["a", "p"]
    spark.range(2).selectExpr("id p", "id b").write.partitionBy("p").mode("overwrite").parquet(path)
    assert Engine(spark).sql(f"SELECT * FROM '{path}'").columns == ["b", "p"]


def test_quoted_line_breaks_at_every_size(spark, tmp_path):
    from flatsql.sources.csv import read_csv

    folder = tmp_path / "large"
    folder.mkdir()
    with open(folder / "b.csv", "w") as file:
        file.write("k,v\n" + f"a,{'x' * 990}\n" * 9000 + 'b,"one\ntwo"\n')
    (folder / "a.csv").write_text("k,v\nc,d\n")
    for path, rows in ((folder / "b.csv", 9001), (folder, 9002)):
        df = read_csv(spark, str(path))
        assert df.count() == rows and df.where("k = 'b'").first()["v"] == "one\ntwo"
    small = tmp_path / "stream"
    small.mkdir()
    (small / "a.csv").write_text('k,v\nb,"one\ntwo"\n')
    query = csv_stream(spark, str(small), ["k", "v"]).writeStream.format("memory").queryName("breaks").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("breaks").collect()] == [("b", "one\ntwo")]


def test_tables_show_all_rows(spark, tmp_path):
    (tmp_path / "many.csv").write_text("n\n" + "".join(f"{n}\n" for n in range(10_050)))
    code, out = run(f"SELECT n FROM '{tmp_path / 'many.csv'}'", "--table", "none")[:2]
    assert code == 0 and "10049" in out and sum(x.strip().isdigit() for x in out.splitlines()) == 10_050
