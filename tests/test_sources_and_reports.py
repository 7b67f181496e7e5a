import csv
import datetime as dt
import io
import json
import os
import sqlite3
import subprocess
import sys
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe import xlsx
from tallyframe.cli import main
from tallyframe.config import ConfigError, ReconConfig
from tallyframe.functions.rules import Rule, first_number, parse_rule
from tallyframe.operators.reconcile import reconcile, reconcile_remote
from tallyframe.sinks import summary_lines, write_csv, write_json, write_tables, write_workbook
from tallyframe.sources import CsvSource, ExcelSource, JdbcSource, ParquetSource, SqliteSource, connection_url, open_connection, open_source
from tallyframe.sources.base import sample, schema
from tallyframe.sources.paths import clean_path
from tallyframe.sources.sql import remote_join
from tallyframe.streaming import reconcile_stream
from tallyframe.suggest import by_similar_names, suggest_mapping, suggest_rule
from tallyframe.templates import read_template, write_template


@pytest.fixture
def pair(tmp_path):
    (tmp_path / "a.csv").write_text('id,zip,price,day,flag,note\n1,007,1.5,2024-01-02,true,"x, y"\n2,123,NA,2024-02-03,false,\n3,5,2,null,True,N/A\n')
    (tmp_path / "b.CSV").write_text('num,zip,cost,day,flag,note\n1,007,1.5,2024-01-02,true,"x, y"\n2,124,NULL,2024-02-03,false,\n4,5,2,,true,z\n')
    return str(tmp_path / "a.csv"), str(tmp_path / "b.CSV")


def test_csv_types_and_nulls(spark, pair):
    df = CsvSource(pair[0]).load(spark)
    assert df.dtypes == [("id", "bigint"), ("zip", "string"), ("price", "double"), ("day", "date"), ("flag", "boolean"), ("note", "string")]
    rows = df.collect()
    assert rows[1]["price"] is None and rows[2]["day"] is None and rows[0]["zip"] == "007" and rows[0]["note"] == "x, y" and rows[2]["note"] is None
    assert {t for _, t in CsvSource(pair[0], all_strings=True, null_tokens=()).load(spark).dtypes} == {"string"}
    assert CsvSource(pair[0], keep_strings=("id",)).load(spark).dtypes[0] == ("id", "string")
    assert CsvSource(pair[0], schema="id int, zip string, price string, day string, flag string, note string").load(spark).dtypes[0] == ("id", "int")


def test_cells_with_line_breaks(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,note\n1,"two\nlines"\n2,"say ""hi"""\n')
    rows = CsvSource(str(tmp_path / "m.csv"), multi_line=True).load(spark).collect()
    assert [(r["id"], r["note"]) for r in rows] == [(1, "two\nlines"), (2, 'say "hi"')]


def test_an_empty_file_of_rows(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,v\n")
    df = CsvSource(str(tmp_path / "e.csv")).load(spark)
    assert df.columns == ["id", "v"] and df.count() == 0


def test_open_source(spark, pair, tmp_path):
    assert isinstance(open_source("x.PARQUET"), ParquetSource) and isinstance(open_source("x.xlsx"), ExcelSource)
    assert sample(open_source(pair[1]), spark, 2).count() == 2
    assert schema(open_source(pair[1]), spark)["num"] == "bigint"
    buffer = io.BytesIO(b"a,b\n1,2\n")
    buffer.read()
    assert open_source(buffer, "up.csv", str(tmp_path)).load(spark).count() == 1
    with pytest.raises(ValueError, match="Unsupported"):
        open_source("x.docx")


def test_paths():
    assert clean_path("‪\"/tmp//a/../b.csv\" ") == "/tmp/b.csv"
    assert clean_path("s3://bucket//x") == "s3://bucket//x"


@pytest.mark.parametrize("text, rule", [("within 0.5", Rule("absolute", 0.5)), ("+/- 1,000", Rule("absolute", 1000)), ("tolerance 5 %", Rule("percent", 5)), ("Case insensitive", Rule("ignore_case")), ("", Rule("strict")), ("within reason", Rule("strict", understood=False)), ("+/-5", Rule("absolute", 5)), ("within .5", Rule("absolute", 0.5))])
def test_rules(text, rule):
    assert parse_rule(text) == rule


@pytest.mark.parametrize("text, number", [("within $5", 5), ("within 5%", 5), ("within 0.5", None), ("+/-5", None), ("within 1,000", None), ("within 5.", None)])
def test_legacy_numbers(text, number):
    assert first_number(text, legacy=True) == number


def test_urls():
    assert connection_url("PostgreSQL", "h", "d b") == "jdbc:postgresql://h:5432/d%20b"
    assert connection_url("SQL Server", "h", "d}x", 99) == "jdbc:sqlserver://h:99;databaseName={d}}x};encrypt=true"
    assert connection_url("oracle", "h", "svc") == "jdbc:oracle:thin:@//h:1521/svc"
    assert connection_url("snowflake", "acc", "db", warehouse="w&h") == "jdbc:snowflake://acc.snowflakecomputing.com/?db=db&warehouse=w%26h"
    assert connection_url("sqlite", database="/x.db") == "sqlite:////x.db"
    with pytest.raises(ValueError):
        connection_url("mystery")


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE staff (emp_id TEXT, n INTEGER, salary REAL, status TEXT)")
        db.executemany("INSERT INTO staff VALUES (?, ?, ?, ?)", [("E1", 1, 10.0, "Active"), ("E2", 2, 20.5, None), ("E3", 30, 30.0, "On Leave")])
    return path


def test_sqlite(spark, database):
    df = SqliteSource(database, "SELECT * FROM staff;").load(spark)
    assert df.dtypes == [("emp_id", "string"), ("n", "bigint"), ("salary", "double"), ("status", "string")]
    assert sorted(map(tuple, df.collect())) == [("E1", 1, 10.0, "Active"), ("E2", 2, 20.5, None), ("E3", 30, 30.0, "On Leave")]
    split = SqliteSource(database, "SELECT * FROM staff", partition_column="n", partitions=4).load(spark)
    assert split.rdd.getNumPartitions() == 4 and split.count() == 3
    assert open_connection(f"sqlite:///{database}", "SELECT count(*) AS c FROM staff").load(spark).first()["c"] == 3


def test_mixed_sources(spark, database, tmp_path):
    (tmp_path / "x.csv").write_text("emp_id,salary,status\nE1,10.0,Active\nE3,30,Active\nE9,1.0,Active\n")
    found = reconcile(SqliteSource(database, "SELECT * FROM staff").load(spark), open_source(str(tmp_path / "x.csv")).load(spark), ReconConfig.of("emp_id", {"salary": "salary", "status": "status"}))
    s = found.summary().first()
    assert (s["only_in_1"], s["only_in_2"], s["mismatched_rows"], s["exact_rows"]) == (1, 1, 1, 1)


def test_jdbc(spark, tmp_path):
    url = connection_url("derby", database=f"{tmp_path}/derby;create=true")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string").write.format("jdbc").options(url=url, dbtable="t", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    df = JdbcSource(url, 'SELECT "k", "v" FROM t;').load(spark).filter("k > 1")
    assert [r[0] for r in df.orderBy(df.columns[0]).collect()] == [2, 3]
    assert "PushedFilters: [" in df._jdf.queryExecution().executedPlan().toString()
    split = JdbcSource(url, 'SELECT "k", "v" FROM t', partition_column='k', lower=1, upper=4, partitions=3).load(spark)
    assert split.rdd.getNumPartitions() == 3 and split.count() == 3


def test_jdbc_on_a_cluster(sf_dir, tmp_path):
    """Executors are other processes than the driver, which has the database made, and have folders of their own for what is temporary."""
    import pyspark

    script = """
import sys
from pyspark.sql import SparkSession
from tallyframe.plans.io_queries import QUERIES
_, sf_dir, shared = sys.argv
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + shared).getOrCreate()
rows = QUERIES["jdbc_scan"](spark, sf_dir).collect()
print("found", len(rows), max(r["n_regionkey"] for r in rows))
"""
    home, real = tmp_path / "home", os.path.dirname(pyspark.__file__)  # executors log into a folder of Spark's home
    (home / "work").mkdir(parents=True)
    for name in set(os.listdir(real)) - {"work"}:
        (home / name).symlink_to(f"{real}/{name}")
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    for name in [n for n in env if n.startswith("PYSPARK_") and n != "PYSPARK_PYTHON"]:
        del env[name]
    done = subprocess.run([sys.executable, "-c", script, sf_dir, str(tmp_path / "shared")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=150)
    assert "found 15 2" in done.stdout, done.stderr[-2000:]
    assert os.listdir(tmp_path / "shared")


def test_remote_join_text():
    query = remote_join("SELECT 1;", "SELECT 2", [("a", "b")], [("v", 'w"x')])
    assert 'ON a."a" = b."b"' in query and 'b."w""x" AS v02' in query and 'a."a" AS k01' in query


def test_join_in_the_database(spark, database):
    config = ReconConfig.of("emp_id", [("emp_id", "emp_id"), ("salary", "salary", "within 1"), ("status", "status")])
    second = "SELECT emp_id, salary + 0.5 AS salary, lower(status) AS status FROM staff WHERE n > 1 UNION ALL SELECT 'E7', 1.0, 'x'"
    found = reconcile_remote(spark, f"sqlite:///{database}", "SELECT * FROM staff", second, config)
    s = found.summary().first()
    assert (s["total_rows_1"], s["total_rows_2"], s["only_in_1"], s["only_in_2"], s["mismatched_rows"], s["exact_rows"]) == (3, 3, 1, 1, 2, 0)
    assert sorted(r["Primary Key"] for r in found.breakdown.collect()) == ["emp_id=E2", "emp_id=E3"]
    assert [r["emp_id"] for r in found.only_in_1.collect()] == ["E1"]


def test_join_in_the_database_is_no_loop_over_pairs(tmp_path):
    """SQLite looks rows up in an index, on both sides, and one run of a query tells the kinds of all its computed columns."""
    from tallyframe.sources.sql import SqliteDataSource

    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (k INTEGER, v REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i if i % 100 else None, i / 2) for i in range(60_000)])
        second = "SELECT k + 0 AS id, v + (k % 2) AS w FROM t WHERE k % 10 <> 9 OR k IS NULL UNION ALL SELECT k, v FROM t WHERE k % 1000 = 1 UNION ALL SELECT -k, 0.5 FROM t WHERE k % 10 = 1"
        joined = remote_join("SELECT * FROM t;", second, [("k", "id")], [("v", "w")], sqlite=True)
        steps = 0

        def step():
            nonlocal steps
            steps += 1
            return steps > 4_000  # of 10,000 instructions; a loop over pairs takes billions

        db.set_progress_handler(step, 10_000)
        counts = dict(((a, b), n) for a, b, n in db.execute(f"SELECT p1, p2, count(*) FROM ({joined}) GROUP BY 1, 2"))
        db.set_progress_handler(None, 0)
        odd = "SELECT 1 AS n UNION ALL SELECT '012' UNION ALL SELECT 'b ' UNION ALL SELECT x'61' UNION ALL SELECT '1e2' UNION ALL SELECT NULL"
        for kind in ("TEXT", "TEXT COLLATE NOCASE", "TEXT COLLATE RTRIM", "INTEGER", "REAL", "BLOB"):
            name = kind.replace(" ", "_")
            db.execute(f"CREATE TABLE {name} (n {kind})")
            db.executemany(f"INSERT INTO {name} VALUES (?)", [(v,) for v in (1, "1", "12", 12, "012", "A", "a", b"a", "b", "B ", 100.0, "1E2", 2**53 + 1, 2.0**53, str(2**63), None)])
        for x, y in [(x, y) for x in ("TEXT", "TEXT_COLLATE_NOCASE", "TEXT_COLLATE_RTRIM", "INTEGER", "REAL", "BLOB", f"({odd})") for y in ("TEXT", "TEXT_COLLATE_NOCASE", "INTEGER", f"({odd})")]:
            args = (f"SELECT * FROM {x}", f"SELECT * FROM {y}", [("n", "n")], [("n", "n")])
            rows = [sorted(map(repr, db.execute(remote_join(*args, sqlite=way)))) for way in (False, True)]
            assert rows[0] == rows[1], (x, y)
    keys = [i for i in range(60_000) if i % 100]
    both = [i for i in keys if i % 10 != 9]
    again, minus = [i for i in keys if i % 1000 == 1], [i for i in keys if i % 10 == 1]
    assert counts == {(1, 1): len(both) + len(again), (1, None): 600 + len(keys) - len(both), (None, 1): 600 + len(minus)}
    kinds = dict(zip(*SqliteDataSource({"path": path, "query": "SELECT k + 1 AS a, v AS b, 'x' AS c, CASE WHEN k = 2 THEN 1.5 ELSE 1 END AS d, NULL AS e, x'00' AS f FROM t"})._names()))
    assert kinds == {"a": "bigint", "b": "double", "c": "string", "d": "double", "e": "string", "f": "string"}


def test_a_database_that_folds_names(spark, database, monkeypatch):
    """Names that come back in capitals are found all the same."""
    from tallyframe.sources import sql

    usual = sql.open_connection

    class Folded:
        def __init__(self, url, query):
            self.source, self.inner = usual(url, query), " AS p1" in query or "only_in_1" in query

        def load(self, spark):
            df = self.source.load(spark)
            return df.toDF(*[c.upper() for c in df.columns]) if self.inner else df

    monkeypatch.setattr(sql, "open_connection", Folded)
    config = ReconConfig.of("emp_id", {"status": "status"})
    for checks in ("spark", "database"):
        s = reconcile_remote(spark, f"sqlite:///{database}", "SELECT * FROM staff", "SELECT * FROM staff WHERE n < 30", config, checks=checks).summary().first()
        assert (s["only_in_1"], s["only_in_2"], s["mismatched_rows"], s["exact_rows"]) == (1, 0, 1, 1)


def test_checks_in_the_database(spark, database):
    config = ReconConfig.of("emp_id", [("emp_id", "emp_id"), ("salary", "salary", "within 1"), ("status", "status", "ignore case")])
    second = "SELECT emp_id, salary + 0.5 AS salary, lower(status) AS status FROM staff WHERE n > 1 UNION ALL SELECT 'E7', 1.0, 'x'"
    args = (spark, f"sqlite:///{database}", "SELECT * FROM staff", second, config)
    here, there = reconcile_remote(*args), reconcile_remote(*args, checks="database")
    assert here.summary().first() == there.summary().first()
    for bucket in ("mismatches", "exact", "matched", "breakdown", "differences", "classified", "only_in_1", "only_in_2"):
        assert sorted(map(str, getattr(here, bucket).collect())) == sorted(map(str, getattr(there, bucket).collect())), bucket
    assert [r["emp_id"] for r in there.mismatches.collect()] == ["E2"] and [r["emp_id"] for r in there.exact.collect()] == ["E3"]
    assert there.row_counts().first()["row_count_difference"] == 0
    percent = ReconConfig.of("emp_id", [("salary", "salary", "within 2%")])
    assert [r["emp_id"] for r in reconcile_remote(*args[:4], percent, checks="database").mismatches.collect()] == ["E2"]
    with pytest.raises(ConfigError):
        reconcile_remote(*args, profile="typed", checks="database")


def config():
    return ReconConfig.of("id", [("id", "num"), ("zip", "zip"), ("price", "cost", "within 1"), ("day", "day")])


def found(spark, pair):
    return reconcile(open_source(pair[0]).load(spark), open_source(pair[1]).load(spark), config())


def test_reports(spark, pair, tmp_path):
    result = found(spark, pair)
    paths = write_csv(result, tmp_path / "out", exact=True)
    assert sorted(paths) == ["exact_matches", "mismatches", "only_in_file1", "only_in_file2"]
    rows = list(csv.DictReader(open(paths["mismatches"])))
    assert [(r["Primary Key"], r["Column"], r["File 1 Value"], r["File 2 Value"]) for r in rows] == [("id=2", "zip -> zip", "123", "124")]
    report = json.loads(write_json(result, tmp_path / "out" / "deep" / "r.json").read_text())
    assert report["mismatches"]["rows"][0]["primary_keys"] == {"id": 2} and report["summary"]["exact_rows"] == 1
    assert len(report["missing_in_file1"]["rows"]) == len(report["missing_in_file2"]["rows"]) == 1 and not report["mismatches"]["truncated"]
    tables = write_tables(result, str(tmp_path / "tables"))
    assert spark.read.parquet(tables["only_in_file2"]).first()["id"] == 4
    write_tables(result, str(tmp_path / "csvs"), "csv")
    assert summary_lines(result)[-1].startswith("Exact")
    same = reconcile(result.df1, result.df1, ReconConfig.of("id"))
    assert summary_lines(same)[-1].startswith("SUCCESS") and write_csv(same, tmp_path / "none") == {}


def test_json_has_all_rows_unless_told_otherwise(spark, tmp_path):
    one = spark.range(25_000).selectExpr("id", "id as v")
    result = reconcile(one, one.selectExpr("id + 12500 as id", "-v as v"), ReconConfig.of("id", {"v": "v"}))
    report = json.loads(write_json(result, tmp_path / "all.json").read_text())
    assert [len(report[k]["rows"]) for k in ("missing_in_file1", "missing_in_file2", "mismatches")] == [12_500] * 3
    part = json.loads(write_json(result, tmp_path / "some.json", rows=10).read_text())
    assert len(part["mismatches"]["rows"]) == 10 and part["mismatches"]["truncated"]


def test_workbooks(spark, pair, tmp_path):
    path = write_workbook(found(spark, pair), tmp_path / "deep" / "x.xlsx")
    assert xlsx.sheet_names(path) == ["summary", "mismatches", "only_in_file1", "only_in_file2", "exact_matches"]
    sheet = ExcelSource(str(path), "mismatches").load(spark)
    assert [(r["Primary Key"], r["Column"], r["File 1 Value"], r["File 2 Value"]) for r in sheet.collect()] == [("id=2", "zip -> zip", "123", "124")]
    assert ExcelSource(str(path)).load(spark).first()["exact_rows"] == 1
    with pytest.raises(ValueError, match="no sheet"):
        ExcelSource(str(path), "nothing").load(spark)
    (tmp_path / "old.xls").write_bytes(b"\xd0\xcf\x11\xe0")
    with pytest.raises(ValueError, match="no workbook"):
        open_source(str(tmp_path / "old.xls")).load(spark)


def test_a_long_bucket_goes_on_in_another_sheet(tmp_path, monkeypatch):
    monkeypatch.setattr(xlsx, "MOST_ROWS", 4)
    path = xlsx.write_workbook(tmp_path / "l.xlsx", [("a/b", ["n"], ([i] for i in range(8))), ("c", ["n"], [])])
    assert xlsx.sheet_names(path) == ["a_b", "a_b (2)", "a_b (3)", "c"]
    assert [r[0] for k in range(3) for r in list(xlsx.read_sheet(path, k))[1:]] == list(range(8))
    with pytest.raises(ValueError, match="characters"):
        xlsx.write_workbook(tmp_path / "t.xlsx", [("a", ["n"], [["x" * 40_000]])])


def test_sheets_of_others(spark, tmp_path):
    """Shared strings, dates by their style, gaps, errors, repeated headers: what other programs write."""
    path, main = tmp_path / "o.xlsx", xlsx._MAIN
    cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>1</v></c></row>'
    cells += '<row r="2"><c r="A2"><v>1</v></c><c r="B2" s="1"><v>45292</v></c><c r="C2" t="e"><v>#N/A</v></c><c r="D2" t="b"><v>1</v></c></row>'
    cells += '<row r="4"><c r="A4"><v>2.0</v></c><c r="B4" s="2"><v>45292.5</v></c><c r="D4" t="str"><v>x</v></c></row>'
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{xlsx._OFFICE}"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{xlsx._PACKAGE}/relationships"><Relationship Id="rId7" Target="/xl/worksheets/s.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>id</t></si><si><r><t>wh</t></r><r><t>en</t></r></si></sst>')
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    df = open_source(str(path)).load(spark)
    assert df.dtypes == [("id", "bigint"), ("when", "timestamp_ntz"), ("Column 3", "string"), ("when.1", "string")]
    rows = [tuple(r) for r in df.collect()]
    assert rows == [(1, dt.datetime(2024, 1, 1), None, "True"), (2, dt.datetime(2024, 1, 1, 12), None, "x")]


def test_rows_of_empty_texts_are_blank(tmp_path):
    rows = [[None, None, ""], ["", "x", None], [0, None, ""], ["", "", ""], [False, None, None]]
    path = xlsx.write_workbook(tmp_path / "r.xlsx", [("s", ["", "", ""], rows)])
    assert list(xlsx.read_sheet(path)) == [["", "", ""], ["", "x"], [0, None, ""], [False]]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.booleans(), st.integers(-(10**14), 10**14), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=30)), min_size=3, max_size=3), max_size=8))
def test_workbook_round_trip(rows):
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        path = xlsx.write_workbook(f"{folder}/r.xlsx", [("s", ["a", "b", "c"], rows)])
        head, *found = xlsx.read_sheet(path)
    plain = lambda v: None if v == "" else v.replace("\r\n", "\n").replace("\r", "\n") if isinstance(v, str) else v
    want = [[plain(v) for v in r] for r in rows]
    got = [[plain(v) for v in [*r, None, None, None][:3]] for r in found]
    assert head == ["a", "b", "c"] and got == [r for r in want if any(v is not None for v in [None if x is None else x for x in r])]


def test_blanks_in_cells_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,n\n1,Bob, 5\n2,Amy,6 \n3,  , 7\n")
    (tmp_path / "b.csv").write_text("id,name,n\n1,Bob  ,5\n2,  Amy,6\n3,NA,7\n")
    a, b = (open_source(str(tmp_path / f"{x}.csv")).load(spark) for x in "ab")
    assert [r["name"] for r in b.orderBy("id").collect()] == ["Bob  ", "  Amy", None] and a.dtypes[2] == ("n", "bigint")
    s = reconcile(a, b, ReconConfig.of("id", {"name": "name", "n": "n"})).summary().first()
    assert (s["mismatched_rows"], s["exact_rows"]) == (2, 1)


def test_types_from_a_sample(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,v\n1,1\n2,2\n3,x\n")
    assert CsvSource(str(tmp_path / "s.csv")).load(spark).dtypes[1] == ("v", "string")
    sampled = CsvSource(str(tmp_path / "s.csv"), sample_rows=2).load(spark)
    assert sampled.dtypes[1] == ("v", "bigint")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sampled.collect()


def test_templates(tmp_path):
    path = write_template(config(), tmp_path / "t.csv")
    assert read_template(path) == read_template(write_template(config(), tmp_path / "t.xlsx")) == config()
    (tmp_path / "u.csv").write_text("File 1 Column,File 2 Column,Validation Rule (Optional)\na,x,nan\nb,,\nnan,y,\nc,None,r\n")
    read = read_template(tmp_path / "u.csv")
    assert [(m.file1_column, m.validation_rule) for m in read.column_mappings] == [("a", None)] and read.primary_keys == []
    (tmp_path / "v.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ConfigError):
        read_template(tmp_path / "v.csv")


def test_config_files(tmp_path):
    config().dump(tmp_path / "c.json")
    assert ReconConfig.load(tmp_path / "c.json") == config()
    with pytest.raises(ConfigError):
        ReconConfig.from_dict({"primary_keys": []})


def test_suggestions(spark, pair):
    a, b = open_source(pair[0]).load(spark), open_source(pair[1]).load(spark)
    answer = '```json\n{"primary_keys": ["id"], "column_mappings": [{"file1_column": "id", "file2_column": "num", "validation_rule": null}]}\n```'
    seen = []
    assert suggest_mapping(a, b, lambda p: seen.append(p) or answer).second_name("id") == "num"
    assert "007" in seen[0]
    for wrong in ("{}", "no", '{"primary_keys": ["zzz"], "column_mappings": []}'):
        with pytest.raises(ConfigError):
            suggest_mapping(a, b, lambda p, w=wrong: w)
    with pytest.raises(RuntimeError):
        suggest_mapping(a, b, lambda p: 1 / 0)
    assert by_similar_names(a, b, ["id"]).second_name("day") == "day"
    assert suggest_rule("price at most 5 more", ["price"], lambda p: "price_f2 - price_f1 <= 5") == "price_f2 - price_f1 <= 5"
    with pytest.raises(ConfigError):
        suggest_rule("x", ["price"], lambda p: "java_method('a', 'b')")


def test_cli(spark, pair, tmp_path, capsys):
    config().dump(tmp_path / "c.json")
    assert main([pair[0], pair[1], "--config", str(tmp_path / "c.json"), "--output", str(tmp_path / "o")]) == 0
    assert "Mismatched rows: 1" in capsys.readouterr().out
    assert (tmp_path / "o" / "validation_report.json").exists()
    write_template(config(), tmp_path / "t.csv")
    assert main([pair[0], pair[1], "--template", str(tmp_path / "t.csv"), "--output", str(tmp_path / "p"), "--profile", "text"]) == 0
    assert main([pair[0], pair[0], "--auto", "id", "--output", str(tmp_path / "q")]) == 0
    assert "SUCCESS" in capsys.readouterr().out


def test_stream(spark, tmp_path):
    reference = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    spark.createDataFrame([(1, "a"), (2, "x"), (3, "c")], "k long, v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v string").parquet(str(tmp_path / "in"))
    query = reconcile_stream(reference, stream, ReconConfig.of("k", {"v": "v"}), str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
    query.awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["k"], r["_status"]) for r in rows) == [(1, "exact"), (2, "mismatch"), (3, "only_in_2")]
