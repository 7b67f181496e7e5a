"""Queries over sources, sinks, mappings and rules that a person brings, each with equivalent SQL.

What they write goes to a folder of its own under spark.checkpoint.dir, or where that is unset, in a local session, under a
temporary one.
"""

from __future__ import annotations

import csv
import datetime as dt
import json
import os
import re
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.config import ReconConfig, positional_mapping
from tallyframe.operators.align import quoted
from tallyframe.operators.reconcile import ReconResult, reconcile, reconcile_remote
from tallyframe.sinks import write_csv, write_json, write_tables, write_workbook
from tallyframe.sources import CsvSource, ExcelSource, JdbcSource, SqliteSource, connection_url, open_source
from tallyframe.sources.base import sample, schema
from tallyframe.sources.urls import driver_of
from tallyframe.streaming import reconcile_stream
from tallyframe.suggest import by_similar_names, suggest_mapping, suggest_rule
from tallyframe.templates import read_template, write_template


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder, as a URL or path, that executors see."""
    found = spark.conf.get("spark.checkpoint.dir", "") or tempfile.gettempdir()
    return f"{found.rstrip('/')}/tallyframe-io-{uuid.uuid4().hex}"


def file_folder(spark: SparkSession) -> str:
    """A new folder, as a path, for databases that the driver makes and tasks read as files when the query runs."""
    path = urlparse(shared_folder(spark))
    if path.scheme not in ("", "file"):
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must be a folder that is mounted on all machines, as databases in files are no use in {path.scheme}:")
        return tempfile.mkdtemp(prefix="tallyframe-io-")
    os.makedirs(path.path)
    return path.path


def passing_folder() -> tempfile.TemporaryDirectory:
    """A folder for files that the driver writes and reads at once."""
    return tempfile.TemporaryDirectory(prefix="tallyframe-io-")


def _as_csv(spark: SparkSession, df: DataFrame) -> str:
    path = shared_folder(spark)
    writer = df.write.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.csv(path)
    return path


def _padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with blanks about some priorities, and NA for others."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    text = F.when(k % 7 == 0, F.concat(p, F.lit("  "))).when(k % 11 == 0, F.concat(F.lit(" "), p)).when(k % 13 == 0, F.lit("NA")).otherwise(p)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", text.alias("o_orderpriority"), "o_totalprice")


def _csv_blanks(s: SparkSession, d: str) -> DataFrame:
    read = CsvSource(_as_csv(s, _padded(s, d))).load(s)
    config = ReconConfig.of("o_orderkey", {"o_orderpriority": "o_orderpriority"})
    return reconcile(table(s, d, "orders"), read, config).mismatches.select("o_orderkey", "File2_o_orderpriority")


def _csv_types(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders")
    made = orders.select("o_orderkey", "o_totalprice", F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("code"), (F.col("o_orderkey") % 2 == 0).alias("even"), "o_orderpriority", F.lit("null").alias("nothing"))
    return s.createDataFrame(sorted(schema(CsvSource(_as_csv(s, made)), s).items()), "column string, type string")


def _customers(s: SparkSession, d: str) -> str:
    """An SQLite file with the customers, that the driver makes."""
    path = os.path.join(file_folder(s), "t.db")
    rows = table(s, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double"), "c_mktsegment")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE customer (c_custkey INTEGER, c_name TEXT, c_acctbal REAL, c_mktsegment TEXT)")
        db.executemany("INSERT INTO customer VALUES (?, ?, ?, ?)", (tuple(r) for r in rows.toLocalIterator()))
    return path


def _sqlite_scan(s: SparkSession, d: str) -> DataFrame:
    return SqliteSource(_customers(s, d), "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 3 = 1;", "c_custkey", 4).load(s)


_OTHER = "SELECT c_custkey AS id, c_acctbal + CASE WHEN c_custkey % 5 = 0 THEN 20 WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS balance, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 8 = 0 THEN 'OTHER' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 10 <> 9"


def _remote(s: SparkSession, d: str, checks: str) -> ReconResult:
    config = ReconConfig.of("c_custkey", [("c_custkey", "id"), ("c_acctbal", "balance", "within 2"), ("c_mktsegment", "segment", "ignore case")])
    return reconcile_remote(s, f"sqlite:///{_customers(s, d)}", "SELECT * FROM customer", _OTHER, config, checks=checks)


def _nations(s: SparkSession, d: str) -> str:
    """The URL of a Derby database with the nations, that the driver makes.

    One process at a time may have a Derby database open, so the driver writes it alone, closes it and packs it up: an archive
    is read-only, and all executors may have it open.
    """
    folder = file_folder(s)
    url, rows = connection_url("derby", database=f"{folder}/nations"), table(s, d, "nation").select("n_nationkey", "n_regionkey")
    with open(f"{folder}/nation.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows(rows.toLocalIterator())
    # without rows there are no tasks: the table is made by the driver
    rows.filter("false").write.format("jdbc").options(url=f"{url};create=true", dbtable="nation", driver=driver_of(url)).save()
    derby = s._jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver()
    db = derby.connect(url, s._jvm.java.util.Properties())
    db.createStatement().execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, 'NATION', '{folder}/nation.csv', NULL, NULL, 'UTF-8', 0)")
    db.close()
    try:
        derby.connect(f"{url};shutdown=true", s._jvm.java.util.Properties())
    except Py4JJavaError as e:  # it tells so that it is closed
        if e.java_exception.getSQLState() != "08006":
            raise
    return connection_url("derby", database=f"jar:({shutil.make_archive(f'{folder}/nations', 'zip', folder, 'nations')})nations")


def _derby(s: SparkSession, d: str) -> DataFrame:
    found = JdbcSource(_nations(s, d), "SELECT * FROM nation", partition_column="n_nationkey", lower=0, upper=25, partitions=3).load(s)
    return found.select(*[F.col(c).alias(c.lower()) for c in found.columns]).filter("n_regionkey < 3")


def _suppliers(s: SparkSession, d: str, **options) -> ReconResult:
    a, k = table(s, d, "supplier"), F.col("s_suppkey")
    b = a.filter(k % 10 != 3).select(F.when(k % 10 == 4, k + 1_000_000).otherwise(k).alias("id"), F.when(k % 5 == 0, F.upper("s_name")).otherwise(F.col("s_name")).alias("name"), F.col("s_nationkey").alias("nation"))
    return reconcile(a, b, ReconConfig.of("s_suppkey", [("s_suppkey", "id"), ("s_name", "name"), ("s_nationkey", "nation")]), **options)


def _tables_sink(form: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        paths = write_tables(_suppliers(s, d), shared_folder(s), form)
        read = lambda n: (s.read.option("header", True).csv if form == "csv" else s.read.parquet)(paths[n])
        parts = [read(n).select(F.lit(n).alias("bucket"), F.col("s_suppkey").cast("long").alias("s_suppkey")) for n in paths]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])

    return run


def _csv_report(s: SparkSession, d: str) -> DataFrame:
    rows = []
    with passing_folder() as folder:
        for name, path in write_csv(_suppliers(s, d), folder, exact=True).items():
            with path.open(newline="", encoding="utf-8") as f:
                rows += [(name, r.get("Primary Key") or f"s_suppkey={r['s_suppkey']}", r.get("Column")) for r in csv.DictReader(f)]
    return s.createDataFrame(rows, "report string, key string, cell string")


def _json_report(s: SparkSession, d: str) -> DataFrame:
    with passing_folder() as folder, write_json(_suppliers(s, d), f"{folder}/r.json").open(encoding="utf-8") as f:
        report = json.load(f)
    rows = [("missing_in_file1", r["s_suppkey"]) for r in report["missing_in_file1"]["rows"]] + [("missing_in_file2", r["s_suppkey"]) for r in report["missing_in_file2"]["rows"]]
    rows += [("mismatches", r["primary_keys"]["s_suppkey"]) for r in report["mismatches"]["rows"]]
    return s.createDataFrame(rows, "bucket string, s_suppkey long")


def _workbook(s: SparkSession, d: str) -> DataFrame:
    with passing_folder() as folder:
        cells = ExcelSource(str(write_workbook(_suppliers(s, d), f"{folder}/w.xlsx")), "mismatches").load(s)
    return cells.select("s_suppkey", "Primary Key", "Column", "File 1 Value", "File 2 Value", "Remarks")


def _template(s: SparkSession, d: str) -> DataFrame:
    """By way of a template in CSV and one in a workbook."""
    result = _suppliers(s, d)
    with passing_folder() as folder:
        config = read_template(write_template(read_template(write_template(result.config, f"{folder}/t.csv")), f"{folder}/t.xlsx"))
    return reconcile(result.df1, result.df2, config).summary().drop("rules_not_understood")


def _config_file(s: SparkSession, d: str) -> DataFrame:
    result = _suppliers(s, d)
    with passing_folder() as folder:
        result.config.dump(f"{folder}/c.json")
        config = ReconConfig.load(f"{folder}/c.json")
    return reconcile(result.df1, result.df2, config).summary().drop("rules_not_understood")


def _positional(s: SparkSession, d: str) -> DataFrame:
    result = _suppliers(s, d)
    a = result.df1.select("s_suppkey", "s_name", "s_nationkey")
    return reconcile(a, result.df2, positional_mapping(a.columns, result.df2.columns)).summary().drop("rules_not_understood")


def _similar(s: SparkSession, d: str) -> DataFrame:
    result = _suppliers(s, d)
    b = result.df2.select(F.col("id").alias("Supp Key"), F.col("name").alias("SName"), F.col("nation").alias("nation_key"))
    a = result.df1.select("s_suppkey", "s_name", "s_nationkey")
    return reconcile(a, b, by_similar_names(a, b, ["s_suppkey"])).summary().drop("rules_not_understood")


def _suggested(s: SparkSession, d: str) -> DataFrame:
    result = _suppliers(s, d)

    def answer(prompt: str) -> str:
        """Maps the columns of both headers in the prompt by their place, as a model might answer."""
        first, second = (x.split("\n")[0].split(",") for x in re.findall(r"table:\n(.*?)(?:\n\n|\Z)", prompt, re.S))
        pairs = [{"file1_column": a, "file2_column": b, "validation_rule": None} for a, b in zip(first, second)]
        return f"```json\n{json.dumps({'primary_keys': first[:1], 'column_mappings': pairs})}\n```"

    a = result.df1.select("s_suppkey", "s_name", "s_nationkey")
    return reconcile(a, result.df2, suggest_mapping(a, result.df2, answer)).summary().drop("rules_not_understood")


def _row_rule(s: SparkSession, d: str) -> DataFrame:
    """A function of a person's: it reports some rows, fails on others, and gives something else for others."""

    def rule(row: dict) -> object:
        key = row["s_suppkey"]
        if key % 20 == 1:
            raise ValueError("no rule for this")
        if key % 20 == 2:
            return [{"column": "nation", "error": "odd", "file1_value": row["s_nationkey_f1"], "file2_value": row["s_nationkey_f2"]}]
        return [{}] if key % 20 == 6 else "nothing"

    found = _suppliers(s, d, row_rule=rule).breakdown
    return found.select("s_suppkey", "Column", "File 1 Value", "Remarks").filter("`Column` in ('nation', 'Rule Violation', 'Rule Execution Error')")


def _suggested_rule(s: SparkSession, d: str) -> DataFrame:
    check = suggest_rule("the names are the same", ["s_name"], lambda prompt: "```sql\ns_name_f1 = s_name_f2\n```")
    result = _suppliers(s, d)
    config = ReconConfig.of("s_suppkey", [("s_suppkey", "id"), ("s_name", "name", "ignore case")])
    return reconcile(result.df1, result.df2, config, row_check=check).mismatches.select("s_suppkey")


def _segments(rule: str | None, rules: dict | None = None, profile: str = "typed") -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        a, k = table(s, d, "customer"), F.col("c_custkey")
        b = a.select("c_custkey", F.when(k % 3 == 0, F.lower("c_mktsegment")).when(k % 5 == 0, F.lit("OTHER")).when(k % 7 == 0, F.concat(F.col("c_mktsegment"), F.lit(" "))).otherwise(F.col("c_mktsegment")).alias("segment"))
        config = ReconConfig.of("c_custkey", [("c_mktsegment", "segment", rule)], rules)
        return reconcile(a, b, config, profile).mismatches.select("c_custkey")

    return run


def _balances(s: SparkSession, d: str) -> DataFrame:
    a, k = table(s, d, "customer").select("c_custkey", "c_acctbal"), F.col("c_custkey")
    b = a.select("c_custkey", F.when(k % 4 == 0, F.col("c_acctbal") * 1.5).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    return reconcile(a, b, ReconConfig.of("c_custkey", [("c_acctbal", "c_acctbal", "within 5%")])).mismatches.select("c_custkey")


def _odd_names(s: SparkSession, d: str) -> DataFrame:
    odd = ["the.key", "a `name`", 'say "x"']
    a = table(s, d, "supplier").select(F.col("s_suppkey").alias(odd[0]), F.col("s_name").alias(odd[1]), F.col("s_nationkey").alias(odd[2]))
    b = a.select(quoted(odd[0]), F.upper(quoted(odd[1])).alias(odd[1]), quoted(odd[2])).filter(quoted(odd[0]) % 2 == 0)
    blank = [("nan", "x"), ("None", "y"), ("", "z"), (odd[1], " ")]
    found = reconcile(a, b, ReconConfig.of(odd[0], [(n, n) for n in odd] + blank)).mismatches
    return found.select(quoted(odd[0]).alias("key"), quoted(f"File2_{odd[1]}").alias("name"))


def _nothing(s: SparkSession, d: str) -> DataFrame:
    none = table(s, d, "supplier").filter("false")
    return reconcile(none, none, ReconConfig.of("s_suppkey", {"s_name": "s_name"})).summary().drop("rules_not_understood")


def _samples(s: SparkSession, d: str) -> DataFrame:
    path = _as_csv(s, table(s, d, "supplier"))
    found = [("csv", sample(open_source(path + "/*.csv"), s)), ("sql", sample(SqliteSource(_customers(s, d), "SELECT c_custkey, 1 AS credit_limit FROM customer"), s, 3))]
    return s.createDataFrame([(n, df.count(), len(df.columns)) for n, df in found], "source string, rows long, columns long")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    result, folder = _suppliers(s, d), shared_folder(s)
    result.df2.repartition(3).write.parquet(f"{folder}/in")
    stream = s.readStream.schema(result.df2.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = reconcile_stream(result.df1, stream, result.config, f"{folder}/out", f"{folder}/checkpoint", available_now=True)
    query.awaitTermination(300)
    return s.read.parquet(f"{folder}/out").groupBy("_status").agg(F.count(F.lit(1)).alias("n"))


def _workbook_types(s: SparkSession, d: str) -> DataFrame:
    """A sheet that the engine writes and reads, with a column of each kind."""
    from tallyframe.xlsx import write_workbook as write

    rows = [[r["n_nationkey"], r["n_nationkey"] / 4, r["n_nationkey"] % 2 == 0, r["n_name"], None] for r in table(s, d, "nation").select("n_nationkey", "n_name").collect()]
    with passing_folder() as folder:
        found = ExcelSource(str(write(f"{folder}/n.xlsx", [("nations", ["key", "quarter", "even", "name", "void"], rows)]))).load(s)
    assert not any(isinstance(v, dt.datetime) for v in found.first())
    return found.withColumn("void", F.col("void").cast("string"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv_blanks_kept": _csv_blanks,
    "csv_types": _csv_types,
    "sqlite_scan": _sqlite_scan,
    "jdbc_scan": _derby,
    "workbook_scan": _workbook_types,
    "source_samples": _samples,
    "remote_summary": lambda s, d: _remote(s, d, "spark").summary().drop("rules_not_understood"),
    "remote_summary_pushed": lambda s, d: _remote(s, d, "database").summary().drop("rules_not_understood"),
    "remote_mismatches_pushed": lambda s, d: _remote(s, d, "database").mismatches.select("c_custkey", "c_acctbal_IsValid", "c_mktsegment_IsValid"),
    "remote_only_in_source": lambda s, d: _remote(s, d, "database").only_in_1.select("c_custkey"),
    "tables_sink_parquet": _tables_sink("parquet"),
    "tables_sink_csv": _tables_sink("csv"),
    "csv_report": _csv_report,
    "json_report": _json_report,
    "workbook_report": _workbook,
    "template_mapping": _template,
    "config_file": _config_file,
    "positional_mapping": _positional,
    "similar_names_mapping": _similar,
    "suggested_mapping": _suggested,
    "row_rule_python": _row_rule,
    "suggested_row_check": _suggested_rule,
    "segment_ignore_case": _segments("Case insensitive"),
    "segment_strict_fallback": _segments("ignore spaces"),
    "segment_rule_by_column": _segments(None, {"c_mktsegment": "ignore case"}),
    "balance_within_percent": _balances,
    "odd_column_names": _odd_names,
    "empty_tables": _nothing,
    "row_counts": lambda s, d: _suppliers(s, d).row_counts(),
    "streamed_reconciliation": _streamed,
}

_SUPPLIERS = """
WITH b AS (
  SELECT CASE WHEN s_suppkey % 10 = 4 THEN s_suppkey + 1000000 ELSE s_suppkey END AS id,
         CASE WHEN s_suppkey % 5 = 0 THEN upper(s_name) ELSE s_name END AS name, s_nationkey AS nation FROM supplier WHERE s_suppkey % 10 <> 3),
m AS (SELECT *, s_name = name AND s_nationkey = nation AS good FROM supplier JOIN b ON s_suppkey = id)
"""

_SUPPLIER_SUMMARY = f"""{_SUPPLIERS}
SELECT (SELECT count(*) FROM supplier) AS total_rows_1, (SELECT count(*) FROM b) AS total_rows_2,
       (SELECT count(*) FROM supplier) - (SELECT count(*) FROM b) AS row_count_difference,
       (SELECT count(*) FROM supplier ANTI JOIN b ON s_suppkey = id) AS only_in_1, (SELECT count(*) FROM b ANTI JOIN supplier ON s_suppkey = id) AS only_in_2,
       (SELECT count(*) FROM m WHERE NOT good) AS mismatched_rows, (SELECT count(*) FROM m WHERE good) AS exact_rows"""

_BUCKETS = f"""{_SUPPLIERS}
SELECT 'mismatches' AS bucket, s_suppkey FROM m WHERE NOT good
UNION ALL SELECT '{{two}}', id FROM b ANTI JOIN supplier ON s_suppkey = id
UNION ALL SELECT '{{one}}', s_suppkey FROM supplier ANTI JOIN b ON s_suppkey = id"""

_REMOTE = f"""
WITH o AS ({_OTHER}),
m AS (SELECT c_custkey, abs(c_acctbal::DOUBLE - balance::DOUBLE) <= 2 AS a, lower(c_mktsegment) = lower(segment) AS s FROM customer JOIN o ON c_custkey = id)
"""

_REMOTE_SUMMARY = f"""{_REMOTE}
SELECT (SELECT count(*) FROM customer) AS total_rows_1, (SELECT count(*) FROM o) AS total_rows_2, (SELECT count(*) FROM customer) - (SELECT count(*) FROM o) AS row_count_difference,
       (SELECT count(*) FROM customer ANTI JOIN o ON c_custkey = id) AS only_in_1, 0::BIGINT AS only_in_2,
       (SELECT count(*) FROM m WHERE NOT (a AND s)) AS mismatched_rows, (SELECT count(*) FROM m WHERE a AND s) AS exact_rows"""

_SEGMENT_CASE = "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 AND (c_custkey % 5 = 0 OR c_custkey % 7 = 0)"

ORACLES: dict[str, str] = {
    "csv_blanks_kept": """
WITH p AS (
  SELECT o_orderkey, o_orderpriority AS v,
         CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority || '  ' WHEN o_orderkey % 11 = 0 THEN ' ' || o_orderpriority WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS w FROM orders)
SELECT o_orderkey, w AS "File2_o_orderpriority" FROM p WHERE v IS DISTINCT FROM w""",
    "csv_types": """SELECT * FROM (VALUES ('code', 'string'), ('even', 'boolean'), ('nothing', 'string'), ('o_orderkey', 'bigint'), ('o_orderpriority', 'string'), ('o_totalprice', 'double')) t("column", "type")""",
    "sqlite_scan": "SELECT c_custkey::BIGINT AS c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 3 = 1",
    "jdbc_scan": "SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey < 3",
    "workbook_scan": "SELECT n_nationkey::BIGINT AS key, n_nationkey / 4.0::DOUBLE AS quarter, n_nationkey % 2 = 0 AS even, n_name AS name, NULL::VARCHAR AS void FROM nation",
    "source_samples": "SELECT 'csv' AS source, 5::BIGINT AS rows, (SELECT count(*) FROM (DESCRIBE supplier)) AS columns UNION ALL SELECT 'sql', 3, 2",
    "remote_summary": _REMOTE_SUMMARY,
    "remote_summary_pushed": _REMOTE_SUMMARY,
    "remote_mismatches_pushed": f'{_REMOTE}SELECT c_custkey::BIGINT AS c_custkey, a AS "c_acctbal_IsValid", s AS "c_mktsegment_IsValid" FROM m WHERE NOT (a AND s)',
    "remote_only_in_source": f"{_REMOTE}SELECT c_custkey::BIGINT AS c_custkey FROM customer ANTI JOIN o ON c_custkey = id",
    **dict.fromkeys(("tables_sink_parquet", "tables_sink_csv"), _BUCKETS.format(one="only_in_file1", two="only_in_file2") + "\nUNION ALL SELECT 'exact_matches', s_suppkey FROM m WHERE good"),
    "csv_report": f"""{_SUPPLIERS}
SELECT 'mismatches' AS report, 's_suppkey=' || s_suppkey AS key, 's_name -> name' AS cell FROM m WHERE s_name <> name
UNION ALL SELECT 'mismatches', 's_suppkey=' || s_suppkey, 's_nationkey -> nation' FROM m WHERE s_nationkey <> nation
UNION ALL SELECT 'only_in_file2', 's_suppkey=' || id, NULL FROM b ANTI JOIN supplier ON s_suppkey = id
UNION ALL SELECT 'only_in_file1', 's_suppkey=' || s_suppkey, NULL FROM supplier ANTI JOIN b ON s_suppkey = id
UNION ALL SELECT 'exact_matches', 's_suppkey=' || s_suppkey, NULL FROM m WHERE good""",
    "json_report": _BUCKETS.format(one="missing_in_file2", two="missing_in_file1"),
    "workbook_report": f"""{_SUPPLIERS}
SELECT s_suppkey::BIGINT AS s_suppkey, 's_suppkey=' || s_suppkey AS "Primary Key", 's_name -> name' AS "Column", s_name AS "File 1 Value", name AS "File 2 Value", 'Exact Match Failed' AS "Remarks"
FROM m WHERE s_name <> name""",
    **dict.fromkeys(("template_mapping", "config_file", "positional_mapping", "similar_names_mapping", "suggested_mapping"), _SUPPLIER_SUMMARY),
    "row_rule_python": f"""{_SUPPLIERS}
SELECT s_suppkey, 'Rule Execution Error' AS "Column", 'Error' AS "File 1 Value", 'no rule for this' AS "Remarks" FROM m WHERE s_suppkey % 20 = 1
UNION ALL SELECT s_suppkey, 'nation', s_nationkey::VARCHAR, 'odd' FROM m WHERE s_suppkey % 20 = 2
UNION ALL SELECT s_suppkey, 'Rule Violation', 'N/A', 'Rule violation' FROM m WHERE s_suppkey % 20 = 6""",
    "suggested_row_check": f"{_SUPPLIERS}SELECT s_suppkey FROM m WHERE s_name <> name",
    "segment_ignore_case": _SEGMENT_CASE,
    "segment_strict_fallback": "SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0",
    "segment_rule_by_column": _SEGMENT_CASE,
    "balance_within_percent": "SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0 AND c_acctbal <> 0",
    "odd_column_names": "SELECT s_suppkey AS key, upper(s_name) AS name FROM supplier WHERE s_suppkey % 2 = 0 AND upper(s_name) <> s_name",
    "empty_tables": "SELECT 0::BIGINT AS total_rows_1, 0::BIGINT AS total_rows_2, 0::BIGINT AS row_count_difference, 0::BIGINT AS only_in_1, 0::BIGINT AS only_in_2, 0::BIGINT AS mismatched_rows, 0::BIGINT AS exact_rows",
    "row_counts": f"{_SUPPLIERS}SELECT count(*) AS total_rows_1, (SELECT count(*) FROM b) AS total_rows_2, count(*) - (SELECT count(*) FROM b) AS row_count_difference FROM supplier",
    "streamed_reconciliation": f"""{_SUPPLIERS}
SELECT CASE WHEN good THEN 'exact' ELSE 'mismatch' END AS _status, count(*) AS n FROM m GROUP BY 1
UNION ALL SELECT 'only_in_2', count(*) FROM b ANTI JOIN supplier ON s_suppkey = id""",
}
