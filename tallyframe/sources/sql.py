"""Databases: any with a JDBC driver, and SQLite files through a data source of our own."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tallyframe.functions.rules import Rule
from tallyframe.sources.urls import driver_of


@dataclass(frozen=True)
class JdbcSource:
    """The result of a query, read over JDBC.

    partition_column, lower, upper and partitions split the reading among tasks by ranges of a numeric column; without
    them one task reads all. Filters, columns and limits of the DataFrame go to the database.
    """

    url: str
    query: str
    user: str | None = None
    password: str | None = None
    driver: str | None = None
    partition_column: str | None = None
    lower: int | None = None
    upper: int | None = None
    partitions: int = 8
    fetch_size: int = 10_000
    options: dict[str, str] = field(default_factory=dict)

    def load(self, spark: SparkSession) -> DataFrame:
        query = self.query.strip().rstrip(";")
        reader = spark.read.format("jdbc").option("url", self.url).option("fetchsize", self.fetch_size)
        given = {"user": self.user, "password": self.password, "driver": self.driver or driver_of(self.url), **self.options}
        for k, v in given.items():
            if v is not None:
                reader = reader.option(k, v)
        if self.partition_column is None:
            return reader.option("query", query).load()
        reader = reader.option("dbtable", f"({query}) split_source").option("partitionColumn", self.partition_column)
        return reader.option("lowerBound", self.lower).option("upperBound", self.upper).option("numPartitions", self.partitions).load()


#: Types that SQLite declares, by what their names hold, and Spark's.
_AFFINITY = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BOOL", "boolean"), ("DATE", "string"), ("NUM", "double"), ("DEC", "double"))


class _Range(InputPartition):
    def __init__(self, lower: int | None, upper: int | None):
        self.lower, self.upper = lower, upper


class SqliteDataSource(DataSource):
    """Options: path, query, and for parallel reading partition_column and partitions."""

    @classmethod
    def name(cls) -> str:
        return "tallyframe_sqlite"

    def _names(self) -> tuple[list[str], list[str]]:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            cursor = db.execute(f"SELECT * FROM ({self.options['query']}) LIMIT 0")
            names = [d[0] for d in cursor.description]
            declared = {}
            for (table,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'").fetchall():
                for _, column, kind, *_ in db.execute(f'PRAGMA table_info("{table}")'):
                    declared.setdefault(column.lower(), kind.upper())
            kinds = {n: next((s for part, s in _AFFINITY if part in declared.get(n.lower(), "-")), None) for n in names}
            computed = [n for n in names if kinds[n] is None]  # what their values are, all by one run of the query
            flags = [f"max(typeof({_quoted(n)}) = '{kind}'), max(typeof({_quoted(n)}) IN ('text', 'blob'))" for n in computed for kind in ("integer", "real")]
            seen = iter(db.execute(f"SELECT {', '.join(flags)} FROM ({self.options['query']})").fetchone() if flags else ())
            for n in computed:
                whole, other, real, _ = (next(seen) for _ in range(4))
                kinds[n] = "string" if other or not (whole or real) else "double" if real else "bigint"
        return names, [kinds[n] for n in names]

    def schema(self) -> str:
        return ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in zip(*self._names()))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(schema, dict(self.options))


class _SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.kinds, self.options = [f.dataType.simpleString() for f in schema.fields], options

    def partitions(self) -> list[InputPartition]:
        column = self.options.get("partition_column")
        if not column:
            return [_Range(None, None)]
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            low, high = db.execute(f'SELECT min("{column}"), max("{column}") FROM ({self.options["query"]})').fetchone()
        if low is None:
            return [_Range(None, None)]
        parts = max(1, min(int(self.options.get("partitions", 8)), int(high) - int(low) + 1))
        marks = [int(low) + (int(high) - int(low) + 1) * i // parts for i in range(parts)]
        return [_Range(a if i else None, b) for i, (a, b) in enumerate(zip(marks, [*marks[1:], None]))]

    def read(self, partition: _Range) -> Iterator[tuple]:
        column, tests = self.options.get("partition_column"), []
        if partition.lower is not None:
            tests.append(f'"{column}" >= {partition.lower}')
        if partition.upper is not None:
            tests.append(f'("{column}" < {partition.upper}' + (f' OR "{column}" IS NULL)' if partition.lower is None else ")"))
        where = f" WHERE {' AND '.join(tests)}" if tests else ""
        turn = {"bigint": int, "double": float, "string": str, "boolean": bool}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            for row in db.execute(f"SELECT * FROM ({self.options['query']}){where}"):
                yield tuple(None if v is None else turn.get(k, str)(v) for k, v in zip(self.kinds, row))


@dataclass(frozen=True)
class SqliteSource:
    """The result of a query on an SQLite file that all executors see."""

    path: str
    query: str
    partition_column: str | None = None
    partitions: int = 8

    def load(self, spark: SparkSession) -> DataFrame:
        spark.dataSource.register(SqliteDataSource)
        reader = spark.read.format("tallyframe_sqlite").option("path", self.path).option("query", self.query.strip().rstrip(";"))
        if self.partition_column:
            reader = reader.option("partition_column", self.partition_column).option("partitions", str(self.partitions))
        return reader.load()


def open_connection(url: str, query: str, **options) -> JdbcSource | SqliteSource:
    """The source for a connection URL: sqlite:///path, or any JDBC URL."""
    if url.startswith("sqlite:///"):
        return SqliteSource(url.removeprefix("sqlite:///"), query, **options)
    return JdbcSource(url, query, **options)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _folded(name: str) -> str:
    """What two values share that SQLite finds equal by any affinity or collation: the number that a text stands for, else the text in lower case."""
    x = f"s.{_quoted(name)}"
    return f"CASE WHEN +{x} = CAST({x} AS NUMERIC) THEN CAST({x} AS NUMERIC) ELSE lower(rtrim({x})) END"


def remote_join(query1: str, query2: str, keys: list[tuple[str, str]], columns: list[tuple[str, str]], checks: list[tuple[int, Rule]] = (), signed_percent: bool = False, sqlite: bool = False) -> str:
    """One query that joins two in the database, which must know FULL OUTER JOIN, or is SQLite.

    SQLite does a full join of queries by loops over all pairs. A left join it does by an index of the right side, if both keys
    are columns of one affinity, as folded ones are; two of these make a full one. LIMIT -1 leaves all rows, but keeps SQLite from
    merging a side into the join, where folded keys would be no columns. keys and columns: (first, second) names; checks: the number
    of a column and its rule. Columns: p1 and p2, 1 where a side has the row, k<i>1, k<i>2, v<i>1, v<i>2, and c<i>, 1 if the
    values of a row in both agree, else 0.
    """
    pick = lambda kind, pairs: [f"a.{_quoted(x)} AS {kind}{i}1, b.{_quoted(y)} AS {kind}{i}2" for i, (x, y) in enumerate(pairs)]
    on = " AND ".join(f"a.{_quoted(x)} = b.{_quoted(y)}" for x, y in keys)
    tests = [f"CASE WHEN {remote_check('a.' + _quoted(columns[i][0]), 'b.' + _quoted(columns[i][1]), rule, signed_percent)} THEN 1 ELSE 0 END AS c{i}" for i, rule in checks]
    chosen = f"SELECT a.present AS p1, b.present AS p2, {', '.join(pick('k', keys) + pick('v', columns) + tests)} FROM"
    side = lambda text, folded="", end="": f"(SELECT s.*, {folded}1 AS present FROM ({text.strip().rstrip(';')}) s{end})"
    if not sqlite:
        return f"{chosen} {side(query1)} a FULL OUTER JOIN {side(query2)} b ON {on}"
    a, b = (f"{side(text, ''.join(f'{_folded(names[i])} AS {_quoted(f'folded key {k}')}, ' for k, names in enumerate(keys)), ' LIMIT -1')} {'ab'[i]}" for i, text in enumerate((query1, query2)))
    on = " AND ".join([*(f"a.{_quoted(f'folded key {k}')} = b.{_quoted(f'folded key {k}')}" for k in range(len(keys))), on])
    return f"{chosen} {a} LEFT JOIN {b} ON {on} UNION ALL {chosen} {b} LEFT JOIN {a} ON {on} WHERE a.present IS NULL"


def remote_check(a: str, b: str, rule: Rule, signed_percent: bool = False) -> str:
    """The condition under which two values agree as texts, or by a rule; null is no agreement."""
    text = lambda x: f"CAST({x} AS VARCHAR(4000))"
    number = lambda x: f"CAST({x} AS DOUBLE PRECISION)"
    if rule.kind == "strict":
        return f"{text(a)} = {text(b)}"
    if rule.kind == "ignore_case":
        return f"LOWER({text(a)}) = LOWER({text(b)})"
    base = number(a) if signed_percent else f"ABS({number(a)})"
    limit = repr(rule.amount) if rule.kind == "absolute" else f"{base} * {rule.amount!r} / 100.0"
    return f"ABS({number(a)} - {number(b)}) <= {limit}"


def _good(compared: list[int]) -> str:
    return " AND ".join(f"c{i} = 1" for i in compared) or "1 = 1"


def remote_bucket(joined: str, status: str, compared: list[int]) -> str:
    """The rows of remote_join() that are in both and a mismatch, or exact."""
    good = _good(compared)
    return f"SELECT * FROM ({joined}) j WHERE p1 = 1 AND p2 = 1 AND {good if status == 'exact' else f'NOT ({good})'}"


def remote_counts(joined: str, compared: list[int]) -> str:
    """How many rows of remote_join() are in each bucket."""
    count = lambda name, test: f"SUM(CASE WHEN {test} THEN 1 ELSE 0 END) AS {name}"
    both, good = "p1 = 1 AND p2 = 1", _good(compared)
    parts = [count("only_in_1", "p2 IS NULL"), count("only_in_2", "p1 IS NULL"), count("mismatched_rows", f"{both} AND NOT ({good})"), count("exact_rows", f"{both} AND {good}")]
    return f"SELECT {', '.join(parts)} FROM ({joined}) j"
