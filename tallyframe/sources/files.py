"""Files: CSV, Parquet and workbooks."""

from __future__ import annotations

from dataclasses import dataclass
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.align import quoted
from tallyframe.sources.paths import clean_path, spooled
from tallyframe.xlsx import read_sheet, table_of

#: Texts that spreadsheets and pandas write for an empty cell (fixed values).
NULL_TOKENS = ("", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: Types that a column of texts may turn out to have, tried in this order, and what a text of each looks like.
_SHAPES = (
    ("bigint", r"^[+-]?[0-9]{1,18}$"),
    ("double", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"),
    ("boolean", r"^(?i:true|false)$"),
    ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("timestamp", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?$"),
)


def typed(df: DataFrame, null_tokens: tuple[str, ...] = NULL_TOKENS, keep: tuple[str, ...] = (), sample_rows: int | None = None) -> DataFrame:
    """A DataFrame of texts with null tokens as nulls and each column in the narrowest type that all its values have.

    Texts stay as they are, blanks at their ends included; these are ignored only where a cell is tested for a null token
    or a number. Types come from all rows, in one aggregate; with sample_rows from the first so many, and a later value of
    another kind is an error when it is read. Columns in keep stay texts, as those whose numbers have leading zeros do.
    """
    clean = df.select(*[F.when(~F.trim(quoted(c)).isin(*null_tokens), quoted(c)).alias(c) for c in df.columns])
    tests = []
    for i, c in enumerate(df.columns):
        col = F.trim(quoted(c))
        tests.append(F.count(col).alias(f"n{i}"))
        tests.append(F.count_if(col.rlike(r"^[+-]?0[0-9]")).alias(f"zero{i}"))
        tests += [F.count_if(col.rlike(shape) & col.try_cast(kind).isNotNull()).alias(f"{kind}{i}") for kind, shape in _SHAPES]
    found = (clean if sample_rows is None else clean.limit(sample_rows)).agg(*tests).first().asDict()
    out = []
    for i, c in enumerate(df.columns):
        n = found[f"n{i}"]
        kind = next((k for k, _ in _SHAPES if n and found[f"{k}{i}"] == n and not (k in ("bigint", "double") and found[f"zero{i}"])), "string")
        out.append(quoted(c) if kind == "string" or c in keep else F.trim(quoted(c)).cast(kind).alias(c))
    return clean.select(*out)


@dataclass(frozen=True)
class CsvSource:
    """A CSV file with a header.

    schema: the types, if they are not to be found out; sample_rows: find them out from the first so many rows instead of from
    all, which saves a pass over the file; all_strings: texts as they are; multi_line: quoted cells may hold
    line breaks, for which each file is read by one task.
    """

    path: str
    null_tokens: tuple[str, ...] = NULL_TOKENS
    all_strings: bool = False
    keep_strings: tuple[str, ...] = ()
    schema: T.StructType | str | None = None
    delimiter: str = ","
    multi_line: bool = False
    sample_rows: int | None = None

    def load(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.option("header", True).option("sep", self.delimiter).option("quote", '"').option("escape", '"').option("multiLine", self.multi_line)
        path = clean_path(self.path)
        if self.schema is not None:
            return reader.schema(self.schema).csv(path)
        texts = reader.option("inferSchema", False).csv(path)
        if self.all_strings:
            return texts.select(*[F.when(~quoted(c).isin(*[t for t in self.null_tokens if t.strip()] or [""]), quoted(c)).alias(c) for c in texts.columns]) if self.null_tokens else texts
        return typed(texts, self.null_tokens, self.keep_strings, self.sample_rows)


@dataclass(frozen=True)
class ParquetSource:
    path: str

    def load(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(clean_path(self.path))


@dataclass(frozen=True)
class ExcelSource:
    """A sheet of a workbook (.xlsx, .xlsm), read by the driver: a sheet has about a million rows at most."""

    path: str
    sheet: int | str = 0

    def load(self, spark: SparkSession) -> DataFrame:
        names, kinds, rows = table_of(read_sheet(clean_path(self.path), self.sheet))
        types = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampNTZType()}
        return spark.createDataFrame(rows, T.StructType([T.StructField(n, types[k]) for n, k in zip(names, kinds)]))


def open_source(path: str | IO, name: str | None = None, folder: str | None = None) -> CsvSource | ParquetSource | ExcelSource:
    """The source for a file, by the ending of its name in any case. A buffer is written to a file first."""
    if not isinstance(path, str):
        path = spooled(path, name or getattr(path, "name", "upload.csv"), folder)
    low = (name or clean_path(path)).lower()
    if low.endswith((".csv", ".tsv", ".txt")):
        return CsvSource(path, delimiter="\t" if low.endswith(".tsv") else ",")
    if low.endswith((".parquet", ".pq")):
        return ParquetSource(path)
    if low.endswith((".xls", ".xlsx", ".xlsm")):
        return ExcelSource(path)
    raise ValueError(f"Unsupported file format: {name or path}")
