"""Reports: a JSON file and CSV files for people, Parquet or CSV folders at any size."""

from __future__ import annotations

import csv
import json
from itertools import chain
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe import xlsx
from tallyframe.operators.align import quoted
from tallyframe.operators.reconcile import ReconResult

#: Buckets by the name of their report.
BUCKETS = {"mismatches": "breakdown", "only_in_file1": "only_in_1", "only_in_file2": "only_in_2", "exact_matches": "exact"}


def _texts(df: DataFrame) -> DataFrame:
    """Columns that CSV cannot hold as JSON text."""
    return df.select(*[F.to_json(quoted(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "struct") else quoted(f.name) for f in df.schema.fields])


def write_tables(result: ReconResult, folder: str, form: str = "parquet", buckets: tuple[str, ...] = tuple(BUCKETS)) -> dict[str, str]:
    """Each bucket as a folder of files, written by the executors; the paths by bucket."""
    paths = {}
    for name in buckets:
        df = getattr(result, BUCKETS[name])
        writer = (_texts(df) if form == "csv" else df).write.mode("overwrite")
        paths[name] = f"{folder.rstrip('/')}/{name}"
        (writer.option("header", True).csv if form == "csv" else writer.parquet)(paths[name])
    return paths


def _one_csv(df: DataFrame, path: Path) -> int:
    """All rows in one file, a partition at a time through the driver; no file for no rows."""
    rows = df.toLocalIterator()
    first = next(rows, None)
    if first is None:
        return 0
    n = 0
    with path.open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in chain([first], rows):
            out.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def write_csv(result: ReconResult, folder: str | Path, exact: bool = False) -> dict[str, Path]:
    """report_mismatches.csv (a line for each failing cell), report_only_in_file1.csv and report_only_in_file2.csv, and report_exact_matches.csv if asked for, ordered by key. Empty ones are not written."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    keys = result.keys
    ordered = lambda df: df.orderBy(*[quoted(k) for k in keys])
    cells = ordered(result.breakdown)
    cells = cells.drop(*keys) if not set(keys) & {"Primary Key", "Column"} else cells
    tables = {"mismatches": cells, "only_in_file1": ordered(result.only_in_1), "only_in_file2": ordered(result.only_in_2)} | ({"exact_matches": ordered(result.exact)} if exact else {})
    found = {name: folder / f"report_{name}.csv" for name in tables}
    return {name: path for name, path in found.items() if _one_csv(_texts(tables[name]), path)}


def _plain(value: object) -> object:
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def write_json(result: ReconResult, path: str | Path, rows: int | None = None) -> Path:
    """The summary and all rows of the buckets, as one JSON file that is written a row at a time.

    rows: so many of each bucket at most; `truncated` then says whether there are more.
    """
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    buckets = {"missing_in_file1": result.only_in_2, "missing_in_file2": result.only_in_1, "mismatches": result.differences}
    with path.open("w", encoding="utf-8") as f:
        f.write('{\n    "summary": ' + json.dumps(_plain(result.summary().first()), ensure_ascii=False))
        for name, df in buckets.items():
            f.write(f',\n    "{name}": {{"rows": [')
            n = 0
            for n, row in enumerate((df if rows is None else df.limit(rows + 1)).toLocalIterator(), 1):
                if rows is not None and n > rows:
                    break
                found = _plain(row)
                if name == "mismatches":
                    found["primary_keys"] = {k: found.pop(k) for k in result.keys}
                f.write((",\n" if n > 1 else "\n") + json.dumps(found, ensure_ascii=False))
            f.write(f'\n    ], "truncated": {json.dumps(rows is not None and n > rows)}}}')
        f.write("\n}\n")
    return path


def write_workbook(result: ReconResult, path: str | Path) -> Path:
    """A workbook with the summary and all rows of each bucket, a sheet each; a bucket that is longer than a sheet goes on in another."""
    tables = {"summary": result.summary(), **{n: getattr(result, a) for n, a in BUCKETS.items()}}
    return xlsx.write_workbook(path, ((name, df.columns, ([_plain(v) for v in row] for row in _texts(df).toLocalIterator())) for name, df in tables.items()))


def summary_lines(result: ReconResult) -> list[str]:
    """The summary for a console."""
    s = result.summary().first().asDict()
    lines = [f"Rows in file 1: {s['total_rows_1']}", f"Rows in file 2: {s['total_rows_2']}", f"Missing in file 1: {s['only_in_2']}", f"Missing in file 2: {s['only_in_1']}", f"Mismatched rows: {s['mismatched_rows']}", f"Exact matches: {s['exact_rows']}"]
    if not s["only_in_1"] + s["only_in_2"] + s["mismatched_rows"]:
        lines.append("SUCCESS: the tables agree.")
    return lines
