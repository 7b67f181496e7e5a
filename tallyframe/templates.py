"""Mappings as small tables that people fill in."""

from __future__ import annotations

import csv
from pathlib import Path

from tallyframe.config import ColumnMap, ConfigError, ReconConfig, is_blank
from tallyframe.xlsx import read_sheet, table_of, write_workbook

#: Headers of a template (fixed values).
FILE1, FILE2, RULE, KEY = "File 1 Column", "File 2 Column", "Validation Rule (Optional)", "Is Primary Key"

TRUE = frozenset({"true", "1", "yes", "t"})


def read_template(path: str | Path) -> ReconConfig:
    """The configuration of a template: CSV, or the first sheet of a workbook."""
    if str(path).lower().endswith((".xls", ".xlsx", ".xlsm")):
        names, _, cells = table_of(read_sheet(path))
        rows = [dict(zip(names, ["" if v is None else str(v) for v in r])) for r in cells]
    else:
        with open(path, newline="", encoding="utf-8-sig") as f:
            rows = list(csv.DictReader(f))
    lacks = {FILE1, FILE2, RULE} - set(rows[0] if rows else (FILE1, FILE2, RULE))
    if lacks:
        raise ConfigError(f"the template lacks {', '.join(sorted(lacks))}")
    cell = lambda r, n: str(r.get(n) or "").strip()
    kept = [r for r in rows if not is_blank(cell(r, FILE1)) and not is_blank(cell(r, FILE2))]
    maps = [ColumnMap(cell(r, FILE1), cell(r, FILE2), None if is_blank(cell(r, RULE)) else cell(r, RULE)) for r in kept]
    return ReconConfig([cell(r, FILE1) for r in kept if cell(r, KEY).lower() in TRUE], maps)


def write_template(config: ReconConfig, path: str | Path) -> Path:
    """The template of a configuration, as CSV or by its name as a workbook, keys marked; keys that are not mapped map to themselves."""
    mapped = {m.file1_column for m in config.column_mappings}
    maps = [*[ColumnMap(k, k) for k in config.primary_keys if k not in mapped], *config.column_mappings]
    rows = [[m.file1_column, m.file2_column, m.validation_rule or "", str(m.file1_column in config.primary_keys)] for m in maps]
    if str(path).lower().endswith(".xlsx"):
        return write_workbook(path, [("Mapping", [FILE1, FILE2, RULE, KEY], rows)])
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow([FILE1, FILE2, RULE, KEY])
        out.writerows(rows)
    return Path(path)
