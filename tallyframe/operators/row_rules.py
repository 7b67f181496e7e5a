"""Rules over whole rows that a user writes in Python or as an SQL expression."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.config import ConfigError

_FIELDS = ("column", "mapping", "file1_value", "file2_value", "validation_rule", "error")

DIFFERENCE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in _FIELDS]))


def _made(found: object) -> list[tuple]:
    """The differences that a function returned; what is no list of dicts counts as none."""
    out = []
    for d in found if isinstance(found, list) else []:
        if isinstance(d, dict):
            column = str(d.get("column", "Rule Violation"))
            out.append((column, column, str(d.get("file1_value", "N/A")), str(d.get("file2_value", "N/A")), "row rule", str(d.get("error", "Rule violation"))))
    return out


def row_differences(rule: Callable[[dict], list[dict]], row: Column) -> Column:
    """The differences that a Python function finds in a row. An error of the function is a difference of its own."""

    def run(value) -> list[tuple]:
        try:
            return _made(rule(value.asDict(recursive=True)))
        except Exception as e:  # the rule is the user's: whatever it raises is reported with the row
            return [("Rule Execution Error", "Rule Execution Error", "Error", "Error", "row rule", str(e))]

    return F.udf(run, DIFFERENCE, useArrow=True)(row)  # rows go to Python in Arrow batches


#: Functions that an SQL rule may call.
ALLOWED = frozenset("abs coalesce lower upper trim ltrim rtrim length substring substr concat round floor ceil greatest least nullif if ifnull isnull isnotnull year month day date_diff datediff to_date try_cast cast replace regexp_replace rlike like between startswith endswith contains".split())

_WORDS = frozenset("and or not in is null true false case when then else end like rlike between as double int bigint string date timestamp boolean decimal".split())


def sql_check(text: str, columns: list[str], row: str = "row") -> str:
    """An SQL expression over <column>_f1 and <column>_f2, rewritten to read them from the struct column `row`.

    It may use only these names and ALLOWED functions; anything else is a ConfigError.
    """
    names = {f"{c}_f{s}" for c in columns for s in (1, 2)}
    out = []
    for part in re.split(r"('(?:[^']|'')*')", text):
        if not part.startswith("'"):
            if re.search(r";|--|/\*", part):
                raise ConfigError("a rule is one expression")
            part = re.sub(r"`([^`]+)`|([A-Za-z_]\w*)(\s*\()?", lambda m: _allowed(m, names, row), part)
        out.append(part)
    return "".join(out)


def _allowed(found: re.Match, names: set[str], row: str) -> str:
    name = found[1] or found[2]
    if name in names and not found[3]:
        return f"{row}.`{name}`"
    if found[1] or name.lower() not in (ALLOWED | _WORDS if found[3] else _WORDS):
        raise ConfigError(f"a rule may not use {name!r}")
    return found[0]
