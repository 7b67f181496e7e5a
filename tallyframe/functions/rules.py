"""Validation rules in plain words, compiled to column expressions.

A rule that speaks of a tolerance ("within 5", "+/- 0.5", "tolerance 2%") allows an absolute difference, or one in
percent of the first value; one that ignores case compares in lower case; any other is strict. A tolerance without a
number is not understood as such.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.compare import canon, same

#: Words that make a rule a tolerance, and those that make it ignore case (fixed values).
TOLERANCE_WORDS = ("tolerance", "+/-", "within")
CASE_WORDS = ("ignore case", "case insensitive")

_NUMBER = re.compile(r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+")


@dataclass(frozen=True)
class Rule:
    """kind: strict, ignore_case, absolute or percent. understood: whether the text said so."""

    kind: str
    amount: float = 0.0
    understood: bool = True


def first_number(text: str, legacy: bool = False) -> float | None:
    """The first number in a rule. legacy: only a word of digits, once $ and % are gone."""
    if legacy:
        return next((float(w) for w in text.replace("$", "").replace("%", "").split() if w.isdigit()), None)
    found = _NUMBER.search(text.replace("+/-", " "))
    return float(found[0].replace(",", "")) if found else None


def parse_rule(text: str | None, legacy_numbers: bool = False) -> Rule:
    low = (text or "").strip().lower()
    if not low:
        return Rule("strict")
    if any(w in low for w in TOLERANCE_WORDS):
        amount = first_number(low, legacy_numbers)
        if amount is not None:
            return Rule("percent" if "%" in low or "percent" in low else "absolute", amount)
    if any(w in low for w in CASE_WORDS) or "case-insensitive" in low:
        return Rule("ignore_case")
    return Rule("strict", understood=any(w in low for w in ("exact", "strict", "equal", "match")))


def as_double(column: Column, dtype: T.DataType) -> Column:
    """A number, null where a text is none."""
    if isinstance(dtype, T.NumericType):
        return column.cast("double")
    return column.cast("string").try_cast("double")


def valid(a: Column, b: Column, ta: T.DataType, tb: T.DataType, rule: Rule, profile: str, signed_percent: bool = False) -> Column:
    """Whether two cells agree by a rule; never null. Both null agree in the typed profile, by any rule.

    signed_percent: percentages of the first value with its sign, so that no negative value is within any.
    """
    if rule.kind == "strict":
        return same(a, b, ta, tb, profile)
    if rule.kind == "ignore_case":
        agrees = F.lower(canon(a, ta)) == F.lower(canon(b, tb))
    else:
        x, y = as_double(a, ta), as_double(b, tb)
        limit = F.lit(rule.amount) if rule.kind == "absolute" else (x if signed_percent else F.abs(x)) * F.lit(rule.amount) / F.lit(100.0)
        agrees = F.abs(x - y) <= limit
    if profile == "typed":
        agrees = agrees | (a.isNull() & b.isNull())
    return F.coalesce(agrees, F.lit(False))
