"""Mappings proposed by whatever is asked: a language model, or the names themselves."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from tallyframe.config import ConfigError, ReconConfig

#: From a prompt to an answer; the engine brings no client for any service.
Ask = Callable[[str], str]


def sample_text(df: DataFrame, rows: int = 5) -> str:
    """The header and first rows, as CSV."""
    lines = [",".join(df.columns)]
    lines += [",".join("" if v is None else str(v) for v in r) for r in df.take(rows)]
    return "\n".join(lines)


def unfenced(text: str) -> str:
    """An answer without the fence of code that may surround it."""
    found = re.search(r"```(?:\w+)?\s*\n(.*?)```", text, re.S)
    return (found[1] if found else text).strip()


def suggest_mapping(df1: DataFrame, df2: DataFrame, ask: Ask, rows: int = 5) -> ReconConfig:
    """The configuration that an answer to samples of both tables gives. ConfigError if the answer is none or does not fit."""
    prompt = (
        "Two tables describe the same things under different column names. Answer with JSON only: "
        '{"primary_keys": [names of the first table], "column_mappings": [{"file1_column": name, "file2_column": name, "validation_rule": null}]}.\n\n'
        f"First table:\n{sample_text(df1, rows)}\n\nSecond table:\n{sample_text(df2, rows)}\n"
    )
    try:
        answer = ask(prompt)
    except Exception as e:
        raise RuntimeError(f"no suggestion: {e}") from e
    try:
        return ReconConfig.from_dict(json.loads(unfenced(answer))).checked(df1.columns, df2.columns)
    except (ValueError, KeyError, TypeError) as e:
        raise ConfigError(f"the suggestion cannot be used: {e}") from e


def by_similar_names(df1: DataFrame, df2: DataFrame, primary_keys: list[str], least: float = 0.6) -> ReconConfig:
    """Each column mapped to the free one of the most similar name, if similar enough."""
    plain = lambda n: re.sub(r"[^a-z0-9]", "", n.lower())
    scored = sorted(((difflib.SequenceMatcher(None, plain(a), plain(b)).ratio(), a, b) for a in df1.columns for b in df2.columns), reverse=True)
    found: dict[str, str] = {}
    for score, a, b in scored:
        if score >= least and a not in found and b not in found.values():
            found[a] = b
    return ReconConfig.of(primary_keys, [(a, found[a]) for a in df1.columns if a in found])


def suggest_rule(words: str, columns: list[str], ask: Ask) -> str:
    """An SQL row check for a rule in plain words, tested against what such a check may use; model text is never executed as Python."""
    from tallyframe.operators.row_rules import sql_check

    names = ", ".join(f"{c}_f1, {c}_f2" for c in columns)
    answer = unfenced(ask(f"Write one SQL boolean expression over the columns {names} that is true if this holds: {words}. Answer with the expression only."))
    sql_check(answer, columns)
    return answer
