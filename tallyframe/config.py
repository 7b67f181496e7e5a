"""What to reconcile: keys, column mappings with optional rules, and columns to leave out."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path


class ConfigError(ValueError):
    """A configuration that cannot be carried out on the given tables."""


#: Texts that stand for an empty cell in a mapping that people fill in.
BLANKS = frozenset({"", "nan", "none"})


def is_blank(text: object) -> bool:
    return text is None or str(text).strip().lower() in BLANKS


@dataclass(frozen=True)
class ColumnMap:
    """A column of the first table, its counterpart in the second, and the rule by which they must agree."""

    file1_column: str
    file2_column: str
    validation_rule: str | None = None


@dataclass(frozen=True)
class ReconConfig:
    """primary_keys and ignore_columns are names of the first table."""

    primary_keys: list[str]
    column_mappings: list[ColumnMap] = field(default_factory=list)
    ignore_columns: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, primary_keys: list[str] | str, mappings: dict[str, str] | list | None = None, rules: dict[str, str] | None = None, ignore_columns: list[str] | None = None) -> ReconConfig:
        """mappings: first to second name, or (first, second[, rule]) tuples. rules: by first name, used where a mapping has none."""
        keys = [primary_keys] if isinstance(primary_keys, str) else list(primary_keys)
        pairs = mappings.items() if isinstance(mappings, dict) else mappings or []
        made = []
        for m in pairs:
            m = m if isinstance(m, ColumnMap) else ColumnMap(*m)
            if is_blank(m.file1_column) or is_blank(m.file2_column):
                continue
            rule = m.validation_rule if not is_blank(m.validation_rule) else (rules or {}).get(m.file1_column)
            made.append(ColumnMap(m.file1_column, m.file2_column, None if is_blank(rule) else rule))
        return cls(keys, made, list(ignore_columns or []))

    @classmethod
    def from_dict(cls, values: dict) -> ReconConfig:
        missing = {"primary_keys", "column_mappings"} - values.keys()
        if missing:
            raise ConfigError(f"the configuration lacks {', '.join(sorted(missing))}")
        maps = [ColumnMap(m["file1_column"], m["file2_column"], m.get("validation_rule")) for m in values["column_mappings"]]
        return cls.of(values["primary_keys"], maps, ignore_columns=values.get("ignore_columns"))

    @classmethod
    def load(cls, path: str | Path) -> ReconConfig:
        return cls.from_dict(json.loads(Path(path).read_text()))

    def to_dict(self) -> dict:
        return asdict(self)

    def dump(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), indent=4))

    def second_name(self, first: str) -> str:
        """The counterpart of a column of the first table; an unmapped one has the same name in both."""
        return next((m.file2_column for m in self.column_mappings if m.file1_column == first), first)

    def checked(self, columns1: list[str], columns2: list[str], on_missing: str = "error") -> ReconConfig:
        """This configuration for tables of these columns, without ignored columns; ConfigError if it does not fit.

        on_missing: "error", or "skip" to leave out mappings of columns that a table lacks.
        """
        if not self.primary_keys:
            raise ConfigError("at least one primary key is needed")
        if len(set(self.primary_keys)) < len(self.primary_keys):
            raise ConfigError("a primary key is listed twice")
        names = [m.file1_column for m in self.column_mappings]
        twice = {n for n in names if names.count(n) > 1}
        if twice:
            raise ConfigError(f"mapped twice: {', '.join(sorted(twice))}")
        ignored = set(self.ignore_columns)
        if ignored & set(self.primary_keys):
            raise ConfigError("a primary key cannot be ignored")
        for key in self.primary_keys:
            for name, columns, which in ((key, columns1, "first"), (self.second_name(key), columns2, "second")):
                if name not in columns:
                    raise ConfigError(f"the {which} table has no key column {name!r}")
        kept = []
        for m in self.column_mappings:
            lacks = [f"{n!r} in the {which} table" for n, cols, which in ((m.file1_column, columns1, "first"), (m.file2_column, columns2, "second")) if n not in cols]
            if m.file1_column in ignored or lacks and on_missing == "skip":
                continue
            if lacks:
                raise ConfigError(f"no column {' and no column '.join(lacks)}")
            kept.append(m)
        return ReconConfig(self.primary_keys, kept, self.ignore_columns)


def positional_mapping(columns1: list[str], columns2: list[str], primary_keys: list[str] | None = None) -> ReconConfig:
    """Columns mapped by position, as far as the shorter table goes; the first is the key unless keys are given."""
    return ReconConfig.of(primary_keys or columns1[:1], list(zip(columns1, columns2)))


def name_mapping(columns1: list[str], columns2: list[str], primary_keys: list[str]) -> ReconConfig:
    """Columns mapped to those of the same name, letter case aside."""
    second = {c.lower(): c for c in reversed(columns2)}
    return ReconConfig.of(primary_keys, [(c, second[c.lower()]) for c in columns1 if c.lower() in second])
