"""Two tables brought to one shape: keys, mapped values and a mark of presence, under names that cannot clash."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.config import ColumnMap, ReconConfig
from tallyframe.functions.compare import key_pair, kind, no_nan


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Aligned:
    """left has k<i> (keys), v<i> (values of mapping i) and p (true); right likewise, all with a suffix 1 or 2."""

    left: DataFrame
    right: DataFrame
    config: ReconConfig
    types: list[tuple[T.DataType, T.DataType]]

    @property
    def mappings(self) -> list[ColumnMap]:
        return self.config.column_mappings


def align(df1: DataFrame, df2: DataFrame, config: ReconConfig, profile: str = "typed", on_missing: str = "error") -> Aligned:
    """Selects only what is compared, so that scans read no other column."""
    config = config.checked(df1.columns, df2.columns, on_missing)
    type1, type2 = ({f.name: f.dataType for f in df.schema.fields} for df in (df1, df2))
    for m in config.column_mappings:
        kind(type1[m.file1_column]), kind(type2[m.file2_column])
    keys = []
    for name in config.primary_keys:
        other = config.second_name(name)
        a, b = no_nan(quoted(name), type1[name]), no_nan(quoted(other), type2[other])
        keys.append(key_pair(a, b, type1[name], type2[other], name, profile))
    value = lambda name, types: no_nan(quoted(name), types[name])
    maps = config.column_mappings
    left = df1.select(*[k[0].alias(f"k{i}1") for i, k in enumerate(keys)], *[value(m.file1_column, type1).alias(f"v{i}1") for i, m in enumerate(maps)], F.lit(True).alias("p1"))
    right = df2.select(*[k[1].alias(f"k{i}2") for i, k in enumerate(keys)], *[value(m.file2_column, type2).alias(f"v{i}2") for i, m in enumerate(maps)], F.lit(True).alias("p2"))
    return Aligned(left, right, config, [(type1[m.file1_column], type2[m.file2_column]) for m in maps])


def on_keys(aligned: Aligned, profile: str) -> Column:
    """Equality of all keys: in the typed profile nulls match nulls, in the text profile they match nothing."""
    match = None
    for i in range(len(aligned.config.primary_keys)):
        one = F.col(f"k{i}1").eqNullSafe(F.col(f"k{i}2")) if profile == "typed" else F.col(f"k{i}1") == F.col(f"k{i}2")
        match = one if match is None else match & one
    return match
