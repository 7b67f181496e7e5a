"""The reconciliation of two tables.

A full outer join on the keys, with a mark of presence from each side, classifies every row as only in the first table,
only in the second, mismatched or exact. Everything is lazy: buckets are filters on the classified rows, and a bucket
that needs one side only is an anti join of its own, which reads no values of the other side, one of pairs an inner join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.config import ConfigError, ReconConfig
from tallyframe.functions.compare import PROFILES, canon, no_nan
from tallyframe.functions.rules import parse_rule, valid
from tallyframe.operators.align import align, on_keys, quoted

ONLY_1, ONLY_2, MISMATCH, EXACT = "only_in_1", "only_in_2", "mismatch", "exact"

#: Value of the join option: one full outer join, an inner and two anti joins, whose skewed partitions Spark splits, or
#: whichever suits the keys.
JOINS = ("outer", "split", "auto")

#: Hash buckets in which rows are counted to find out whether a key is hot, and the share of all rows that tells it is.
SKEW_BUCKETS, SKEW_SHARE = 4096, 1 / 256


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


class ReconResult:
    """The outcome of a reconciliation, as lazy DataFrames."""

    def __init__(self, df1: DataFrame, df2: DataFrame, config: ReconConfig, profile: str, join: str, on_missing: str, legacy_numbers: bool, signed_percent: bool, row_rule: Callable | None, row_check: Callable | str | None):
        if profile not in PROFILES or join not in JOINS:
            raise ConfigError(f"profile must be one of {PROFILES}, join one of {JOINS}")
        self.df1, self.df2, self.profile, self.join = df1, df2, profile, join
        self.aligned = align(df1, df2, config, profile, on_missing)
        self.config = self.aligned.config
        self.keys = self.config.primary_keys
        keyed = set(self.keys) if profile == "typed" else set()
        self.compared = [i for i, m in enumerate(self.config.column_mappings) if m.file1_column not in keyed]
        self.rules = [parse_rule(m.validation_rule, legacy_numbers) for m in self.config.column_mappings]
        self.signed_percent, self.row_rule, self.row_check = signed_percent, row_rule, row_check
        self._kept = False

    # -- joins

    #: Whether the rows come joined from elsewhere.
    _elsewhere = False

    @cached_property
    def _joined(self) -> DataFrame:
        a, on = self.aligned, on_keys(self.aligned, self.profile)
        if self.join == "outer" or self.join == "auto" and not (skewed(a.left) or skewed(a.right)):
            return a.left.join(a.right, on, "full_outer")
        empty = lambda df: [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
        left = a.left.join(a.right, on, "left_anti").select("*", *empty(a.right))
        right = a.right.join(a.left, on, "left_anti").select(*empty(a.left), "*")
        return a.left.join(a.right, on, "inner").unionByName(left).unionByName(right)

    def _check(self, i: int) -> Column:
        a, b = F.col(f"v{i}1"), F.col(f"v{i}2")
        return valid(a, b, *self.aligned.types[i], self.rules[i], self.profile, self.signed_percent)

    def _judged(self, rows: DataFrame, both: Column | None) -> tuple[DataFrame, Column]:
        """rows with checks c<i>, row_ok and extra (differences of the row rule), and whether all is well. both: null if every row is in both tables."""
        only = (lambda x: x) if both is None else (lambda x: F.when(both, x))
        rows = rows.withColumns({f"c{i}": only(self._check(i)) for i in self.compared})
        good = _all([F.col(f"c{i}") for i in self.compared])
        if self.row_check is not None:
            rows = rows.withColumn("row", self._row_struct())
            rows = rows.withColumn("row_ok", only(F.coalesce(self._row_condition(), F.lit(False)))).drop("row")
            good = good & F.col("row_ok")
        if self.row_rule is not None:
            from tallyframe.operators.row_rules import row_differences

            rows = rows.withColumn("extra", only(row_differences(self.row_rule, self._row_struct())))
            good = good & (F.size("extra") == 0)
        return rows, good

    @cached_property
    def _classified(self) -> DataFrame:
        """Every row under internal names, with its checks and _status."""
        both = F.col("p1").isNotNull() & F.col("p2").isNotNull()
        rows, good = self._judged(self._joined, both)
        return rows.withColumn("_status", F.when(F.col("p1").isNull(), ONLY_2).when(F.col("p2").isNull(), ONLY_1).when(good, EXACT).otherwise(MISMATCH))

    @cached_property
    def _paired(self) -> DataFrame:
        """The rows that are in both tables: by an inner join, unless all classified rows are kept or joined elsewhere.

        An inner join may be broadcast, its skewed partitions are split, and what filters its rows goes into the join.
        """
        if self._kept or self._elsewhere:
            return self._classified.filter(F.col("_status").isin(MISMATCH, EXACT))
        a = self.aligned
        rows, good = self._judged(a.left.join(a.right, on_keys(a, self.profile), "inner"), None)
        return rows.withColumn("_status", F.when(good, EXACT).otherwise(MISMATCH))

    def _row_struct(self) -> Column:
        maps = self.config.column_mappings
        sides = [F.col(f"v{i}1").alias(f"{m.file1_column}_f1") for i, m in enumerate(maps)] + [F.col(f"v{i}2").alias(f"{m.file1_column}_f2") for i, m in enumerate(maps)]
        return F.struct(*[F.coalesce(F.col(f"k{i}1"), F.col(f"k{i}2")).alias(k) for i, k in enumerate(self.keys)], *sides)

    def _row_condition(self) -> Column:
        if callable(self.row_check):
            return self.row_check(F.col("row"))
        from tallyframe.operators.row_rules import sql_check

        return F.expr(sql_check(self.row_check, [m.file1_column for m in self.config.column_mappings]))

    def _key_columns(self) -> list[Column]:
        return [F.coalesce(F.col(f"k{i}1"), F.col(f"k{i}2")).alias(k) for i, k in enumerate(self.keys)]

    def _values(self) -> list[Column]:
        """File1_<first name> and File2_<second name>; a column of the second table that serves again names the first too."""
        out, used = [], set()
        for i, m in enumerate(self.config.column_mappings):
            name = f"File2_{m.file2_column}" if m.file2_column not in used else f"File2_{m.file2_column}_for_{m.file1_column}"
            used.add(m.file2_column)
            out += [F.col(f"v{i}1").alias(f"File1_{m.file1_column}"), F.col(f"v{i}2").alias(name)]
        return out

    # -- results

    def _shown(self, rows: DataFrame) -> DataFrame:
        maps = self.config.column_mappings
        checks = [F.col(f"c{i}").alias(f"{maps[i].file1_column}_IsValid") for i in self.compared]
        return rows.select(*self._key_columns(), *self._values(), *checks, "_status")

    @cached_property
    def classified(self) -> DataFrame:
        """Keys, File1_ and File2_ values, <column>_IsValid (null unless in both tables) and _status."""
        return self._shown(self._classified)

    def persist(self) -> ReconResult:
        """Keeps the classified rows, for when several buckets are read; call it before the first of them."""
        self._kept = True
        self._classified.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        self._classified.unpersist()

    def _one_side(self, side: int) -> DataFrame:
        a = self.aligned
        mine, other = (a.left, a.right) if side == 1 else (a.right, a.left)
        mine = mine.join(other.select(*[c for c in other.columns if c[0] == "k"]), on_keys(a, self.profile), "left_anti")
        maps = [(i, m) for i, m in enumerate(self.config.column_mappings) if m.file1_column not in self.keys]
        return mine.select(*[F.col(f"k{i}{side}").alias(k) for i, k in enumerate(self.keys)], *[F.col(f"v{i}{side}").alias(m.file1_column) for i, m in maps])

    @cached_property
    def only_in_1(self) -> DataFrame:
        """Rows that the second table lacks: keys and mapped columns, under the first table's names and in its types."""
        return self._one_side(1)

    @cached_property
    def only_in_2(self) -> DataFrame:
        """Rows that the first table lacks, under the first table's names."""
        return self._one_side(2)

    @cached_property
    def matched(self) -> DataFrame:
        """Rows in both tables, exact or not."""
        return self._shown(self._paired)

    @cached_property
    def mismatches(self) -> DataFrame:
        return self._shown(self._paired.filter(F.col("_status") == MISMATCH)).drop("_status")

    @cached_property
    def exact(self) -> DataFrame:
        return self._shown(self._paired.filter(F.col("_status") == EXACT)).drop("_status")

    def _differences(self) -> Column:
        """The failing cells of a row, in the order of the mappings, values as text."""
        maps, found = self.config.column_mappings, []
        for i in self.compared:
            m, (ta, tb) = maps[i], self.aligned.types[i]
            rule = m.validation_rule
            remark = f"Failed Rule: {rule}" if rule else "Exact Match Failed"
            found.append(F.when(~F.col(f"c{i}"), F.struct(
                F.lit(m.file1_column).alias("column"), F.lit(f"{m.file1_column} -> {m.file2_column}").alias("mapping"),
                canon(F.col(f"v{i}1"), ta).alias("file1_value"), canon(F.col(f"v{i}2"), tb).alias("file2_value"),
                F.lit(rule or "").alias("validation_rule"), F.lit(remark).alias("error"),
            )))
        kind = "array<struct<column:string,mapping:string,file1_value:string,file2_value:string,validation_rule:string,error:string>>"
        cells = F.filter(F.array(*found).cast(kind), lambda x: x.isNotNull()) if found else F.array().cast(kind)
        if self.row_check is not None:
            row = F.struct(F.lit("Rule Violation").alias("column"), F.lit("Rule Violation").alias("mapping"), F.lit("N/A").alias("file1_value"), F.lit("N/A").alias("file2_value"), F.lit("row check").alias("validation_rule"), F.lit("Rule violation").alias("error"))
            cells = F.concat(cells, F.when(~F.col("row_ok"), F.array(row)).otherwise(F.array()).cast(kind))
        if self.row_rule is not None:
            cells = F.concat(cells, F.col("extra").cast(kind))
        return cells

    @cached_property
    def differences(self) -> DataFrame:
        """One row for each mismatched row: keys and an array of its failing cells."""
        bad = self._paired.filter(F.col("_status") == MISMATCH)
        return bad.select(*self._key_columns(), self._differences().alias("differences"))

    @cached_property
    def breakdown(self) -> DataFrame:
        """One row for each failing cell: keys, the key in words, mapping, values, rule and remark."""
        named = [F.concat(F.lit(f"{k}="), F.coalesce(quoted(k).cast("string"), F.lit("null"))) for k in self.keys]
        cells = self.differences.select(*[quoted(k) for k in self.keys], F.concat_ws(", ", *named).alias("Primary Key"), F.explode("differences").alias("d"))
        return cells.select(
            *[quoted(k) for k in self.keys], "Primary Key", F.col("d.mapping").alias("Column"), F.col("d.file1_value").alias("File 1 Value"),
            F.col("d.file2_value").alias("File 2 Value"), F.col("d.validation_rule").alias("Validation Rule"), F.col("d.error").alias("Remarks"),
        )

    def row_counts(self) -> DataFrame:
        """One row: total_rows_1, total_rows_2 and row_count_difference, from a count of each table without a join."""
        count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        both = count(self.df1, "total_rows_1").crossJoin(count(self.df2, "total_rows_2"))  # one row each
        return both.withColumn("row_count_difference", F.col("total_rows_1") - F.col("total_rows_2"))

    def summary(self) -> DataFrame:
        """One row: total_rows_1, total_rows_2, row_count_difference, only_in_1, only_in_2, mismatched_rows, exact_rows, rules_not_understood."""
        tagged = lambda df, tag: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(tag).alias("what"), "n")
        parts = self._classified.groupBy(F.col("_status").alias("what")).agg(F.count(F.lit(1)).alias("n"))
        parts = parts.unionByName(tagged(self.df1, "1")).unionByName(tagged(self.df2, "2"))
        of = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0))
        return parts.agg(
            of("1").alias("total_rows_1"), of("2").alias("total_rows_2"), (of("1") - of("2")).alias("row_count_difference"), of(ONLY_1).alias("only_in_1"),
            of(ONLY_2).alias("only_in_2"), of(MISMATCH).alias("mismatched_rows"), of(EXACT).alias("exact_rows"), F.lit(sum(not r.understood for r in self.rules)).cast("long").alias("rules_not_understood"),
        )


def skewed(side: DataFrame) -> bool:
    """Whether some key of an aligned side may hold over SKEW_SHARE of its rows: a count by hash bucket, which reads keys only and shuffles no rows.

    A key so hot is always found. Where rows are few, the buckets of several keys may look like one; then nothing is lost but time.
    """
    keys = [F.col(c) for c in side.columns if c[0] == "k"]
    counts = side.groupBy(F.pmod(F.xxhash64(*keys), F.lit(SKEW_BUCKETS)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    most, total = counts.agg(F.max("n"), F.sum("n")).first()
    return bool(total) and most > SKEW_SHARE * total


def reconcile(df1: DataFrame, df2: DataFrame, config: ReconConfig, profile: str = "typed", join: str = "outer", on_missing: str = "error", legacy_numbers: bool = False, signed_percent: bool = False, row_rule: Callable | None = None, row_check: Callable | str | None = None) -> ReconResult:
    """Reconciles df1, the source of truth, with df2.

    profile: "typed" or "text", see functions.compare. join: "outer", "split" for skewed keys, or "auto" to count rows by
    hash bucket of their keys first and choose. on_missing: "error" or
    "skip" for mapped columns that a table lacks. legacy_numbers: only words of digits count as a rule's number.
    signed_percent: percentages of the first value with its sign. row_rule: a Python function from a matched row (a dict
    with <column>_f1 and <column>_f2) to a list of differences. row_check: what must hold of a matched row, as an
    SQL expression over these names or a function from the row's struct to a boolean column, which stays in the JVM.
    """
    return ReconResult(df1, df2, config, profile, join, on_missing, legacy_numbers, signed_percent, row_rule, row_check)


class RemoteResult(ReconResult):
    """The outcome of a reconciliation whose join the database does; null keys match nothing there, in either profile.

    checks: "spark", or "database" for checks that are part of its SELECT too, in the text profile. Then each bucket is a
    query of its own, whose filter the database applies, and the summary is counted there: only rows of the bucket are
    transferred. Values compare as the database writes them out.
    """

    _elsewhere = True

    def __init__(self, spark: SparkSession, url: str, query1: str, query2: str, config: ReconConfig, profile: str, checks: str, legacy_numbers: bool, signed_percent: bool, row_rule: Callable | None, row_check: Callable | str | None, options: dict):
        from tallyframe.sources.sql import open_connection, remote_join

        self._open = lambda text: open_connection(url, text, **options).load(spark)
        super().__init__(self._open(query1), self._open(query2), config, profile, "outer", "error", legacy_numbers, signed_percent, row_rule, row_check)
        maps = self.config.column_mappings
        names = [(m.file1_column, m.file2_column) for m in maps]
        self.checks = checks == "database"
        if checks not in ("spark", "database") or self.checks and (profile != "text" or row_rule or row_check):
            raise ConfigError('checks must be "spark", or in the text profile without rules over rows "database"')
        tests = [(i, self.rules[i], maps[i]) for i in self.compared] if self.checks else []
        self._text = remote_join(query1, query2, [(k, self.config.second_name(k)) for k in self.keys], names, [(i, r) for i, r, _ in tests], signed_percent, sqlite=url.startswith("sqlite:"))

    @cached_property
    def _joined(self) -> DataFrame:
        return self._loaded(self._text)  # only when asked for: to know its columns, a database may have to join

    def _loaded(self, text: str) -> DataFrame:
        types = {c: f.dataType for side in (self.aligned.left, self.aligned.right) for c, f in zip(side.columns, side.schema.fields)}
        rows = self._open(text)
        held = {c.lower(): c for c in rows.columns}  # a database may fold the case of names
        columns = [(quoted(held[c]).cast("int") == 1 if c in ("p1", "p2") else no_nan(quoted(held[c]).cast(t), t)).alias(c) for c, t in types.items()]
        checks = [(F.coalesce(quoted(held[f"c{i}"]).cast("int") == 1, F.lit(False))).alias(f"c{i}") for i in self.compared] if self.checks else []
        return rows.select(*columns, *checks)

    def _judged(self, rows: DataFrame, both: Column | None) -> tuple[DataFrame, Column]:
        if not self.checks:
            return super()._judged(rows, both)
        only = (lambda x: x) if both is None else (lambda x: F.when(both, x))
        return rows.withColumns({f"c{i}": only(F.col(f"c{i}")) for i in self.compared}), _all([F.col(f"c{i}") for i in self.compared])

    def _bucket(self, status: str) -> DataFrame:
        from tallyframe.sources.sql import remote_bucket

        rows, good = self._judged(self._loaded(remote_bucket(self._text, status, self.compared)), None)
        return rows.withColumn("_status", F.lit(status))

    @cached_property
    def _paired(self) -> DataFrame:
        if not self.checks:
            return super()._paired
        return self._bucket(MISMATCH).unionByName(self._bucket(EXACT))

    @cached_property
    def mismatches(self) -> DataFrame:
        return self._shown(self._bucket(MISMATCH)).drop("_status") if self.checks else super().mismatches

    @cached_property
    def exact(self) -> DataFrame:
        return self._shown(self._bucket(EXACT)).drop("_status") if self.checks else super().exact

    @cached_property
    def differences(self) -> DataFrame:
        if not self.checks:
            return super().differences
        return self._bucket(MISMATCH).select(*self._key_columns(), self._differences().alias("differences"))

    def summary(self) -> DataFrame:
        if not self.checks:
            return super().summary()
        from tallyframe.sources.sql import remote_counts

        rows = self._open(remote_counts(self._text, self.compared))
        held = {c.lower(): F.coalesce(quoted(c).cast("long"), F.lit(0)) for c in rows.columns}
        named = [held[c].alias(c) for c in (ONLY_1, ONLY_2, "mismatched_rows", "exact_rows")]
        return self.row_counts().crossJoin(rows.select(*named)).withColumn("rules_not_understood", F.lit(sum(not r.understood for r in self.rules)).cast("long"))


def reconcile_remote(spark: SparkSession, url: str, query1: str, query2: str, config: ReconConfig, profile: str = "text", checks: str = "spark", legacy_numbers: bool = False, signed_percent: bool = False, row_rule: Callable | None = None, row_check: Callable | str | None = None, **options) -> RemoteResult:
    """Reconciles two queries on one database, which does the join, and with checks="database" the comparison; see RemoteResult.

    Of the classified rows and the breakdown only the joined rows are transferred. The buckets only_in_1 and only_in_2 and the
    row counts read the queries themselves. options: of the connection, such as user and password.
    """
    return RemoteResult(spark, url, query1, query2, config, profile, checks, legacy_numbers, signed_percent, row_rule, row_check, options)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows: of these a join makes every pair."""
    return df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


#: What totals are added up in: exactly, in any order, to six decimals.
TOTAL = "decimal(38,6)"


def grand_totals(result: ReconResult) -> DataFrame:
    """Per mapping of numbers: the sums of both tables and their difference, as decimals; a double counts as its value to six decimals."""
    maps, types = result.config.column_mappings, result.aligned.types
    numeric = [i for i in range(len(maps)) if all(t.typeName() in ("byte", "short", "integer", "long", "float", "double") or t.typeName().startswith("decimal") for t in types[i])]
    if not numeric:
        return result.df1.sparkSession.createDataFrame([], f"column string, total_1 {TOTAL}, total_2 {TOTAL}, difference {TOTAL}")
    side = lambda df, s: df.agg(*[F.sum(F.col(f"v{i}{s}").cast(TOTAL)).alias(f"s{i}") for i in numeric])
    unpack = lambda df, s: df.select(F.explode(F.array(*[F.struct(F.lit(maps[i].file1_column).alias("column"), F.col(f"s{i}").alias(f"total_{s}")) for i in numeric])).alias("x")).select("x.*")
    joined = unpack(side(result.aligned.left, 1), 1).join(unpack(side(result.aligned.right, 2), 2), "column")
    return joined.withColumn("difference", (F.col("total_1") - F.col("total_2")).cast(TOTAL))
