"""Behaviour of the reconciliation on small tables made for each case."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyframe.config import ColumnMap, ConfigError, ReconConfig, name_mapping, positional_mapping
from tallyframe.operators.reconcile import duplicate_keys, grand_totals, reconcile


def bucket(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def counts(result):
    s = result.summary().first()
    return s["only_in_1"], s["only_in_2"], s["mismatched_rows"], s["exact_rows"]


@pytest.fixture(scope="module")
def staff(spark):
    a = spark.createDataFrame([(1, "Ann", 100, "HR"), (2, "Bob", 200, "IT"), (3, "Cyd", 300, "HR"), (4, "Dee", 400, None)], "staff_id long, name string, pay long, dept string")
    b = spark.createDataFrame([(1, "Ann", 100, "HR"), (2, "bob", 205, "IT"), (4, "Dee", 400, None), (9, "Zed", 900, "IT")], "num long, `full.name` string, amount long, dept_code string")
    return a, b


MAPS = [("name", "full.name"), ("pay", "amount"), ("dept", "dept_code")]


def test_buckets_with_a_renamed_key(staff):
    found = reconcile(*staff, ReconConfig.of("staff_id", [("staff_id", "num"), *MAPS]))
    assert bucket(found.only_in_1, "staff_id", "name") == [(3, "Cyd")]
    assert bucket(found.only_in_2, "staff_id", "name") == [(9, "Zed")]
    assert bucket(found.mismatches, "staff_id", "pay_IsValid") == [(2, False)]
    assert bucket(found.exact, "staff_id") == [(1,), (4,)]
    assert counts(found) == (1, 1, 1, 2)


@pytest.mark.parametrize("profile", ["typed", "text"])
def test_a_row_is_never_lost_when_the_key_is_renamed_or_unmapped(spark, profile):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    b = spark.createDataFrame([(1, "x"), (3, "z")], "id long, v string")
    for maps in ([("v", "v")], [("id", "id"), ("v", "v")]):
        assert counts(reconcile(a, b, ReconConfig.of("id", maps), profile)) == (1, 1, 0, 1)
    assert counts(reconcile(a, b.withColumnRenamed("id", "n"), ReconConfig.of("id", [("id", "n"), ("v", "v")]), profile)) == (1, 1, 0, 1)


def test_null_cells_agree_in_the_typed_profile_only(staff):
    config = ReconConfig.of("staff_id", [("staff_id", "num"), ("dept", "dept_code")])
    assert counts(reconcile(*staff, config)) == (1, 1, 0, 3)
    assert counts(reconcile(*staff, config, "text")) == (1, 1, 1, 2)


def test_null_keys(spark):
    a = spark.createDataFrame([(None, 1), (1, 1)], "k long, v long")
    config = ReconConfig.of("k", {"v": "v"})
    assert counts(reconcile(a, a, config)) == (0, 0, 0, 2)
    assert counts(reconcile(a, a, config, "text")) == (1, 1, 0, 1)


def test_types(spark):
    a = spark.createDataFrame([(1, 5, 5, True, float("nan"), 0.0)], "k int, i long, t long, b boolean, n double, z double")
    b = spark.createDataFrame([(1, 5.0, "5", 1, None, -0.0)], "k long, i double, t string, b int, n double, z double")
    maps = {c: c for c in ("i", "t", "b", "n", "z")}
    row = reconcile(a, b, ReconConfig.of("k", maps)).classified.first()
    assert [row[f"{c}_IsValid"] for c in maps] == [True, False, True, True, True]
    row = reconcile(a, b, ReconConfig.of("k", maps), "text").classified.first()
    assert [row[f"{c}_IsValid"] for c in ("i", "t", "b", "n")] == [False, True, False, False]


def test_keys_of_types_that_do_not_compare(spark):
    a, b = spark.createDataFrame([(1,)], "k long"), spark.createDataFrame([("1",)], "k string")
    with pytest.raises(ConfigError, match="key"):
        reconcile(a, b, ReconConfig.of("k"))
    assert counts(reconcile(a, b, ReconConfig.of("k"), "text")) == (0, 0, 0, 1)


def test_no_mapping_makes_every_match_exact(staff):
    assert counts(reconcile(*staff, ReconConfig.of("staff_id", [("staff_id", "num")]))) == (1, 1, 0, 3)


@pytest.mark.parametrize("rule, bad", [("Must be within $5", []), ("within 4", [2]), ("within 2.5%", []), ("within 2%", [2]), ("+/-5", []), ("tolerance 1,000", []), ("as it is", [2]), (None, [2])])
def test_tolerances(staff, rule, bad):
    found = reconcile(*staff, ReconConfig.of("staff_id", [("staff_id", "num"), ("pay", "amount", rule)]))
    assert [r["staff_id"] for r in found.mismatches.collect()] == bad


def test_tolerance_of_texts_and_negative_percentages(spark):
    a = spark.createDataFrame([(1, "-100"), (2, "x"), (3, None)], "k long, v string")
    b = spark.createDataFrame([(1, "-101"), (2, "x"), (3, None)], "k long, v string")
    config = ReconConfig.of("k", [("v", "v", "within 5%")])
    assert [r["k"] for r in reconcile(a, b, config).mismatches.collect()] == [2]
    assert sorted(r["k"] for r in reconcile(a, b, config, signed_percent=True).mismatches.collect()) == [1, 2]
    assert sorted(r["k"] for r in reconcile(a, b, config, "text").mismatches.collect()) == [2, 3]


def test_case_and_unknown_rules(staff):
    rule = lambda r: reconcile(*staff, ReconConfig.of("staff_id", [("staff_id", "num"), ("name", "full.name", r)]))
    assert counts(rule("Ignore case"))[2] == 0
    assert counts(rule("ignore spaces"))[2] == 1
    assert rule("ignore spaces").summary().first()["rules_not_understood"] == 1


def test_rules_by_column_are_reported(staff):
    config = ReconConfig.of("staff_id", [("staff_id", "num"), ("pay", "amount")], rules={"pay": "within 1"})
    row = reconcile(*staff, config).breakdown.first()
    assert (row["Primary Key"], row["Column"], row["File 1 Value"], row["File 2 Value"], row["Validation Rule"], row["Remarks"]) == ("staff_id=2", "pay -> amount", "200", "205", "within 1", "Failed Rule: within 1")


def test_breakdown_has_a_row_for_each_failing_cell(staff):
    found = reconcile(*staff, ReconConfig.of("staff_id", [("staff_id", "num"), *MAPS]))
    assert [r["Column"] for r in found.breakdown.collect()] == ["name -> full.name", "pay -> amount"]
    assert [d["column"] for d in found.differences.first()["differences"]] == ["name", "pay"]


def test_composite_and_duplicate_keys(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3)], "x long, y string, v long")
    found = reconcile(a, a, ReconConfig.of(["x", "y"], {"v": "v"}))
    assert counts(found) == (0, 0, 2, 3)
    assert bucket(duplicate_keys(a, ["x", "y"]), "x", "y", "rows") == [(1, "a", 2)]


def test_column_names_that_could_clash(spark):
    a = spark.createDataFrame([(1, "p", "q", "r")], "`k``1` long, `v_f1` string, `a.b c` string, p1 string")
    b = spark.createDataFrame([(1, "p", "q", "r", "other")], "num long, `v_f2` string, c string, k01 string, `v_f1` string")
    found = reconcile(a, b, ReconConfig.of("k`1", [("k`1", "num"), ("v_f1", "v_f2"), ("a.b c", "c"), ("p1", "k01")]))
    assert counts(found) == (0, 0, 0, 1)
    assert found.exact.columns[0] == "k`1"


def test_one_column_of_the_second_table_may_serve_twice(spark):
    a, b = spark.createDataFrame([(1, 2, 3)], "k long, x long, y long"), spark.createDataFrame([(1, 2)], "k long, z long")
    found = reconcile(a, b, ReconConfig.of("k", [("x", "z"), ("y", "z")]))
    assert found.classified.columns == ["k", "File1_x", "File2_z", "File1_y", "File2_z_for_y", "x_IsValid", "y_IsValid", "_status"]
    assert counts(found) == (0, 0, 1, 0)


def test_configurations_that_do_not_fit(staff):
    bad = [ReconConfig([], []), ReconConfig.of("nope"), ReconConfig.of("staff_id", [("staff_id", "num"), ("pay", "gone")]), ReconConfig("staff_id".split(), [ColumnMap("pay", "amount"), ColumnMap("pay", "num")]), ReconConfig.of("staff_id", [("staff_id", "num")], ignore_columns=["staff_id"])]
    for config in bad:
        with pytest.raises(ConfigError):
            reconcile(*staff, config)
    skipped = reconcile(*staff, ReconConfig.of("staff_id", [("staff_id", "num"), ("pay", "gone")]), on_missing="skip")
    assert counts(skipped) == (1, 1, 0, 3)


def test_maps_are_refused(spark):
    a = spark.createDataFrame([(1, {"a": 1})], "k long, m map<string,int>")
    with pytest.raises(ConfigError, match="map"):
        reconcile(a, a, ReconConfig.of("k", {"m": "m"}))


def test_nested_columns(spark):
    a = spark.createDataFrame([(1, [1, 2], (1, "x"))], "k long, a array<int>, s struct<i:int,t:string>")
    assert counts(reconcile(a, a, ReconConfig.of("k", {"a": "a", "s": "s"}))) == (0, 0, 0, 1)


def test_empty_tables(spark):
    a = spark.createDataFrame([], "k long, v long")
    b = spark.createDataFrame([(1, 2)], "k long, v long")
    config = ReconConfig.of("k", {"v": "v"})
    assert counts(reconcile(a, b, config)) == (0, 1, 0, 0)
    assert counts(reconcile(a, a, config)) == (0, 0, 0, 0)
    assert grand_totals(reconcile(a, b, config)).first()["total_2"] == 2.0


def test_python_row_rules(staff):
    def rule(row):
        if row["staff_id"] == 1:
            raise ValueError("boom")
        return [{"column": "pay", "error": "differs", "file1_value": row["pay_f1"]}] if row["pay_f1"] != row["pay_f2"] else None

    found = reconcile(*staff, ReconConfig.of("staff_id", [("staff_id", "num"), ("pay", "amount", "within 100")]), row_rule=rule)
    cells = {r["staff_id"]: r["differences"][0] for r in found.differences.collect()}
    assert (cells[1]["column"], cells[1]["error"]) == ("Rule Execution Error", "boom")
    assert (cells[2]["file1_value"], cells[2]["file2_value"]) == ("200", "N/A")
    assert set(cells) == {1, 2}


def test_sql_row_checks(staff):
    config = ReconConfig.of("staff_id", [("staff_id", "num"), ("pay", "amount", "within 100")])
    found = reconcile(*staff, config, row_check="abs(pay_f1 - pay_f2) <= 2")
    assert [r["staff_id"] for r in found.mismatches.collect()] == [2]
    assert found.breakdown.first()["Remarks"] == "Rule violation"
    for text in ("reflect('java.lang.System', 'exit')", "pay_f1 = other", "(select 1) = 1", "pay_f1 = 1; drop"):
        with pytest.raises(ConfigError):
            reconcile(*staff, config, row_check=text).summary()


def test_mappings_by_position_and_name():
    assert [(m.file1_column, m.file2_column) for m in positional_mapping(["a", "b", "c"], ["x", "y"]).column_mappings] == [("a", "x"), ("b", "y")]
    assert [(m.file1_column, m.file2_column) for m in name_mapping(["A", "b"], ["B", "a", "c"], ["A"]).column_mappings] == [("A", "a"), ("b", "B")]


def test_only_compared_columns_are_read(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = reconcile(orders, orders, ReconConfig.of("o_orderkey", {"o_orderstatus": "o_orderstatus"}))
    plan = found.summary()._jdf.queryExecution().executedPlan().toString()
    assert "o_custkey" not in plan and "o_totalprice" not in plan and "Python" not in plan


def test_buckets_of_pairs_need_no_outer_join(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    config = ReconConfig.of("o_orderkey", {"o_orderstatus": "o_orderstatus"})
    found = reconcile(orders, orders, config)
    for df in (found.matched, found.mismatches, found.exact, found.breakdown, found.only_in_1, found.only_in_2):
        assert "FullOuter" not in df._jdf.queryExecution().executedPlan().toString()
    kept = reconcile(orders, orders, config).persist()
    assert kept.exact.count() == found.exact.count() == orders.count()
    assert "InMemoryTableScan" in kept.exact._jdf.queryExecution().executedPlan().toString()
    kept.unpersist()


cells = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.one_of(st.none(), st.integers(0, 2))), max_size=8)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cells, cells, st.sampled_from(["typed", "text"]))
def test_properties(spark, one, two, profile):
    a, b = (spark.createDataFrame(x, "k long, v long") for x in (one, two))
    config = ReconConfig.of("k", {"v": "v"})
    found, turned = reconcile(a, b, config, profile), reconcile(b, a, config, profile)
    only1, only2, bad, good = counts(found)
    assert only1 + only2 + bad + good == found.classified.count()
    assert counts(turned) == (only2, only1, bad, good)
    assert counts(reconcile(a, b, config, profile, join="split")) == (only1, only2, bad, good)
    assert (found.only_in_1.count(), found.only_in_2.count()) == (only1, only2)
    assert (found.mismatches.count(), found.exact.count(), found.matched.count()) == (bad, good, bad + good)
    kept = reconcile(a, b, config, profile).persist()
    assert sorted(map(str, kept.matched.collect())) == sorted(map(str, found.matched.collect()))
    kept.unpersist()
    assert found.breakdown.count() >= bad and (found.breakdown.count() > 0) == (bad > 0)
    if profile == "typed":
        pairs = sum(x[0] == y[0] for x in one for y in two)
        assert bad + good == pairs
        unique = {k: v for k, v in one}
        own = spark.createDataFrame(list(unique.items()), "k long, v long")
        assert counts(reconcile(own, own, config)) == (0, 0, 0, len(unique))


def test_join_is_chosen_by_the_keys(spark):
    even = spark.range(20_000).selectExpr("id", "id as v")
    hot = spark.range(20_000).selectExpr("if(id % 3 = 0, -1, id) as id", "id as v")
    plan = lambda r: r.classified._jdf.queryExecution().optimizedPlan().toString()
    config = ReconConfig.of("id", {"v": "v"})
    assert "FullOuter" in plan(reconcile(even, even, config, join="auto"))
    few = spark.createDataFrame([(-1, 0), (5, 5), (30_000, 1)], "id long, v long")
    for a, b in ((hot, few), (few, hot)):
        found = reconcile(a, b, config, join="auto")
        assert "FullOuter" not in plan(found)
        assert found.summary().first() == reconcile(a, b, config).summary().first()
