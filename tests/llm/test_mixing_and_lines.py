import random
import re
import time
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import line_dedup, mixing
from tallyframe.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, `__drop` string, cap string"


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 7, "x", "y") for i, t, s in rows], SCHEMA)


def rows_like_sql(spark, docs, got, sql):
    db = duckdb.connect()
    db.register("documents", docs.toArrow())
    expected = db.sql(sql).to_arrow_table()
    norm = lambda t: sorted(repr([r[c] for c in sorted(t.column_names)]) for r in t.to_pylist())
    assert norm(got.toArrow()) == norm(expected)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "a", "a", "b", "ä", None])) for i in range(400)]
    rows += [(400, None, "b"), (401, "", "c"), (7, "one two three", "a"), (7, "one two three", "a"), (None, "x y", "b"), (402, "w " * 40_000, "a")]
    return table(spark, rows)


def test_mix_equals_sql_on_awkward_rows(spark, mixed):
    got = mixing.mix(mixed).select("doc_id", "size", "source_size", "target", "taken")
    rows_like_sql(spark, mixed.filter("doc_id is null or doc_id != 7"), mixing.mix(mixed.filter("doc_id is null or doc_id != 7")).select(*got.columns), mixing.OP1_SQL)
    twice = [r["taken"] for r in got.filter("doc_id = 7").collect()]
    assert len(twice) == 3


def test_mix_keeps_its_bounds(mixed):
    rows = mixing.mix(mixed).collect()
    assert len(rows) == 406
    taken, target, whole, largest = defaultdict(int), {}, {}, defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]], whole[r["source"]] = r["target"], r["source_size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert sum(target.values()) == pytest.approx(1.5 * sum(whole.values()))
    for s in target:
        assert target[s] <= 2 * whole[s] and abs(taken[s] - target[s]) <= largest[s]


def test_budgets_nest(mixed):
    small = {r["doc_id"] for r in mixing.mix(mixed, share=0.3).filter("copies > 0 and size > 0").collect()}
    large = {r["doc_id"] for r in mixing.mix(mixed, share=0.6).filter("copies > 0 and size > 0").collect()}
    assert small < large


def test_targets_refill(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 0)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(sources).collect()}
    assert found["a"] == 20 and found["d"] == 0
    assert found["b"] == pytest.approx(2 * found["c"]) and sum(found.values()) == pytest.approx(3015)


def test_ranks_of_many_sources(spark):
    names = [f"host{k}" for k in range(3000)]
    random.Random(1).shuffle(names)
    rows = spark.createDataFrame([(n, 1) for n in [*names, None]], "source string, source_size long")
    found = {r["source"]: r["rank"] for r in mixing.ranked(rows, F.col("source").isNull(), F.col("source")).collect()}
    assert found == {n: k for k, n in enumerate([*sorted(names), None])}
    plan = mixing.targets(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_apply_repeats_rows(mixed):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(mixed.filter("doc_id != 7")).collect()}
    out = mixing.apply_mix(mixed.filter("doc_id != 7"))
    assert out.columns == mixed.columns
    seen = defaultdict(int)
    for r in out.collect():
        seen[r["doc_id"]] += 1
    assert dict(seen) == {k: v for k, v in copies.items() if v}


def test_lookup_by_salt_equals_broadcast(mixed, monkeypatch):
    from tallyframe.llm import common

    plain = sorted(map(str, mixing.mix(mixed).collect()))
    monkeypatch.setattr(common, "fits", lambda *a, **k: False)
    assert sorted(map(str, mixing.mix(mixed).collect())) == plain


def test_empty(spark):
    empty = table(spark, [])
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0 and line_dedup.dedup_lines(empty).count() == 0


@pytest.fixture(scope="module")
def lined(spark):
    rng = random.Random(3)
    common = ["All rights kept here", "Accept the cookies now please", "Of.", "   ", "two words"]
    rows = []
    for i in range(300):
        lines = [f"line {i} number {k} of words" for k in range(rng.randrange(4))] + [c for c in common if rng.random() < 0.5]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), f"s{rng.randrange(12)}" if rng.random() < 0.9 else None))
    for k in range(3, 9):  # spreads about the threshold
        rows += [(1000 + 10 * k + j, f"spread over exactly {k} sites\nown {k} {j} text line", f"t{j}") for j in range(k)]
        rows += [(2000 + 10 * k + j, f"many times {k} on one site\nlast\n", "t0") for j in range(k)]
    rows += [(3000, None, "s1"), (3001, "", "s2"), (3002, "All rights kept here", "s3"), (3003, "All rights kept here\n" * 3, "s4"), (3004, "long word " * 30_000, "s5")]
    return table(spark, rows)


def test_lines_equal_sql_on_awkward_rows(spark, lined):
    got = line_dedup.dedup_lines(lined.select("doc_id", "text", "source")).drop("source")
    rows_like_sql(spark, lined, got, line_dedup.OP2_SQL)


def test_lines_exact_decision_is_used(spark, lined):
    """With a coarse sketch and a band that takes in everything, exact counts give the same result."""
    wide = line_dedup.dedup_lines(lined.select("doc_id", "text", "source"), band=0.99).collect()
    usual = line_dedup.dedup_lines(lined.select("doc_id", "text", "source")).collect()
    assert sorted(map(str, wide)) == sorted(map(str, usual))


def test_lines_keep_columns_and_repeated_rows(spark, lined):
    out = line_dedup.dedup_lines(lined.unionByName(lined))
    assert out.columns == [*lined.columns, "n_lines", "n_removed"]
    assert out.count() == 2 * lined.count()
    first = [r for r in out.filter("doc_id >= 3002 and doc_id < 3004").collect()]
    assert {r["text"] for r in first if r["doc_id"] == 3002} == {""}
    assert all(re.fullmatch(r"\n*", r["text"]) for r in first)


def test_lines_of_scripts_without_spaces(spark):
    sentence, menu = "\u8fd9\u662f\u4e00\u53e5\u6ca1\u6709\u7a7a\u683c\u7684\u5f88\u957f\u7684\u53e5\u5b50\u3002\u5728\u6bcf\u4e2a\u7f51\u7ad9", "\u9996\u9875"
    docs = table(spark, [(i, f"{sentence}\n{menu}\nown {i}", f"s{i}") for i in range(6)])
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert found[0] == f"{sentence}\n{menu}\nown 0" and found[5] == f"{menu}\nown 5"


def test_time_grows_with_the_text(spark):
    """A line of a million characters without a space, and documents that lose tens of thousands of lines each."""
    many = [f"line {k} of all sites" for k in range(60_000)]
    rows = [(i, "\n".join([f"own {i}", *many[:i], f"mine {i}", *many[i:], f"end {i}"]), f"s{i}") for i in range(6)]
    docs = table(spark, [*rows, (100, "x" * 1_000_000, "s0"), (101, "y" * 2_000_000, "s1")])
    began = time.monotonic()
    found = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert time.monotonic() - began < 60
    assert found[0]["text"] == rows[0][1] and found[100]["text"] == "x" * 1_000_000
    for i in range(1, 6):
        assert found[i]["text"] == f"own {i}\nmine {i}\nend {i}" and found[i]["n_removed"] == 60_000


def test_lines_leave_columns_alone(spark, lined):
    odd = lined.select("*", F.lit(7).alias("n_lines"), F.lit("x").alias("a.b"), F.lit(1).alias("row"), F.lit(2).alias("th"), F.lit(3).alias("gone"))
    out = line_dedup.dedup_lines(odd, counts=False)
    assert out.columns == odd.columns
    assert {tuple(r)[-5:] for r in out.collect()} == {(7, "x", 1, 2, 3)}


def test_lines_run_without_python(spark, lined):
    plan = line_dedup.dedup_lines(lined)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
