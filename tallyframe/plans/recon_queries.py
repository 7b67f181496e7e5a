"""Queries over the test tables, each with equivalent SQL.

The first table is orders, with o_orderpriority null at every 38th key. The second is made from orders: renamed, without
every 97th key, with extra keys from 10,000,000 on, and with changes at multiples of 11 (status in lower case), 13, 17 and
23 (total) and 19 (priority null).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.config import ReconConfig, name_mapping
from tallyframe.operators.reconcile import ReconResult, duplicate_keys, grand_totals, reconcile

STATUS, TOTAL, PRIORITY = ("o_orderstatus", "status"), ("o_totalprice", "total"), ("o_orderpriority", "priority")
KEY = ("o_orderkey", "order_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 38 != 0, F.col("o_orderpriority")))


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    total = F.col("o_totalprice")
    total = F.when(k % 13 == 0, total + 3.0).when(k % 17 == 0, total * 1.02).when(k % 23 == 0, total * 1.5).otherwise(total)
    status = F.when(k % 11 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))
    names = lambda key: [key.alias("order_id"), F.col("o_custkey").alias("cust_id"), status.alias("status"), total.alias("total"), F.col("o_orderdate").alias("placed_at"), F.when(k % 19 != 0, F.col("o_orderpriority")).alias("priority")]
    return orders.filter(k % 97 != 0).select(*names(k)).unionByName(orders.filter(k % 101 == 0).select(*names(k + 10_000_000)))


def orders_result(spark: SparkSession, sf_dir: str, *mappings: tuple, keyed: bool = True, ignore: tuple = (), **options) -> ReconResult:
    config = ReconConfig.of("o_orderkey", [*([KEY] if keyed else []), *mappings], ignore_columns=list(ignore))
    return reconcile(first(spark, sf_dir), second(spark, sf_dir), config, **options)


RULED = [(*STATUS, "Ignore case"), (*TOTAL, "within 5%"), PRIORITY]


def _bad_keys(result: ReconResult) -> DataFrame:
    return result.mismatches.select("o_orderkey")


def _swapped(s: SparkSession, d: str) -> DataFrame:
    config = ReconConfig.of("order_id", [("order_id", "o_orderkey"), ("status", "o_orderstatus")])
    return reconcile(second(s, d), first(s, d), config).summary().drop("rules_not_understood")


def _nation(profile: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        nation = table(s, d, "nation").withColumn("n_regionkey", F.nullif("n_regionkey", F.lit(3)))
        found = reconcile(nation, nation, ReconConfig.of("n_regionkey", [("n_nationkey", "n_nationkey")]), profile).classified
        return found.select("n_regionkey", "File1_n_nationkey", "File2_n_nationkey", "_status")

    return run


def _percent(signed: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        customer = table(s, d, "customer")
        config = ReconConfig.of("c_custkey", [("c_acctbal", "c_acctbal", "within 5%")])
        return reconcile(customer, customer, config, signed_percent=signed).mismatches.select("c_custkey")

    return run


def _composite(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem")
    config = ReconConfig.of(["l_orderkey", "l_linenumber"], [("l_quantity", "l_quantity")])
    found = reconcile(lines, lines, config).classified
    return found.groupBy("_status").agg(F.count(F.lit(1)).alias("pairs"))


def _lines(profile: str) -> Callable[[SparkSession, str], DataFrame]:
    """lineitem, whose keys repeat, with itself: every 97th order gone, quantities and flags changed."""

    def run(s: SparkSession, d: str) -> DataFrame:
        lines, k = table(s, d, "lineitem"), F.col("l_orderkey")
        changed = lines.filter(k % 97 != 0).select(
            k.alias("order_no"), F.col("l_linenumber").alias("line_no"),
            F.when(k % 13 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("quantity"),
            F.when(k % 11 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag")).alias("flag"),
        )
        config = ReconConfig.of(["l_orderkey", "l_linenumber"], [("l_orderkey", "order_no"), ("l_linenumber", "line_no"), ("l_quantity", "quantity"), ("l_returnflag", "flag", "Ignore case")])
        return reconcile(lines, changed, config, profile).summary().drop("rules_not_understood")

    return run


def _by_name(s: SparkSession, d: str) -> DataFrame:
    a, b = table(s, d, "supplier"), table(s, d, "supplier").filter("s_suppkey % 7 != 0")
    b = b.select(*[F.col(c).alias(c.upper()) for c in b.columns])
    return reconcile(a, b, name_mapping(a.columns, b.columns, ["s_suppkey"])).summary().drop("rules_not_understood")


def _totals(s: SparkSession, d: str) -> DataFrame:
    found = grand_totals(orders_result(s, d, ("o_custkey", "cust_id"), TOTAL)).filter("column != 'o_orderkey'")
    return found.select("column", *[F.col(c).cast("double").alias(c) for c in ("total_1", "total_2", "difference")])


def _types(s: SparkSession, d: str) -> DataFrame:
    """Keys of two integer types, a whole number against a double, and a number against a text."""
    a = table(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("twin"))
    b = a.select(F.col("o_orderkey").cast("decimal(20,0)").alias("o_orderkey"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") + 0.5).otherwise(F.col("o_custkey")).cast("double").alias("o_custkey"), F.col("twin").cast("string").alias("twin"))
    found = reconcile(a, b, ReconConfig.of("o_orderkey", {"o_custkey": "o_custkey", "twin": "twin"})).classified
    return found.groupBy("o_custkey_IsValid", "twin_IsValid").agg(F.count(F.lit(1)).alias("n"))


def _null_cells(s: SparkSession, d: str) -> DataFrame:
    found = orders_result(s, d, PRIORITY, profile="text").mismatches
    return found.select("o_orderkey", F.col("o_orderpriority_IsValid").alias("is_valid"))


def _events(s: SparkSession, d: str) -> DataFrame:
    """Reconciles the events with themselves, a third of them a second later."""
    events = table(s, d, "events").select("event_id", "ts")
    late = events.select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("interval 1 second")).otherwise(F.col("ts")).alias("ts"))
    return reconcile(events, late, ReconConfig.of("event_id", {"ts": "ts"})).mismatches.select("event_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "source_row_count": lambda s, d: orders_result(s, d, STATUS).row_counts().select("total_rows_1"),
    "target_row_count": lambda s, d: orders_result(s, d, STATUS).row_counts().select("total_rows_2"),
    "only_in_target": lambda s, d: orders_result(s, d, STATUS, PRIORITY).only_in_2,
    "only_in_source": lambda s, d: orders_result(s, d, STATUS, PRIORITY).only_in_1,
    "matched_pairs": lambda s, d: orders_result(s, d, STATUS).matched.select("o_orderkey", "File1_o_orderstatus", "File2_status"),
    "status_strict": lambda s, d: _bad_keys(orders_result(s, d, STATUS)),
    "status_ignore_case": lambda s, d: _bad_keys(orders_result(s, d, (*STATUS, "Ignore case"))),
    "total_strict": lambda s, d: _bad_keys(orders_result(s, d, TOTAL)),
    "total_within_5": lambda s, d: _bad_keys(orders_result(s, d, (*TOTAL, "Must be within $5"))),
    "total_within_5pct": lambda s, d: _bad_keys(orders_result(s, d, (*TOTAL, "within 5%"))),
    "total_decimal_tolerance": lambda s, d: _bad_keys(orders_result(s, d, (*TOTAL, "+/-2.5"))),
    "priority_typed": lambda s, d: _bad_keys(orders_result(s, d, PRIORITY)),
    "priority_text": lambda s, d: _bad_keys(orders_result(s, d, PRIORITY, profile="text")),
    "null_cells_text": _null_cells,
    "mismatch_rows_strict": lambda s, d: _bad_keys(orders_result(s, d, STATUS, TOTAL, PRIORITY)),
    "mismatch_rows_ruled": lambda s, d: _bad_keys(orders_result(s, d, *RULED)),
    "exact_matches": lambda s, d: orders_result(s, d, STATUS, TOTAL, PRIORITY).exact.select("o_orderkey"),
    "exact_matches_ruled": lambda s, d: orders_result(s, d, *RULED).exact.select("o_orderkey"),
    "breakdown_cells": lambda s, d: orders_result(s, d, STATUS, PRIORITY).breakdown,
    "breakdown_ruled": lambda s, d: orders_result(s, d, *RULED).breakdown.select("o_orderkey", "Column", "Validation Rule", "Remarks"),
    "differences_per_row": lambda s, d: orders_result(s, d, STATUS, TOTAL, PRIORITY).differences.select("o_orderkey", F.size("differences").cast("long").alias("cells")),
    "summary": lambda s, d: orders_result(s, d, STATUS, TOTAL, PRIORITY).summary().drop("rules_not_understood"),
    "summary_split_join": lambda s, d: orders_result(s, d, STATUS, TOTAL, PRIORITY, join="split").summary().drop("rules_not_understood"),
    "full_classified": lambda s, d: orders_result(s, d, STATUS, PRIORITY).classified,
    "signed_percent_legacy": _percent(True),
    "abs_percent": _percent(False),
    "null_key_eq": _nation("text"),
    "null_key_nullsafe": _nation("typed"),
    "composite_key_dups": _composite,
    "lines_typed": _lines("typed"),
    "lines_text": _lines("text"),
    "duplicate_keys": lambda s, d: duplicate_keys(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "unmapped_key": lambda s, d: reconcile(first(s, d), first(s, d).filter("o_orderkey % 7 != 0"), ReconConfig.of("o_orderkey", {"o_custkey": "o_custkey"})).summary().drop("rules_not_understood"),
    "ignored_column": lambda s, d: _bad_keys(orders_result(s, d, STATUS, TOTAL, ignore=("o_totalprice",))),
    "swapped_sides": _swapped,
    "sample_rows": lambda s, d: first(s, d).orderBy("o_orderkey").limit(5).select("o_orderkey", "o_orderstatus"),
    "mapped_by_name": _by_name,
    "grand_totals": _totals,
    "mixed_types": _types,
    "row_check": lambda s, d: _bad_keys(orders_result(s, d, (*TOTAL, "within 1000000"), row_check="o_totalprice_f2 >= o_totalprice_f1 and o_totalprice_f2 < 1.4 * o_totalprice_f1")),
    "event_times": _events,
}

_FIRST = "f AS (SELECT * REPLACE (CASE WHEN o_orderkey % 38 <> 0 THEN o_orderpriority END AS o_orderpriority) FROM orders)"

_SECOND = """
t AS (
  SELECT o_orderkey AS k, o_orderkey AS order_id, o_custkey AS cust_id,
         CASE WHEN o_orderkey % 11 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS status,
         CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 3.0::DOUBLE WHEN o_orderkey % 17 = 0 THEN o_totalprice * 1.02::DOUBLE
              WHEN o_orderkey % 23 = 0 THEN o_totalprice * 1.5::DOUBLE ELSE o_totalprice END AS total,
         o_orderdate AS placed_at, CASE WHEN o_orderkey % 19 <> 0 THEN o_orderpriority END AS priority FROM orders),
g AS (
  SELECT * EXCLUDE (k) FROM t WHERE k % 97 <> 0
  UNION ALL SELECT * EXCLUDE (k) REPLACE (order_id + 10000000 AS order_id) FROM t WHERE k % 101 = 0)"""

_WITH = f"WITH {_FIRST},{_SECOND},\nm AS (SELECT * FROM f JOIN g ON o_orderkey = order_id)\n"

_STATUS, _TOTAL, _PRIORITY = "o_orderstatus IS NOT DISTINCT FROM status", "o_totalprice IS NOT DISTINCT FROM total", "o_orderpriority IS NOT DISTINCT FROM priority"
_NEAR = "coalesce(abs(o_totalprice - total) <= abs(o_totalprice) * 5.0::DOUBLE / 100.0::DOUBLE, false)"
_CASE = "coalesce(lower(o_orderstatus) = lower(status), false)"
_STRICT = f"{_STATUS} AND {_TOTAL} AND {_PRIORITY}"
_RULES = f"{_CASE} AND {_NEAR} AND {_PRIORITY}"


def _bad(test: str) -> str:
    return f"{_WITH}SELECT o_orderkey FROM m WHERE NOT ({test})"


def _good(test: str) -> str:
    return f"{_WITH}SELECT o_orderkey FROM m WHERE {test}"


_SUMMARY = f"""{_WITH}
SELECT (SELECT count(*) FROM f) AS total_rows_1, (SELECT count(*) FROM g) AS total_rows_2,
       (SELECT count(*) FROM f) - (SELECT count(*) FROM g) AS row_count_difference,
       (SELECT count(*) FROM f ANTI JOIN g ON o_orderkey = order_id) AS only_in_1,
       (SELECT count(*) FROM g ANTI JOIN f ON o_orderkey = order_id) AS only_in_2,
       (SELECT count(*) FROM m WHERE NOT ({_STRICT})) AS mismatched_rows, (SELECT count(*) FROM m WHERE {_STRICT}) AS exact_rows"""

_CELL = """SELECT o_orderkey, 'o_orderkey=' || o_orderkey AS "Primary Key", '{c1} -> {c2}' AS "Column", {c1} AS "File 1 Value", {c2} AS "File 2 Value",
       '' AS "Validation Rule", 'Exact Match Failed' AS "Remarks" FROM m WHERE NOT ({test})"""

_RULED_CELL = """SELECT o_orderkey, '{c1} -> {c2}' AS "Column", '{rule}' AS "Validation Rule", '{remark}' AS "Remarks" FROM m WHERE NOT ({test})"""


def _nation_sql(on: str) -> str:
    return f"""
WITH n AS (SELECT n_nationkey, nullif(n_regionkey, 3) AS r FROM nation)
SELECT coalesce(a.r, b.r) AS n_regionkey, a.n_nationkey AS "File1_n_nationkey", b.n_nationkey AS "File2_n_nationkey",
       CASE WHEN a.n_nationkey IS NULL THEN 'only_in_2' WHEN b.n_nationkey IS NULL THEN 'only_in_1'
            WHEN a.n_nationkey = b.n_nationkey THEN 'exact' ELSE 'mismatch' END AS _status
FROM n a FULL OUTER JOIN n b ON {on}"""


_LINES = """
WITH c AS (
  SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_orderkey % 13 = 0 THEN l_quantity + 1 ELSE l_quantity END AS q, l_returnflag AS r FROM lineitem WHERE l_orderkey % 97 <> 0),
p AS (SELECT l_quantity = q AND l_returnflag = r AS good FROM lineitem JOIN c ON l_orderkey = k AND l_linenumber = n),
t AS (SELECT (SELECT count(*) FROM lineitem) AS a, (SELECT count(*) FROM c) AS b)
SELECT a AS total_rows_1, b AS total_rows_2, a - b AS row_count_difference, a - b AS only_in_1, 0::BIGINT AS only_in_2,
       (SELECT count(*) FROM p WHERE NOT good) AS mismatched_rows, (SELECT count(*) FROM p WHERE good) AS exact_rows FROM t"""


ORACLES: dict[str, str] = {
    "source_row_count": "SELECT count(*) AS total_rows_1 FROM orders",
    "target_row_count": f"{_WITH}SELECT count(*) AS total_rows_2 FROM g",
    "only_in_target": f"{_WITH}SELECT order_id AS o_orderkey, status AS o_orderstatus, priority AS o_orderpriority FROM g ANTI JOIN f ON o_orderkey = order_id",
    "only_in_source": f"{_WITH}SELECT o_orderkey, o_orderstatus, o_orderpriority FROM f ANTI JOIN g ON o_orderkey = order_id",
    "matched_pairs": f'{_WITH}SELECT o_orderkey, o_orderstatus AS "File1_o_orderstatus", status AS "File2_status" FROM m',
    "status_strict": _bad(_STATUS),
    "status_ignore_case": _bad(_CASE),
    "total_strict": _bad(_TOTAL),
    "total_within_5": _bad("coalesce(abs(o_totalprice - total) <= 5, false)"),
    "total_within_5pct": _bad(_NEAR),
    "total_decimal_tolerance": _bad("coalesce(abs(o_totalprice - total) <= 2.5::DOUBLE, false)"),
    "priority_typed": _bad(_PRIORITY),
    "priority_text": _bad("coalesce(o_orderpriority = priority, false)"),
    "null_cells_text": f"{_WITH}SELECT o_orderkey, false AS is_valid FROM m WHERE NOT coalesce(o_orderpriority = priority, false)",
    "mismatch_rows_strict": _bad(_STRICT),
    "mismatch_rows_ruled": _bad(_RULES),
    "exact_matches": _good(_STRICT),
    "exact_matches_ruled": _good(_RULES),
    "breakdown_cells": _WITH + _CELL.format(c1="o_orderstatus", c2="status", test=_STATUS) + "\nUNION ALL " + _CELL.format(c1="o_orderpriority", c2="priority", test=_PRIORITY),
    "breakdown_ruled": _WITH + "\nUNION ALL ".join([
        _RULED_CELL.format(c1="o_orderstatus", c2="status", rule="Ignore case", remark="Failed Rule: Ignore case", test=_CASE),
        _RULED_CELL.format(c1="o_totalprice", c2="total", rule="within 5%", remark="Failed Rule: within 5%", test=_NEAR),
        _RULED_CELL.format(c1="o_orderpriority", c2="priority", rule="", remark="Exact Match Failed", test=_PRIORITY),
    ]),
    "differences_per_row": f"{_WITH}SELECT o_orderkey, (NOT ({_STATUS}))::BIGINT + (NOT ({_TOTAL}))::BIGINT + (NOT ({_PRIORITY}))::BIGINT AS cells FROM m WHERE NOT ({_STRICT})",
    "summary": _SUMMARY,
    "summary_split_join": _SUMMARY,
    "full_classified": f"""{_WITH}
SELECT coalesce(o_orderkey, order_id) AS o_orderkey, o_orderkey AS "File1_o_orderkey", order_id AS "File2_order_id",
       o_orderstatus AS "File1_o_orderstatus", status AS "File2_status", o_orderpriority AS "File1_o_orderpriority", priority AS "File2_priority",
       CASE WHEN o_orderkey = order_id THEN {_STATUS} END AS "o_orderstatus_IsValid", CASE WHEN o_orderkey = order_id THEN {_PRIORITY} END AS "o_orderpriority_IsValid",
       CASE WHEN o_orderkey IS NULL THEN 'only_in_2' WHEN order_id IS NULL THEN 'only_in_1' WHEN {_STATUS} AND {_PRIORITY} THEN 'exact' ELSE 'mismatch' END AS _status
FROM f FULL OUTER JOIN g ON o_orderkey = order_id""",
    "signed_percent_legacy": "SELECT c_custkey FROM customer WHERE NOT coalesce(0 <= c_acctbal * 5.0 / 100.0, false) AND c_acctbal IS NOT NULL",
    "abs_percent": "SELECT c_custkey FROM customer WHERE c_acctbal IS NOT NULL AND NOT 0 <= abs(c_acctbal) * 5.0 / 100.0",
    "null_key_eq": _nation_sql("a.r = b.r"),
    "null_key_nullsafe": _nation_sql("a.r IS NOT DISTINCT FROM b.r"),
    "composite_key_dups": """
SELECT CASE WHEN a.l_quantity IS NOT DISTINCT FROM b.l_quantity THEN 'exact' ELSE 'mismatch' END AS _status, count(*) AS pairs
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1""",
    "lines_typed": _LINES,
    "lines_text": _LINES,
    "duplicate_keys": 'SELECT l_orderkey, l_linenumber, count(*) AS "rows" FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1',
    "unmapped_key": """
WITH n AS (SELECT count(*) AS a, count(*) FILTER (WHERE o_orderkey % 7 <> 0) AS b FROM orders)
SELECT a AS total_rows_1, b AS total_rows_2, a - b AS row_count_difference, a - b AS only_in_1, 0::BIGINT AS only_in_2, 0::BIGINT AS mismatched_rows, b AS exact_rows FROM n""",
    "ignored_column": _bad(_STATUS),
    "swapped_sides": f"""{_WITH}
SELECT (SELECT count(*) FROM g) AS total_rows_1, (SELECT count(*) FROM f) AS total_rows_2, (SELECT count(*) FROM g) - (SELECT count(*) FROM f) AS row_count_difference,
       (SELECT count(*) FROM g ANTI JOIN f ON o_orderkey = order_id) AS only_in_1, (SELECT count(*) FROM f ANTI JOIN g ON o_orderkey = order_id) AS only_in_2,
       (SELECT count(*) FROM m WHERE NOT ({_STATUS})) AS mismatched_rows, (SELECT count(*) FROM m WHERE {_STATUS}) AS exact_rows""",
    "sample_rows": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5",
    "mapped_by_name": """
WITH n AS (SELECT count(*) AS a, count(*) FILTER (WHERE s_suppkey % 7 <> 0) AS b FROM supplier)
SELECT a AS total_rows_1, b AS total_rows_2, a - b AS row_count_difference, a - b AS only_in_1, 0::BIGINT AS only_in_2, 0::BIGINT AS mismatched_rows, b AS exact_rows FROM n""",
    "grand_totals": _WITH + "\nUNION ALL ".join(
        f"""SELECT '{x}' AS "column", (SELECT sum({x}::DECIMAL(38,6)) FROM f)::DOUBLE AS total_1, (SELECT sum({y}::DECIMAL(38,6)) FROM g)::DOUBLE AS total_2,
       ((SELECT sum({x}::DECIMAL(38,6)) FROM f) - (SELECT sum({y}::DECIMAL(38,6)) FROM g))::DOUBLE AS difference""" for x, y in (("o_custkey", "cust_id"), TOTAL)
    ),
    "mixed_types": 'SELECT o_orderkey % 5 <> 0 AS "o_custkey_IsValid", false AS "twin_IsValid", count(*) AS n FROM orders GROUP BY 1',
    "row_check": _bad("coalesce(total >= o_totalprice AND total < 1.4::DOUBLE * o_totalprice, false)"),
    "event_times": "SELECT event_id FROM events WHERE event_id % 3 = 0 AND ts IS NOT NULL",
}
