"""Every check against plain SQL in another engine, and the roll-ups."""

import pytest
from conftest import SF, rows_of

from mediaprism import findings
from mediaprism.operators.registry import CHECKS
from mediaprism.queries import QUERIES, SQL


def test_every_check_has_sql():
    assert len(CHECKS) == 36 and set(CHECKS) <= set(SQL)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_check_agrees_with_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert rows_of(got) == rows_of(duck.execute(SQL[name]).df())
    assert set(got["status"]) <= set(findings.STATUSES)


def test_severity_orders_and_exits(spark):
    f = spark.createDataFrame([("a", "r", "t", s, 1.0) for s in ("OK", "BAD", "WARN")] + [("b", "r", "t", "ERROR", None)], "check string, rule string, target string, status string, value double")
    assert [r["status"] for r in findings.worst_first(f).collect()] == ["ERROR", "BAD", "WARN", "OK"]
    assert findings.worst(f).first()["worst"] == "ERROR"
    assert findings.worst(f.limit(0)).first()["worst"] == "OK"
    assert findings.exit_code("WARN", "BAD") == 0 and findings.exit_code("BAD", "BAD") == 1 and findings.exit_code("ERROR", None) == 0


def test_body_is_in_no_plan_and_columns_are_pruned(spark):
    plan = QUERIES["bitrate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "ReadSchema" in plan
