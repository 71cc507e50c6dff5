"""The rules of searches over lines and orders: odd keys against SQL, and partitions that follow the rows."""

import duckdb

from claimweave.plans import ORACLES, QUERIES, rules_plans
from tests.support import duck_rows, spark_rows


def test_rules_search(spark, tmp_path, monkeypatch):
    """Orders twice, orders without lines, lines without an order, line numbers that are missing, and a plan with a third of all lines."""
    monkeypatch.setattr(rules_plans, "PART_ROWS", 50)
    orders = [(i, "5-LOW" if i % 3 else "1-URGENT") for i in range(60)] + [(4, "5-LOW"), (5, None), (None, "5-LOW")]
    lines = [(i % 45 if i % 3 else 7, None if i % 29 == 0 else i % 5, "RAN"[i * i % 3], float(i % 4), (i % 7) / 100) for i in range(300)] + [(1000, 1, "A", 1.0, 0.9), (None, 1, "A", 1.0, 0.9)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    for t in ("orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES["rules_search"](spark, str(tmp_path))
    assert spark_rows(got) == duck_rows(c, ORACLES["rules_search"])
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(plan") == 1 and ", 8), REPARTITION_BY_NUM" in plan
