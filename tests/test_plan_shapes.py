"""What keeps plans in proportion to their input: one pass for rules over one table, no rows multiplied for distinct counts."""

from claimweave.operators import ledger
from claimweave.plans import QUERIES
from tests.support import SF


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_of_one_table_read_it_once(spark):
    for name in ("ladder_shape",):
        assert optimized(QUERIES[name](spark, SF)).count("Relation [") == 1


def test_coverage_multiplies_no_bindings(spark):
    targets = spark.createDataFrame([(1,), (2,), (3,)], "target long")
    bindings = spark.createDataFrame([(1, 7, "supports"), (1, 7, None), (1, 8, "refutes"), (1, None, None), (2, 9, "supports")], "target long, doc long, direction string")
    docs = spark.createDataFrame([(7, "", "T3_working_paper"), (8, "p", "T4_industry_data"), (8, "r", "T4_industry_data")], "doc long, publisher string, tier string")
    got = ledger.coverage(targets, bindings, docs)
    assert "Expand" not in optimized(got)
    want = [(1, 4, 1, 2, 2, 2, 3, "T3_working_paper,T4_industry_data", True), (2, 1, 1, 0, 0, 1, 0, "", False), (3, 0, 0, 0, 0, 0, 0, "", False)]
    assert sorted(map(tuple, got.select("target", "bindings", "supports", "refutes", "context", "docs", "distinct_publishers", "tiers", "triangulated").collect())) == want
