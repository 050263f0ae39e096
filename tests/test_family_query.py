"""The registered family_merge goes through all depths."""

from datetime import date

from strandloom.plans import all_queries


def test_suppliers_that_meet_at_depth_two(spark, tmp_path):
    months = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6}  # 1 - 3 - 4 - 5 - 2, and 6 beside 4
    lines = [(1, k, s, date(1996, months[s], 1)) for k, s in enumerate((1, 3, 4, 5, 2))] + [(2, k, s, date(1996, months[s], 1)) for k, s in enumerate((4, 6))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 50.0), (2, 55.0), (3, 1000.0), (4, 2000.0), (5, 3000.0), (6, 4000.0)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.node: r.merged for r in all_queries()["family_merge"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
