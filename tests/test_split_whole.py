"""The stratified hold-out gives every customer with orders a side, in proportion by label."""

from pyspark.sql import functions as F

from tilewright.plans import catalog

SF = "/root/testdata/sf0.001"


def test_all_customers_have_a_side(spark):
    side = {r.exposure: r.side for r in catalog.QUERIES["split_test_stratified"](spark, SF).collect()}
    orders = spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_custkey").cast("string").alias("c"), F.substring("o_orderpriority", 1, 1).alias("k")).collect()
    assert set(side) == {r.c for r in orders} and list(side.values()).count("test") == len(side) // 4
    for k in {r.k for r in orders}:
        rows = [r for r in orders if r.k == k]
        assert abs(sum(side[r.c] == "test" for r in rows) / len(rows) - 0.25) < 0.05
