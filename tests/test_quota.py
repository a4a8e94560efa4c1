from __future__ import annotations

import random

from tidemark.plans import usage


def test_a_sum_that_ends_in_500_is_rounded_to_even_in_any_order(spark, tmp_path):
    """As doubles these add up to a little more than 2,500."""
    prices = [243.28, 287.22, 295.77, 232.38, 399.7, 129.16, 78.06, 412.38, 192.75, 229.3]
    spark.createDataFrame([(1, 1)], "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    for seed in range(3):
        spark.createDataFrame([(1, x) for x in prices], "o_custkey long, o_totalprice double").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
        assert usage.quota_status(spark, str(tmp_path)).first()["pages"] == 2
        random.Random(seed).shuffle(prices)
