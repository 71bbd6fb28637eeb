import random

from pyspark.sql import functions as F

from strataleaf.operators.matching import containment_join


def test_containment_equals_all_pairs(spark):
    rng = random.Random(8)
    text = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 24)))
    left, right = ([(rng.randint(0, 2), i, text()) for i in range(150)] for _ in range(2))
    got = containment_join(
        spark.createDataFrame(left, "k int, l int, lt string"), spark.createDataFrame(right, "k int, r int, rt string"), ["k"], "lt", "rt"
    ).select("l", "r")
    want = sorted((a, b) for k, a, x in left for m, b, y in right if k == m and min(len(x), len(y)) >= 8 and (x in y or y in x))
    assert sorted(map(tuple, got.collect())) == want and want


def test_neither_side_is_broadcast(spark):
    """Small files can hold rows whose computed texts are too large for the driver."""
    part = spark.read.parquet("/root/testdata/sf0.1/part.parquet")
    long = F.concat("p_name", F.lit(" "), F.lpad(F.col("p_partkey").cast("string"), 6, "0"))
    left = part.select(F.col("p_brand").alias("doc"), long.alias("l"))
    right = part.select(F.col("p_brand").alias("doc"), long.alias("r"))
    plan = containment_join(left, right, ["doc"], "l", "r")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
