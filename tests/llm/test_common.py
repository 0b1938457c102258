import bisect
import random

from pyspark.sql import functions as F

from peerlens.llm import common


def test_buckets_equal_bisection(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 5, 30, 170):
        bounds = sorted(rng.sample(range(-500, 500), n))
        keys = [(k,) for k in [*bounds, *(b - 1 for b in bounds), -10**6, 10**6]]
        got = spark.createDataFrame(keys, "k long").select("k", common.bucket_of(F.col("k"), bounds).alias("b")).collect()
        assert all(r.b == bisect.bisect_right(bounds, r.k) for r in got)


def test_bounds_cut_evenly(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id")).alias("k"))
    bounds = common.order_bounds(df, "k", 10)
    sizes = [r["count"] for r in df.groupBy(common.bucket_of(F.col("k"), bounds).alias("b")).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 150
    assert common.order_bounds(df.limit(0), "k", 10) == [] and common.order_bounds(df, "k", 1) == []
