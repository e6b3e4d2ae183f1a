"""Percentiles with guaranteed relative error from counts in signed logarithmic buckets.

A finite value x goes to the bucket (sign, ceil(log_gamma |x|)) with gamma = (1 + a) / (1 - a); values within ``zero``
of nought have a bucket of their own. A sketch is an ordinary table of (group, sign, bucket, count): counting is a hash
aggregate with map-side combining, so a hot group costs each partition a few hundred rows; sketches of other partitions,
days or loads are merged by adding counts; a coarser group is a sum over finer ones. The percentile at p is the
representative of the bucket that holds rank floor(p (n - 1)), within a relative error of ``a`` of that value.

Rows that carry no usable amount are counted, never dropped silently: sign 9 with bucket 1 (null), 2 (NaN or infinite)
or 3 (outside ``valid``).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR, ZERO = 0.01, 1e-9
REJECTED = 9
MAX_PROBABILITIES = 10_000


def gamma(error: float = ERROR) -> float:
    if not 0 < error < 1:
        raise ValueError("the relative error lies between 0 and 1")
    return (1 + error) / (1 - error)


def sketch(df: DataFrame, value: Column, groups: dict[str, Column], error: float = ERROR, valid: tuple[float, float] | None = None, zero: float = ZERO) -> DataFrame:
    """(groups, sign, bucket, n). A null group key is a group; an empty table gives an empty sketch."""
    x = value.cast("double")
    lost = F.when(x.isNull(), 1).when(F.isnan(x) | (F.abs(x) == float("inf")), 2)
    if valid is not None:
        lost = lost.when(~x.between(*valid), 3)
    flat = df.select(*[g.alias(n) for n, g in groups.items()], x.alias("__x"), lost.alias("__lost"))
    x, lost = F.col("__x"), F.col("__lost")
    sign = F.when(lost.isNotNull(), REJECTED).when(F.abs(x) <= zero, 0).when(x > 0, 1).otherwise(-1)
    bucket = F.when(lost.isNotNull(), lost).when(F.abs(x) <= zero, 0).otherwise(F.ceil(F.log(F.abs(x)) / math.log(gamma(error))))
    return flat.groupBy(*groups, sign.cast("int").alias("sign"), bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: list[DataFrame], groups: list[str]) -> DataFrame:
    """One sketch of several with the same error: matching bucket counts are added. ``groups`` may be fewer than they have."""
    one = reduce(DataFrame.unionByName, [s.select(*groups, "sign", "bucket", "n") for s in sketches])
    return one.groupBy(*groups, "sign", "bucket").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, groups: list[str], probabilities: list[float], error: float = ERROR) -> DataFrame:
    """(groups, probability, value, n, rejected) for each distinct valid probability.

    A group without any usable value has null values; a probability that is null, NaN or outside 0..1 gets no row.
    """
    wanted = sorted({float(p) for p in probabilities if p is not None and 0 <= p <= 1})
    if len(wanted) > MAX_PROBABILITIES:
        raise ValueError(f"at most {MAX_PROBABILITIES} distinct probabilities")
    g = gamma(error)
    good = F.col("sign") != REJECTED
    order = F.when(F.col("sign") < 0, -F.col("bucket")).otherwise(F.col("bucket"))
    by = Window.partitionBy(*groups)
    upto = by.orderBy("sign", order).rowsBetween(Window.unboundedPreceding, 0)
    # rejected rows have the highest sign, so they follow all values
    seen = counts.withColumn("n_", F.sum(F.when(good, F.col("n")).otherwise(0)).over(by)).withColumn("rejected", F.sum(F.when(good, 0).otherwise(F.col("n"))).over(by)).withColumn("cum", F.sum("n").over(upto))
    ps = F.array(*[F.lit(p) for p in wanted]).cast("array<double>")
    rank = lambda p: F.floor(p * (F.col("n_") - 1))
    inside = F.when(good, F.filter(ps, lambda p: (rank(p) >= F.col("cum") - F.col("n")) & (rank(p) < F.col("cum")))).when((F.col("n_") == 0) & (F.col("cum") == F.col("n")), ps)
    size = F.lit(2 / (g + 1)) * F.pow(F.lit(g), F.col("bucket"))
    value = F.when(good, F.when(F.col("sign") == 0, F.lit(0.0)).otherwise(F.col("sign") * size))
    return seen.select(*groups, F.explode(inside).alias("probability"), value.alias("value"), F.col("n_").alias("n"), "rejected")
