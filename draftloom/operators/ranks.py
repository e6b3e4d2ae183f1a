"""Places, running sums and order statistics within groups of any size, with no group in one task.

Rows are cut into slices by range over (group, order), so a group that holds a third of all rows spans many slices. A
slice works out its own places; a table of slice totals (groups and slices long) carries the sums of earlier slices over.
Order statistics work on the histogram of distinct values, which ties and repeated rows shrink before anything moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftloom.session import stage

c = F.col


def cumulative(rows: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with ``<name>_upto``, the running total of each sum in ``order`` within its group, and ``<name>_all``.

    ``order`` must be total, or rows of a tie stand in any order. Null groups are a group. Empty input: no rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, "__slice"]
    cut = rows.select("*", *[x.alias(f"__{k}") for k, x in sums.items()]).repartitionByRange(parts, *[c(g) for g in group], *order).withColumn("__slice", F.spark_partition_id())
    # written, so that a slice is the same one for its totals and for its places
    cut = stage(cut, "slices")
    totals = cut.groupBy(*keys).agg(*[F.sum(f"__{k}").alias(k) for k in sums])
    # one row per group and slice; without a group as many as there are slices
    of = Window.partitionBy(*(group or [F.lit(0)]))
    earlier = of.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[c(k).alias(f"__on_{k}") for k in keys], *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"__before_{k}") for k in sums], *[F.sum(k).over(of).alias(f"{k}_all") for k in sums])
    here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.lit(True)
    for k in keys:
        same = same & c(k).eqNullSafe(c(f"__on_{k}"))
    out = cut.select("*", *[F.sum(f"__{k}").over(here).alias(f"__run_{k}") for k in sums]).join(totals, same)
    return out.select(*rows.columns, *[(c(f"__before_{k}") + c(f"__run_{k}")).alias(f"{k}_upto") for k in sums], *[f"{k}_all" for k in sums])


def placed(rows: DataFrame, group: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place in ``order`` within their group, from 1."""
    x = cumulative(rows, group, order, {"__one": F.lit(1)})
    return x.withColumnRenamed("__one_upto", name).withColumn(name, c(name).cast("int")).drop("__one_all")


def histogram(rows: DataFrame, group: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """(group, value, n_upto, n_all, n): the distinct values of each group with their running counts or weights.

    Null and NaN values are left out.
    """
    known = rows.where(c(value).isNotNull() & ~F.isnan(c(value).cast("double")))
    each = known.groupBy(*group, value).agg(F.sum(F.lit(1) if weight is None else weight).alias("n"))
    return cumulative(each, group, [c(value)], {"n": c("n")})


def order_statistics(rows: DataFrame, group: list[str], value: str, indexes: dict[str, Column]) -> DataFrame:
    """Per group the value at each index (from 0, of the group's size ``n``) in ascending order."""
    h = histogram(rows, group, value).withColumn("__n", c("n")).withColumn("n", c("n_all"))
    at = {k: F.when((c("n_upto") - c("__n") <= i) & (i < c("n_upto")), c(value)) for k, i in indexes.items()}
    return h.groupBy(*group).agg(*[F.max(x).alias(k) for k, x in at.items()])


def quantiles(rows: DataFrame, group: list[str], value: str, ps: list[float], name: str = "q") -> DataFrame:
    """Per group an array of the exact quantiles at ``ps``, linear between neighbouring values."""
    spot = lambda p: (c("n") - 1) * F.lit(p)
    h = histogram(rows, group, value).withColumn("__n", c("n")).withColumn("n", c("n_all"))
    here = lambda i: F.when((c("n_upto") - c("__n") <= i) & (i < c("n_upto")), c(value))
    ends = [F.max(here(f(spot(p)))).alias(f"__{s}{i}") for i, p in enumerate(ps) for s, f in (("l", F.floor), ("h", F.ceil))]
    x = h.groupBy(*group).agg(*ends, F.max("n").alias("n"))
    between = [c(f"__l{i}") + (c(f"__h{i}") - c(f"__l{i}")) * (spot(p) - F.floor(spot(p))) for i, p in enumerate(ps)]
    return x.select(*group, F.array(*[b.cast("double") for b in between]).alias(name), "n")


def average_ranks(rows: DataFrame, group: list[str], value: str, name: str = "rank", count: Column | None = None) -> DataFrame:
    """(group, value, name): the rank of each distinct value from 1, ties sharing the mean of their places.

    ``count``: how many rows a row stands for.
    """
    return histogram(rows, group, value, count).select(*group, value, (c("n_upto") - (c("n") - 1) / 2).alias(name))
