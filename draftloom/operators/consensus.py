"""Scoring and blending competing projection sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftloom.operators import ranks

BLOCK = 4096


def score_sources(rows: DataFrame, source: str, projected: Column, actual: Column, least: int = 1) -> DataFrame:
    """(source, samples, rmse, mae) of every source with at least ``least`` rows."""
    e = projected - actual
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("samples"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")).where(F.col("samples") >= least)


def inverse_mse_weights(scores: DataFrame, least: int = 100) -> DataFrame:
    """The sources with enough samples, weighted by one over their squared error, the weights adding up to 1."""
    raw = scores.where(F.col("samples") >= least).withColumn("raw", 1 / F.greatest(F.lit(0.01), F.col("rmse") * F.col("rmse")))
    total = raw.agg(F.sum("raw").alias("total"))
    return raw.crossJoin(F.broadcast(total)).withColumn("weight", F.col("raw") / F.col("total")).drop("raw", "total")


def blend(rows: DataFrame, keys: list[str], weight: Column, values: dict[str, Column]) -> DataFrame:
    """Weighted means per key, the weights renormalised over the sources that are present."""
    return rows.where(weight > 0).groupBy(*keys).agg(*[(F.sum(v * weight) / F.sum(weight)).alias(n) for n, v in values.items()], F.sum(weight).alias("weight"))


def at_least_sources(rows: DataFrame, key: str, source: str, value: Column, least: int = 2) -> DataFrame:
    return rows.groupBy(key).agg(F.countDistinct(source).alias("sources"), F.avg(value).alias("points")).where(F.col("sources") >= least)


def leave_one_out(rows: DataFrame, key: str, source: str, value: str) -> DataFrame:
    """Each source's value of a key against the mean of its peers: the key's total minus its own part."""
    own = rows.groupBy(key, source).agg(F.avg(value).alias("own"))
    total = own.groupBy(key).agg(F.sum("own").alias("s"), F.count(F.lit(1)).alias("n"))
    return own.join(total, key).where(F.col("n") > 1).select(key, source, "own", ((F.col("s") - F.col("own")) / (F.col("n") - 1)).alias("peers"))


def neighbour_bias(rows: DataFrame, group: str, key: str, target: str, residual: str, k: int = 9) -> DataFrame:
    """The median residual of the k rows of the group nearest by target, excluding the row itself.

    Nearest rows lie within k places in target order, so a bounded window frame replaces the self-join. Groups are cut
    into runs of BLOCK places, each with k more at both ends, so no group is one task. Ties in distance go to the larger
    target, then the smaller key.
    """
    at = F.col("__place") - 1
    block = F.floor(at / BLOCK)
    into = F.array_compact(F.array(block, F.when(F.pmod(at, F.lit(BLOCK)) < k, block - 1), F.when(F.pmod(at, F.lit(BLOCK)) >= BLOCK - k, block + 1)))
    spread = ranks.placed(rows, [group], [F.col(target), F.col(key)], "__place").withColumn("__own", block).withColumn("__block", F.explode(into))
    order = Window.partitionBy(group, "__block").orderBy(target, key)
    row = F.struct(F.col(key).alias("k"), F.col(target).alias("t"), F.col(residual).alias("r"))
    near = F.concat(F.collect_list(row).over(order.rowsBetween(-k, -1)), F.collect_list(row).over(order.rowsBetween(1, k)))
    ranked = F.slice(F.array_sort(F.transform(near, lambda x: F.struct(F.abs(x["t"] - F.col(target)).alias("d"), (-x["t"]).alias("o"), x["k"].alias("k"), x["r"].alias("r")))), 1, k)
    rs = F.array_sort(F.transform(ranked, lambda x: x["r"]))
    n = F.size(rs)
    mid = F.when(n == 0, 0.0).when(F.pmod(n, F.lit(2)) == 1, F.try_element_at(rs, ((n + 1) / 2).cast("int"))).otherwise((F.try_element_at(rs, (n / 2).cast("int")) + F.try_element_at(rs, (n / 2).cast("int") + 1)) / 2)
    return spread.withColumn("near", near).withColumn("bias", mid).where("__block = __own").drop("near", "__place", "__own", "__block")


def map_by_rank(left: DataFrame, right: DataFrame, group: str, left_order: list[Column], right_order: list[Column], value: str) -> DataFrame:
    """The n-th row of each group on the left gets ``value`` of the n-th row on the right."""
    a = ranks.placed(left, [group], left_order)
    b = ranks.placed(right, [group], right_order).select(group, "place", value)
    return a.join(b, [group, "place"])
