"""Statistics: the quantile family, ranks with ties, error and calibration metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftloom.operators import ranks
from draftloom.session import stage

c = F.col


def quantile_by_index(rows: DataFrame, group: list[str], value: str, index: Column, name: str) -> DataFrame:
    """The value at ``index`` (from 0, may use the group's size ``n``) of each group in ascending order."""
    return ranks.order_statistics(rows, group, value, {name: index})


def quantile_floor(rows: DataFrame, group: list[str], value: str, p: float, name: str = "q") -> DataFrame:
    return quantile_by_index(rows, group, value, F.floor((c("n") - 1) * p), name)


def quantile_floor_n(rows: DataFrame, group: list[str], value: str, p: float, name: str = "q") -> DataFrame:
    return quantile_by_index(rows, group, value, F.least(c("n") - 1, F.floor(c("n") * p)), name)


def quantile_higher(rows: DataFrame, group: list[str], value: str, p: float, name: str = "q") -> DataFrame:
    return quantile_by_index(rows, group, value, F.ceil((c("n") - 1) * p), name)


def quantile_nearest(rows: DataFrame, group: list[str], value: str, p: float, name: str = "q") -> DataFrame:
    return quantile_by_index(rows, group, value, F.greatest(F.lit(0), F.ceil(c("n") * p) - 1), name)


def quantile_weighted(rows: DataFrame, group: list[str], value: str, weight: str, p: float, name: str = "q") -> DataFrame:
    """The first value at which the running weight reaches p of the group's weight."""
    h = ranks.histogram(rows, group, value, c(weight))
    return h.where(c("n_upto") >= c("n_all") * p).groupBy(*group).agg(F.min(value).alias(name))


def average_rank(rows: DataFrame, group: list[str], value: str, name: str = "rank") -> DataFrame:
    """``rows`` with their rank from 1 in ascending order, ties sharing the mean of their places."""
    return rows.join(ranks.average_ranks(rows, group, value, name), [*group, value])


def spearman(rows: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation per group. Equal pairs of values are counted first, so ties do not grow the work."""
    w = c("__w")
    pairs = stage(rows.groupBy(*group, x, y).agg(F.count(F.lit(1)).cast("double").alias("__w")), "pairs")
    r = pairs.join(ranks.average_ranks(pairs, group, x, "__rx", w), [*group, x]).join(ranks.average_ranks(pairs, group, y, "__ry", w), [*group, y])
    m = r.groupBy(*group).agg(F.sum(w).alias("n"), (F.sum(w * c("__rx")) / F.sum(w)).alias("__mx"), (F.sum(w * c("__ry")) / F.sum(w)).alias("__my"))
    a, b = c("__rx") - c("__mx"), c("__ry") - c("__my")
    s = r.join(m, group).groupBy(*group, "n").agg(F.sum(w * a * b).alias("__ab"), F.sum(w * a * a).alias("__aa"), F.sum(w * b * b).alias("__bb"))
    return s.select(*group, (c("__ab") / F.sqrt(F.nullif(c("__aa") * c("__bb"), F.lit(0.0)))).alias("spearman"), c("n").cast("long").alias("n"))


def errors(rows: DataFrame, group: list[str], predicted: Column, actual: Column) -> DataFrame:
    e = predicted - actual
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def calibration_bins(rows: DataFrame, probability: Column, outcome: Column, bins: int = 10) -> DataFrame:
    """(bin, count, predicted, observed): equal-width bins, the last one closed."""
    b = F.least(F.lit(bins - 1), F.floor(probability * bins)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.avg(probability).alias("predicted"), F.avg(outcome).alias("observed"))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(c("count") * F.abs(c("predicted") - c("observed"))) / F.sum("count")).alias("ece"))


def pinball(actual: Column, quantile: Column, p: Column) -> Column:
    return F.greatest(p * (actual - quantile), (p - 1) * (actual - quantile))


def interval_score(actual: Column, low: Column, high: Column, alpha: float) -> Column:
    return (high - low) + F.greatest(F.lit(0.0), low - actual) * (2 / alpha) + F.greatest(F.lit(0.0), actual - high) * (2 / alpha)


def concordance(rows: DataFrame, group: str, x: str, y: str, key: str) -> DataFrame:
    """The share of pairs of a group that x and y order alike; ties in y are no pairs, ties in x count half.

    ``group`` must bound the pairs: they are all formed.
    """
    a = rows.select(group, c(x).alias("x1"), c(y).alias("y1"), c(key).alias("k1"))
    b = rows.select(group, c(x).alias("x2"), c(y).alias("y2"), c(key).alias("k2"))
    pairs = a.join(b, group).where((c("k1") < c("k2")) & (c("y1") != c("y2")))
    same = F.when(c("x1") == c("x2"), 0.5).when((c("x1") > c("x2")) == (c("y1") > c("y2")), 1.0).otherwise(0.0)
    return pairs.groupBy(group).agg(F.avg(same).alias("accuracy"), F.count(F.lit(1)).alias("pairs"))
