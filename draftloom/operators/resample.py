"""Resampling and paired scenarios on keyed randomness: the same draws for any partitioning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftloom.functions import scalars as S

c = F.col


def uniform(seed: int, scenario: Column, parts: list[Column]) -> Column:
    return S.finish(S.keyed_base(seed, scenario, parts))


def normal(seed: int, scenario: Column, parts: list[Column]) -> Column:
    """A standard normal draw addressed by its parts; its two uniforms are further parts of the same state."""
    ends = [S.fnv1a_of("u1"), S.fnv1a_of("u2")]
    return S.let(S.keyed_base(seed, scenario, parts), lambda h: S.box_muller(*[S.finish(S.mix(h, F.lit(e).cast("long"))) for e in ends]))


# fixed values: the distribution function of a Poisson number of mean 1 at 0, 1, 2, ...
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9)]


def poisson_weight(u: Column) -> Column:
    """A Poisson number of mean 1 from a uniform one: how often a draw takes a cluster."""
    return sum(((u > x).cast("int") for x in POISSON), F.lit(0))


def bootstrap(clusters: DataFrame, group: list[str], draws: int, seed: int, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(group, mean, low, high): cluster bootstrap of a ratio of sums, every draw taking each cluster a Poisson number of
    times.

    ``clusters``: see ``clustered``. Weights are keyed by draw and cluster, so a draw needs no numbering of clusters and
    no join back to them: one pass that adds up draws x groups sums before anything moves.
    """
    each = clusters.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("w", poisson_weight(uniform(seed, c("draw"), [c("h")])))
    each = each.groupBy(*group, "draw").agg(F.try_divide(F.sum(c("total") * c("w")), F.sum(c("size") * c("w"))).alias("m"))
    # as many values a group as there are draws
    return each.groupBy(*group).agg(F.avg("m").alias("mean"), F.percentile("m", [low, high]).alias("q")).select(*group, "mean", c("q")[0].alias("low"), c("q")[1].alias("high"))


def clustered(rows: DataFrame, group: list[str], cluster: Column, value: Column) -> DataFrame:
    """(group, h, total, size): rows added up by cluster, h its hash."""
    agg = rows.groupBy(*group, cluster.cast("string").alias("__cluster")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("size"))
    return agg.withColumn("h", S.fnv1a(c("__cluster"))).drop("__cluster")


def budget(rows: DataFrame, group: list[str], value: str, target: Column, low: float, high: float) -> DataFrame:
    """The members of a group scaled toward its budget, by a ratio kept within bounds."""
    t = rows.groupBy(*group).agg(F.sum(value).alias("sum_"))
    ratio = S.clamp(F.try_divide(target, c("sum_")), low, high)
    return rows.join(t, group).withColumn("scaled", c(value) * F.coalesce(ratio, F.lit(1.0)))


def simplex_search(rows: DataFrame, group: list[str], predictions: list[str], actual: str, steps: int = 20, pull: float = 0.01) -> DataFrame:
    """Per group the weights on the simplex (in 1/steps) with the least mean absolute error plus a pull to equal weights.

    The grid is of fixed size: each task adds up the losses of all its steps per group, so what moves is a row of sums per
    group and task. Rows with a null or NaN in any of the columns are left out.
    """
    k = len(predictions)
    grid = [(i / steps, j / steps, (steps - i - j) / steps) for i in range(steps + 1) for j in range(steps + 1 - i)]
    weights = np.array(grid).T
    known = F.lit(True)
    for x in (*predictions, actual):
        known = known & c(x).isNotNull() & ~F.isnan(c(x).cast("double"))
    ready = rows.where(known).select(*group, *[c(x).cast("double").alias(x) for x in (*predictions, actual)])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, list] = {}
        for batch in batches:
            for key, part in batch.groupby(group, dropna=False, sort=False):
                loss = np.abs(part[predictions].to_numpy() @ weights - part[[actual]].to_numpy()).sum(axis=0)
                at = total.setdefault(key, [np.zeros(len(grid)), 0])
                at[0] += loss
                at[1] += len(part)
        out = pd.DataFrame([(*key, list(v), n) for key, (v, n) in total.items()], columns=[*group, "sums", "n"])
        yield out.astype(object).where(out.notna(), None) if len(out) else out

    kinds = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in group)
    parts = ready.mapInPandas(sums, f"{kinds}, sums array<double>, n long")
    each = parts.select(*group, "n", F.posexplode("sums").alias("g", "s")).groupBy(*group, "g").agg((F.sum("s") / F.sum("n")).alias("mae"))
    extra = F.element_at(F.array(*[F.lit(pull * sum((w - 1 / k) ** 2 for w in ws)) for ws in grid]), c("g") + 1)
    best = each.withColumn("score", F.round(c("mae") + extra, 9)).groupBy(*group).agg(F.min_by(F.struct("g", "mae"), F.struct("score", "g")).alias("b"))
    ws = [F.element_at(F.array(*[F.lit(x[i]) for x in grid]), c("b.g") + 1).alias(f"w{i}") for i in range(k)]
    return best.select(*group, *ws, c("b.mae").alias("mae"))
