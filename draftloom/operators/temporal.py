"""Leakage-safe time features: season lags, bounds in time, recency weights, runs of seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def season_lags(rows: DataFrame, key: list[str], season: str, values: list[str], lags: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Each row with the values of exactly k seasons before. A gap gives null, which a row offset would not.

    ``rows`` has one row per key and season.
    """
    out = rows
    for k in lags:
        before = rows.select(*key, (c(season) + k).alias(season), *[c(v).alias(f"{v}_lag{k}") for v in values])
        out = out.join(before, [*key, season], "left")
    return out


def latest_before(events: DataFrame, key: list[str], at: str, bound: Column, order: list[Column], values: list[str]) -> DataFrame:
    """The last row of each key strictly before ``bound``."""
    best = events.where(c(at) < bound).groupBy(*key).agg(F.max_by(F.struct(at, *values), F.struct(c(at), *order)).alias("b"))
    return best.select(*key, "b.*")


def first_per(rows: DataFrame, key: list[str], order: list[Column], values: list[str]) -> DataFrame:
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("b"))
    return best.select(*key, "b.*")


def keep_last(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One whole row per key, the last in ``order`` (which ends in a unique column)."""
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*[c(x) for x in rows.columns if x not in key]), F.struct(*order)).alias("b"))
    return best.select(*key, "b.*").select(*rows.columns)


def history_weighted(rows: DataFrame, key: str, season: str, value: str, decay: float) -> DataFrame:
    """The mean of all earlier seasons of the key, each weighing decay ** (age in seasons)."""
    past = rows.select(key, c(season).alias("past"), c(value).alias("v"))
    pairs = rows.select(key, season).join(past, key).where(c("past") < c(season))
    w = F.pow(F.lit(decay), (c(season) - c("past")).cast("double"))
    return pairs.groupBy(key, season).agg((F.sum(w * c("v")) / F.sum(w)).alias("history"), F.count(F.lit(1)).alias("seasons"))


def tenure(rows: DataFrame, key: list[str], season: str) -> DataFrame:
    """How many consecutive seasons, up to and including each one, the key has been there."""
    once = rows.select(*key, season).distinct()
    run = c(season) - F.row_number().over(Window.partitionBy(*key).orderBy(season))
    return once.withColumn("run", run).withColumn("tenure", F.row_number().over(Window.partitionBy(*key, "run").orderBy(season))).drop("run")


def last_k_split(rows: DataFrame, key: str, order: list[Column], value: str, k: int = 6) -> DataFrame:
    """Mean of the last k rows of a key against the mean of the rest."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    x = rows.withColumn("place", place)
    recent, rest = F.avg(F.when(c("place") <= k, c(value))), F.avg(F.when(c("place") > k, c(value)))
    return x.groupBy(key).agg(recent.alias("recent"), rest.alias("rest"), (recent - rest).alias("change"))
