"""Walk-forward models with pyspark.ml, their offsets, and the block bootstrap."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftloom.operators import ranks

c = F.col
FOLDS_AT_ONCE = 4


def prepared(rows: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Features as doubles with a flag each for a missing one; NaN counts as missing and stays null here."""
    clean = rows.select(*[F.when(~F.isnan(f) & c(f).isNotNull(), c(f).cast("double")).alias(f) if f in features else c(f) for f in rows.columns])
    flags = [F.when(c(f).isNull(), 1.0).otherwise(0.0).alias(f"{f}_missing") for f in features]
    return clean.select("*", *flags), [*features, *[f"{f}_missing" for f in features]]


def walk_forward(rows: DataFrame, season: str, label: str, features: list[str], seasons: list[int] | None = None, kind: str = "ridge", alpha: float = 18.0) -> DataFrame:
    """Predictions for each season of a model fitted on the labelled rows of all earlier ones.

    ``seasons``: all seasons of the data unless given. Rows without a label are predicted too; a season without earlier
    labelled rows has no prediction. Medians for missing features come from the training rows of the season alone. The
    boosted trees have the reference's 80 iterations, step of 0.06 and 18 rows a leaf, and depth 4 for its 15 leaves.
    """
    from pyspark import inheritable_thread_target
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    ready, names = prepared(rows, features)
    ready = ready.persist()
    labelled = ready.where(c(label).isNotNull() & ~F.isnan(label))
    counts = {r[0]: r[1] for r in labelled.where(c(season).isNotNull()).groupBy(season).count().collect()}
    if seasons is None:
        seasons = sorted(r[0] for r in ready.where(c(season).isNotNull()).select(season).distinct().collect())

    def fold(s: int) -> DataFrame:
        n = sum(k for at, k in counts.items() if at < s)
        train, test = labelled.where(c(season) < s), ready.where(c(season) == s)
        # a tree of the absolute loss moves a row by one step of the label's unit, so the label is put in units of its spread
        med = train.agg(*[F.percentile_approx(f, 0.5).alias(f) for f in features], F.stddev_pop(label).alias("__spread")).first()
        spread = med["__spread"] or 1.0 if kind == "gbt" else 1.0
        known = {f: float(med[f] or 0.0) for f in features}
        assemble, scale = VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True)
        model = LinearRegression(featuresCol="x", labelCol="__y", regParam=alpha / n, elasticNetParam=0.0, standardization=False) if kind == "ridge" else GBTRegressor(featuresCol="x", labelCol="__y", lossType="absolute", maxIter=80, maxDepth=4, stepSize=0.06, minInstancesPerNode=18, seed=5)
        return Pipeline(stages=[assemble, scale, model]).fit(train.fillna(known).withColumn("__y", c(label) / spread)).transform(test.fillna(known)).select(*[x for x in rows.columns if x not in features], (c("prediction") * spread).alias("prediction"))

    # the folds do not depend on each other and are many small jobs each
    run = [s for s in seasons if any(at < s for at in counts)]
    with ThreadPoolExecutor(FOLDS_AT_ONCE) as pool:
        parts = list(pool.map(inheritable_thread_target(rows.sparkSession)(fold), run))
    out = rows.select(*[x for x in rows.columns if x not in features], F.lit(0.0).alias("prediction")).limit(0) if not parts else parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def nested_offset(predicted: DataFrame, season: str, label: str) -> DataFrame:
    """``predicted`` with ``offset``, the median of label minus prediction over all earlier seasons, and ``adjusted``.

    The predictions must be out of fold. A season without earlier labelled predictions has an offset of nought.
    """
    known = predicted.where(c(label).isNotNull() & ~F.isnan(label) & c(season).isNotNull()).select(c(season).alias("__s"), (c(label) - c("prediction")).alias("__r"))
    # a season's misses count for every later season: as many copies as there are seasons
    seasons = F.broadcast(predicted.where(c(season).isNotNull()).select(c(season).alias("__for")).distinct())
    median = ranks.quantiles(known.join(seasons, c("__s") < c("__for")), ["__for"], "__r", [0.5]).select("__for", c("q")[0].alias("offset"))
    out = predicted.join(F.broadcast(median), c(season) == c("__for"), "left").drop("__for")
    return out.withColumn("offset", F.coalesce("offset", F.lit(0.0))).withColumn("adjusted", c("prediction") + c("offset"))


def check_leakage(rows: DataFrame, known_at: Column, target_at: Column) -> None:
    """An error if any row's features were known only at or after what they are to forecast."""
    late = rows.where(F.coalesce(known_at >= target_at, F.lit(False))).limit(1).count()
    if late:
        raise ValueError("features that were not known before the target: a walk-forward over them would leak")


def block_bootstrap(group: pd.DataFrame, value: str, order: str, length: int, draws: int, weeks: int, seed: int) -> pd.DataFrame:
    """Season totals of one player's weeks drawn in circular blocks of consecutive weeks."""
    v = group.sort_values(order)[value].to_numpy(float)
    rng = np.random.default_rng([seed, len(v)])
    starts = rng.integers(0, len(v), size=(draws, -(-weeks // length)))
    at = (starts[:, :, None] + np.arange(length)) % len(v)
    totals = v[at].reshape(draws, -1)[:, :weeks].sum(axis=1)
    return pd.DataFrame({"p10": [np.quantile(totals, 0.1)], "p50": [np.quantile(totals, 0.5)], "p90": [np.quantile(totals, 0.9)]})
