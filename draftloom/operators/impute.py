"""Filling missing values by low-rank alternating least squares over mixed encoded record-feature cells.

Every record becomes a row of encoded cells: numbers are standardised against the shrunken mean of their group and
time, categories become one cell per level, and a missing or unusable value is an absent cell. The cell matrix X is
approximated by U V' with a small rank. V has one row per cell column (bounded by the schema, not by the data), so it
travels in the task closure; U is solved record by record. V starts from the leading eigenvectors of the products of
present cells, summed in a first pass. One iteration is one pass over the staged cells without any shuffle of records:
each partition adds up its normal equations, and only columns x (rank^2 + rank) sums are gathered. Iterations go on until
the error settles. Missing cells are decoded to valid values (range, whole numbers, best level); every filled cell is
marked, and a cell counts as filled only if its decoded value is valid.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftloom.session import stage

RANK, RIDGE, ITERATIONS, TOLERANCE = 6, 2.0, 200, 1e-4
SHRINK = 20.0
MAX_LEVELS = 1000


@dataclass(frozen=True)
class Number:
    """A numeric cell column. ``usable``: whether the stored value counts (null and NaN never do)."""

    name: str
    value: Column
    usable: Column | None = None


@dataclass(frozen=True)
class Category:
    """A categorical cell column, one cell per level. ``levels`` None: taken from the data, at most MAX_LEVELS."""

    name: str
    value: Column
    levels: tuple | None = None
    usable: Column | None = None


@dataclass(frozen=True)
class Target:
    """A column to fill: where it applies, which values are valid, and where zero is not one of them."""

    name: str
    applies: Column
    low: float = float("-inf")
    high: float = float("inf")
    whole: bool = False
    positive: Column | None = None
    least_positive: float = 1.0


@dataclass
class Factors:
    """A fitted model: V, and how numbers were standardised."""

    v: np.ndarray
    columns: list[tuple[str, object]]
    rmse: list[float] = field(default_factory=list)


def _solve_rows(x: np.ndarray, v: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """U for rows x (NaN = absent cell), and the mask of present cells."""
    mask = (~np.isnan(x)).astype(float)
    filled = np.where(mask > 0, x, 0.0)
    k = v.shape[1]
    outer = (v[:, :, None] * v[:, None, :]).reshape(len(v), k * k)
    a = (mask @ outer).reshape(-1, k, k) + ridge * np.eye(k)
    return np.linalg.solve(a, (filled @ v)[:, :, None])[:, :, 0], mask


def _cells(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, 20_000):
            yield _cells(batch.column(0).slice(start, 20_000), width)


def _sums(*parts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.concatenate([p.ravel() for p in parts])], pa.list_(pa.float64()))], ["sums"])


def _product_sums(width: int):
    """The products of cells present together, and how many there are of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, counts = np.zeros((width, width)), np.zeros((width, width))
        for x in _blocks(batches, width):
            mask = (~np.isnan(x)).astype(float)
            filled = np.where(mask > 0, x, 0.0)
            products += filled.T @ filled
            counts += mask.T @ mask
        yield _sums(products, counts)

    return run


def _normal_sums(v: np.ndarray, ridge: float, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = v.shape[1]
        a, b, uu, stats = np.zeros((width, k * k)), np.zeros((width, k)), np.zeros((k, k)), np.zeros(3)
        for x in _blocks(batches, width):
            u, mask = _solve_rows(x, v, ridge)
            filled = np.where(mask > 0, x, 0.0)
            a += mask.T @ (u[:, :, None] * u[:, None, :]).reshape(len(u), k * k)
            b += filled.T @ u
            uu += u.T @ u
            stats += [len(u), float((((filled - u @ v.T) * mask) ** 2).sum()), float(mask.sum())]
        yield _sums(a, b, uu, stats)

    return run


def _gathered(cells: DataFrame, run, size: int) -> np.ndarray:
    parts = cells.mapInArrow(run, "sums array<double>")
    sums = parts.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    flat = np.zeros(size)
    flat[sums["i"].to_numpy()] = sums["x"].to_numpy()
    return flat


def fit(cells: DataFrame, width: int, rank: int = RANK, ridge: float = RIDGE, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, seed: int = 7) -> tuple[np.ndarray, list[float]]:
    """V for staged ``cells`` (one array column of ``width`` doubles, null = absent), and the RMSE after each pass.

    Passes end when the RMSE changes by less than ``tolerance`` of itself; a fit that has not settled after
    ``iterations`` passes gives a warning. No rows: V keeps its random start and fills decode to the group means.
    """
    v = np.random.default_rng(seed).normal(0, 0.3, (width, rank))
    rmse: list[float] = []
    flat = _gathered(cells, _product_sums(width), 2 * width * width)
    products, counts = flat[: width * width].reshape(width, width), flat[width * width :].reshape(width, width)
    if not counts.any():
        return v, rmse
    values, vectors = np.linalg.eigh(products / np.maximum(counts, 1.0))
    lead = np.argsort(values)[::-1][:rank]
    v[:, : len(lead)] = vectors[:, lead] * np.sqrt(np.maximum(values[lead], 0.0)) + 0.01 * v[:, : len(lead)]
    for _ in range(iterations):
        flat = _gathered(cells, _normal_sums(v, ridge, width), width * (rank * rank + rank) + rank * rank + 3)
        a, b, uu, (rows, *_) = np.split(flat, np.cumsum([width * rank * rank, width * rank, rank * rank]))
        v = np.linalg.solve(a.reshape(width, rank, rank) + ridge * np.eye(rank), b.reshape(width, rank, 1))[:, :, 0]
        # record factors keep unit size, which the ridge on them is meant for; without it the scale wanders from U to V
        v = v @ np.linalg.cholesky(uu.reshape(rank, rank) / rows + 1e-9 * np.eye(rank))
        rmse.append(float(np.sqrt(flat[-2] / flat[-1])))
        if len(rmse) > 1 and abs(rmse[-2] - rmse[-1]) <= tolerance * rmse[-2]:
            break
    else:
        warnings.warn(f"the error has not settled after {iterations} passes: {rmse[-2:]}", RuntimeWarning, stacklevel=2)
    return v, rmse


def _present(c: Number | Category) -> Column:
    number = c.value.cast("double")
    ok = c.value.isNotNull() if isinstance(c, Category) else c.value.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return ok if c.usable is None else ok & F.coalesce(c.usable, F.lit(False))


def _levels(wide: DataFrame, name: str) -> list:
    """The levels of a category in the data; no more than the bound and one are ever gathered."""
    found = sorted(r[0] for r in wide.select(f"__u_{name}").where(F.col(f"__u_{name}").isNotNull()).distinct().limit(MAX_LEVELS + 1).collect())
    if len(found) > MAX_LEVELS:
        raise ValueError(f"{name} has more than {MAX_LEVELS} levels; name at most {MAX_LEVELS} of them")
    return found


def fill(df: DataFrame, targets: list[Target], numbers: list[Number], categories: list[Category], group: list[Column], *, keep: list[str] | None = None, rank: int = RANK, ridge: float = RIDGE, iterations: int = ITERATIONS) -> DataFrame:
    """``df`` (or its columns ``keep`` and the targets) with every missing or unusable cell of the targets filled and marked in ``<name>_filled``.

    Each target is the name of one of ``numbers`` or ``categories``. Defined results:
    * null, NaN, an infinite value or one that is not usable counts as missing; where ``applies`` is false or null the cell stays.
    * a record without any usable cell gets its group's mean or the most likely level, an unknown group the overall mean.
    * a cell is marked only if its decoded value is a valid one; where none can be decoded (no level is known) it stays.
    * an input column called ``<name>_filled`` is replaced. Other columns, repeated rows and row counts stay as they are.
    * an empty table comes back empty with the added columns.
    """
    by = {c.name: c for c in [*numbers, *categories]}
    wanted = set(df.columns if keep is None else [*keep, *[t.name for t in targets]])
    kept = [c for c in df.columns if c in wanted and c not in {f"{t.name}_filled" for t in targets}]
    present = {c.name: _present(c) for c in [*numbers, *categories]}
    usable = {c.name: F.when(present[c.name], c.value.cast("double") if isinstance(c, Number) else c.value) for c in [*numbers, *categories]}
    groups = [g.cast("string") for g in group]
    wide = df.select(*[F.col(f"`{c}`") for c in kept], *[g.alias(f"__g{i}") for i, g in enumerate(groups)], *[u.alias(f"__u_{n}") for n, u in usable.items()], *[F.coalesce(t.applies, F.lit(False)).alias(f"__a_{t.name}") for t in targets], *[F.coalesce(t.positive, F.lit(False)).alias(f"__p_{t.name}") for t in targets if t.positive is not None])
    g = [f"__g{i}" for i in range(len(group))]

    # shrunken group and time means; one row per group, so the join side grows with groups only
    moments = [f(F.col(f"__u_{c.name}")).alias(f"__{s}_{c.name}") for c in numbers for s, f in (("n", F.count), ("m", F.avg), ("q", lambda x: F.avg(x * x)))]
    levels = {c.name: list(c.levels) if c.levels is not None else _levels(wide, c.name) for c in categories}
    stats = stage(wide.groupBy(*g).agg(*moments), "als-groups")
    part = lambda s, c: F.sum(F.col(f"__n_{c.name}") * F.col(f"__{s}_{c.name}")) / F.sum(f"__n_{c.name}")
    total = stats.agg(*[F.when(F.sum(f"__n_{c.name}") > 0, part(s, c)).alias(f"__{s}_{c.name}") for c in numbers for s in ("m", "q")]).first() if numbers else {}
    mean = {c.name: total[f"__m_{c.name}"] or 0.0 for c in numbers}
    scale = {c.name: max((total[f"__q_{c.name}"] or 0.0) - mean[c.name] ** 2, 0.0) ** 0.5 or 1.0 for c in numbers}
    stats = stats.select(*[F.col(x).alias(f"{x}_") for x in g], *[((F.col(f"__n_{c.name}") * F.coalesce(F.col(f"__m_{c.name}"), F.lit(0.0)) + SHRINK * mean[c.name]) / (F.col(f"__n_{c.name}") + SHRINK)).alias(f"__c_{c.name}") for c in numbers])
    same = F.lit(True)
    for x in g:
        same = same & F.col(x).eqNullSafe(F.col(f"{x}_"))
    wide = wide.join(stats, same, "left") if g else wide.crossJoin(stats.limit(1))

    columns: list[tuple[str, object]] = [(c.name, None) for c in numbers] + [(c.name, level) for c in categories for level in levels[c.name]]
    encoded = [((F.col(f"__u_{c.name}") - F.coalesce(F.col(f"__c_{c.name}"), F.lit(mean[c.name]))) / scale[c.name]) for c in numbers]
    for c in categories:
        share = 1.0 / max(1, len(levels[c.name]))
        encoded += [F.when(F.col(f"__u_{c.name}").isNotNull(), F.when(F.col(f"__u_{c.name}") == F.lit(level), F.lit(1.0)).otherwise(F.lit(0.0)) - F.lit(share)) for level in levels[c.name]]
    wide = wide.withColumn("__cells", F.array(*[x.cast("double") for x in encoded]))
    centers = [F.coalesce(F.col(f"__c_{t.name}"), F.lit(mean[t.name])).alias(f"__c_{t.name}") for t in targets if t.name in mean]
    signs = [F.col(f"__{s}_{t.name}") for t in targets for s in ("a", "p") if s == "a" or t.positive is not None]
    wide = stage(wide.select(*[F.col(f"`{c}`") for c in kept], "__cells", *[F.col(f"__u_{t.name}") for t in targets], *centers, *signs), "als")
    v, _ = fit(wide.select("__cells"), len(columns), rank, ridge, iterations)

    width = len(columns)

    @F.pandas_udf("array<double>")
    def reconstruct(cells: pd.Series) -> pd.Series:
        if cells.empty:
            return pd.Series([], dtype=object)
        x = np.array([np.asarray(c, dtype=float) for c in cells]).reshape(-1, width)
        u, _ = _solve_rows(x, v, ridge)
        return pd.Series(list(u @ v.T))

    wide = wide.withColumn("__fit", reconstruct(F.col("__cells")))
    index = {c: i for i, c in enumerate(columns)}
    out = {}
    for t in targets:
        c, missing = by[t.name], F.col(f"__a_{t.name}") & F.col(f"__u_{t.name}").isNull()
        if isinstance(c, Number):
            x = F.col("__fit")[index[t.name, None]] * scale[t.name] + F.col(f"__c_{t.name}")
            known = x.isNotNull() & ~F.isnan(x)
            x = F.floor(x + 0.5).cast("double") if t.whole else x
            least = F.lit(t.low) if t.positive is None else F.when(F.col(f"__p_{t.name}"), F.lit(max(t.low, t.least_positive))).otherwise(F.lit(t.low))
            x = F.when(known, F.least(F.greatest(x, least), F.lit(t.high)))
        else:
            share = 1.0 / max(1, len(levels[t.name]))
            scored = F.array(*[F.struct((F.col("__fit")[index[t.name, level]] + share).alias("s"), F.lit(-i).alias("o"), F.lit(level).alias("v")) for i, level in enumerate(levels[t.name])])
            top = F.array_max(scored)
            x = F.when(top["s"].isNotNull() & ~F.isnan(top["s"]), top["v"]) if levels[t.name] else F.lit(None)
        kind = df.schema[t.name].dataType
        done = missing & x.isNotNull()
        out[t.name] = F.when(done, x.cast(kind)).otherwise(F.col(f"`{t.name}`")).alias(t.name)
        out[f"{t.name}_filled"] = done.alias(f"{t.name}_filled")
    return wide.select(*[out.get(c, F.col(f"`{c}`")) for c in kept], *[out[f"{t.name}_filled"] for t in targets])
