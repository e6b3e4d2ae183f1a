"""Quantile grids as arrays: monotone repair, tails, means, inverse distribution functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from draftloom.functions.scalars import let, normal_cdf_tail


def running_max(values: Column) -> Column:
    """Monotone repair that never lowers a value."""
    none = F.array().cast("array<double>")
    return F.aggregate(values, none, lambda acc, v: F.concat(acc, F.array(F.greatest(v, F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1), v)))))


def isotonic(values: Column) -> Column:
    """Least-squares monotone repair: value i is the largest, over starts j <= i, of the smallest mean of j..k, k >= i."""
    n = F.size(values)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    sums = F.aggregate(values, F.array(F.lit(0.0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    def repaired(total: Column) -> Column:
        mean = lambda j, k: (F.element_at(total, k + 1) - F.element_at(total, j)) / (k - j + 1)
        return F.transform(at, lambda i: F.array_max(F.transform(F.sequence(F.lit(1), i), lambda j: F.array_min(F.transform(F.sequence(i, n), lambda k: mean(j, k))))))

    return F.when(values.isNotNull(), let(sums, repaired))


def trapezoid_mean(ps: list[float], values: Column) -> Column:
    """The mean of a grid: trapezoids between anchors, constant mass beyond them."""
    v = [values[i] for i in range(len(ps))]
    area = v[0] * ps[0] + v[-1] * (1 - ps[-1])
    for i in range(1, len(ps)):
        area = area + (v[i] + v[i - 1]) / 2 * (ps[i] - ps[i - 1])
    return area


def quantile_at(ps: list[float], values: Column, p: Column) -> Column:
    """The value at probability ``p``, linear between anchors, flat beyond them."""
    v = [values[i] for i in range(len(ps))]
    out = F.when(p <= ps[0], v[0])
    for i in range(1, len(ps)):
        out = out.when(p <= ps[i], v[i - 1] + (v[i] - v[i - 1]) * (p - ps[i - 1]) / (ps[i] - ps[i - 1]))
    return out.otherwise(v[-1])


def _tail(width: float, next_width: float, rise: Column, reach: Column, growth: float) -> Column:
    cap = F.greatest(rise * growth, reach * 0.5, F.lit(2.220446049250313e-16))
    return F.least(F.greatest(F.lit(0.0), rise * (width / next_width)), cap)


def with_tails(ps: list[float], values: Column, low: float, high: float, growth: float) -> tuple[list[float], Column]:
    """The grid carried on to probability 0 and 1: in line with its ends, but no further than growth allows."""
    v = [values[i] for i in range(len(ps))]
    reach = v[-1] - v[0]
    out, grid = list(v), list(ps)
    if ps[0] > 0:
        out = [F.greatest(F.lit(low), v[0] - _tail(ps[0], ps[1] - ps[0], v[1] - v[0], reach, growth)), *out]
        grid = [0.0, *grid]
    if ps[-1] < 1:
        out = [*out, F.least(F.lit(high), v[-1] + _tail(1 - ps[-1], ps[-1] - ps[-2], v[-1] - v[-2], reach, growth))]
        grid = [*grid, 1.0]
    return grid, F.array(*out)


def recenter(values: Column, mean: Column, target: Column, low: float, high: float = float("inf")) -> Column:
    """Values moved to a new mean: scaled toward the lower bound when it falls, toward a finite upper bound when it rises,
    else shifted. Null where the target lies beyond the bounds."""
    down = F.transform(values, lambda v: F.coalesce(low + (v - low) * ((target - low) / F.nullif(mean - low, F.lit(0.0))), target))
    shift = F.transform(values, lambda v: v + (target - mean))
    up = F.transform(values, lambda v: F.coalesce(high - (high - v) * ((high - target) / F.nullif(high - mean, F.lit(0.0))), target)) if high < float("inf") else shift
    falls = target <= mean if low > float("-inf") else F.lit(False)
    return F.when((target < low) | (target > high), None).when(F.abs(mean - target) <= 1e-12, values).when(falls, down).when(target >= mean, up).otherwise(shift)


def clamped(values: Column, low: float, high: float) -> Column:
    return F.transform(values, lambda v: F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def normalized(ps: list[float], values: Column, target: Column, low: float = float("-inf"), high: float = float("inf"), growth: float = 3.0) -> tuple[list[float], Column]:
    """A usable grid from any: bounded, monotone, with tails, moved to the target mean (null: left where it is)."""
    grid, _ = with_tails(ps, values, low, high, growth)
    tailed = let(isotonic(clamped(values, low, high)), lambda v: with_tails(ps, v, low, high, growth)[1])

    def moved(v: Column) -> Column:
        return F.when(target.isNull(), v).otherwise(recenter(v, trapezoid_mean(grid, v), target, low, high))

    return grid, clamped(let(let(tailed, moved), isotonic), low, high)


def sampled(ps: list[float], values: Column, uniform: Column, normal: Column) -> Column:
    """The value for exactly one of a uniform and a normal draw; null for both or neither, or a uniform beyond 0 to 1."""
    one = uniform.isNull() != normal.isNull()
    p = F.coalesce(uniform, normal_cdf_tail(normal))
    return F.when(one & p.between(0.0, 1.0), quantile_at(ps, values, p))


def zero_inflated(ps: list[float], values: Column, mass: Column, p: Column) -> Column:
    """The quantile of a grid with a point mass at nought: nought up to the mass, the rest of the grid above it."""
    return F.when(p <= mass, 0.0).otherwise(quantile_at(ps, values, (p - mass) / F.nullif(1 - mass, F.lit(0.0))))


def summary_errors(floor: Column, mean: Column, ceiling: Column) -> Column:
    """What is wrong with a three-point summary, as an array of texts."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    named = (("floor", floor), ("mean", mean), ("ceiling", ceiling))
    wrong = [F.when(~number(x), f"{k} must be a finite number") for k, x in named]
    ordered = number(floor) & number(mean) & number(ceiling) & ((floor > mean) | (mean > ceiling))
    return F.array_compact(F.array(*wrong, F.when(ordered, "floor, mean and ceiling must be in order")))
