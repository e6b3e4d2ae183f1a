"""Ranking candidates: replacement levels, line-ups, marginal value, boards, dominance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftloom.operators import ranks

c = F.col
FLEX = ("RB", "WR", "TE")


def replacement(pool: DataFrame, group: list[str], value: str, key: str, demand: Column) -> DataFrame:
    """Per group the value at place min(demand, size - 1) from the top, demand from 0: what can be had for nothing."""
    return ranks.order_statistics(pool, group, value, {"replacement": c("n") - 1 - F.least(F.greatest(demand, F.lit(0)), c("n") - 1)})


def over_replacement(pool: DataFrame, group: list[str], value: str, key: str, demand: Column) -> DataFrame:
    return pool.join(replacement(pool, group, value, key, demand), group).withColumn("over", c(value) - c("replacement"))


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: Column | int, most: int | None = None) -> DataFrame:
    """The first k rows of each group. ``most``: a number that ``k`` never exceeds, by which groups are cut before they move."""
    x = rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(c("place") <= (k if isinstance(k, int) else most))
    return x if isinstance(k, int) else x.where(c("place") <= k)


def line_up(players: DataFrame, team: list[str], position: str, value: str, key: str, slots: dict[str, int], flex: int) -> DataFrame:
    """The players of each team that fill its fixed slots, then the best rest of RB, WR, TE in its flex slots."""
    fixed = F.create_map(*[F.lit(x) for kv in slots.items() for x in kv])
    n = F.coalesce(F.try_element_at(fixed, c(position)), F.lit(0))
    x = players.withColumn("r_", F.row_number().over(Window.partitionBy(*team, position).orderBy(c(value).desc(), key))).withColumn("fixed_", c("r_") <= n)
    rest = F.row_number().over(Window.partitionBy(*team, (~c("fixed_") & c(position).isin(*FLEX))).orderBy(c(value).desc(), key))
    x = x.withColumn("f_", rest)
    return x.where(c("fixed_") | (c(position).isin(*FLEX) & (c("f_") <= flex))).withColumn("slot", F.when(c("fixed_"), c(position)).otherwise("FLEX")).drop("r_", "f_", "fixed_")


def access_by_prefix(rows: DataFrame, group: str, order: list[Column], value: Column, survival: Column) -> DataFrame:
    """The value that can be expected of the best candidate still there: each one counts if all better ones are gone."""
    w = Window.partitionBy(group).orderBy(*order)
    gone = F.coalesce(F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1 - survival))).over(w.rowsBetween(Window.unboundedPreceding, -1))), F.lit(1.0))
    return rows.withColumn("reach", gone * survival).withColumn("access", F.sum(gone * survival * value).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def dominance(rows: DataFrame, group: str, key: str, metrics: list[tuple[str, float]]) -> DataFrame:
    """Pairs (winner, loser) of a group: no metric worse than its tolerance, one better by more. ``group`` bounds the pairs."""
    a = rows.select(group, c(key).alias("winner"), *[c(m).alias(f"a_{m}") for m, _ in metrics])
    b = rows.select(group, c(key).alias("loser"), *[c(m).alias(f"b_{m}") for m, _ in metrics])
    no_worse, better = F.lit(True), F.lit(False)
    for m, tolerance in metrics:
        no_worse = no_worse & (c(f"a_{m}") >= c(f"b_{m}") - tolerance)
        better = better | (c(f"a_{m}") > c(f"b_{m}") + tolerance)
    return a.join(b, group).where((c("winner") != c("loser")) & no_worse & better).select(group, "winner", "loser")


def peel(group: pd.DataFrame, key: str, score: str, metrics: list[tuple[str, float]]) -> pd.DataFrame:
    """Order of one small group: again and again the best-scored candidate that no remaining one dominates."""
    left = group.to_dict("records")
    out = []

    def beats(a: dict, b: dict) -> bool:
        return all(a[m] >= b[m] - t for m, t in metrics) and any(a[m] > b[m] + t for m, t in metrics)

    while left:
        free = [x for x in left if not any(beats(y, x) for y in left if y is not x)] or left
        best = min(free, key=lambda x: (-x[score], x[key]))
        out.append(best | {"place": len(out) + 1})
        left.remove(best)
    return pd.DataFrame(out)


def merge_groups(group: pd.DataFrame, value: str, error: str, z: float) -> pd.DataFrame:
    """Tiers of one ordered group: neighbours whose difference is within ``z`` joint errors of the tier's leader share a tier."""
    rows = group.sort_values([value, "key"], ascending=[False, True]).to_dict("records")
    tier, lead = 0, None
    for r in rows:
        if lead is None or lead[value] - r[value] > z * (lead[error] ** 2 + r[error] ** 2) ** 0.5:
            tier, lead = tier + 1, r
        r["tier"] = tier
    return pd.DataFrame(rows)
