"""Resolving identities across feeds that carry partial keys: unique on both sides, or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def unique_keys(rows: DataFrame, key: str, identity: str) -> DataFrame:
    """(key, identity) of keys that belong to exactly one row of the full frame; null keys to none."""
    return rows.where(c(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(identity).alias(identity)).where("n = 1").drop("n")


def cascade(left: DataFrame, right: DataFrame, left_id: str, right_id: str, methods: list[tuple[str, str, str]]) -> DataFrame:
    """(left_id, right_id, method): the match of the first method, in order, whose key is unique on both sides.

    ``methods``: (name, left key, right key). Uniqueness is judged on the whole frames, not on what earlier methods left.
    """
    found = None
    for rank, (name, lk, rk) in enumerate(methods):
        a = unique_keys(left, lk, left_id).withColumnRenamed(lk, "key")
        b = unique_keys(right, rk, right_id).withColumnRenamed(rk, "key")
        m = a.join(b, "key").select(left_id, right_id, F.lit(name).alias("method"), F.lit(rank).alias("rank"))
        found = m if found is None else found.unionByName(m)
    best = found.groupBy(left_id).agg(F.min_by(F.struct(right_id, "method"), c("rank")).alias("b"))
    return best.select(left_id, "b.*")


def fail_closed(rows: DataFrame, key: str, witness: str) -> DataFrame:
    """Per key: how many rows claim it, and the witness if all agree on it; namesakes resolve to nothing."""
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("claims"), F.countDistinct(witness).alias("witnesses"), F.min(witness).alias("w"))
    return g.select(key, "claims", F.when(c("witnesses") == 1, c("w")).alias("resolved"))


def first_writer(aliases: DataFrame, alias: str, priority: list[str], value: str) -> DataFrame:
    """Alias lookup where the first to claim an alias keeps it."""
    return aliases.groupBy(alias).agg(F.min_by(value, F.struct(*priority)).alias(value))


def strongest(records: DataFrame, key: str, strength: list, value: list[str]) -> DataFrame:
    """The record of each key that is strongest, level by level."""
    return records.groupBy(key).agg(F.max_by(F.struct(*value), F.struct(*strength)).alias("b")).select(key, "b.*")


def greedy_union(rows: DataFrame, order: str, first_key: str, second_key: str) -> DataFrame:
    """Rows whose two keys are both new, in order. A row dropped for one key blocks no other key; a null key blocks nothing.

    Connected keys must be decided together, so each row waits for the earlier rows of its keys; rounds settle all rows
    whose rivals are settled, and end when none is left. A chain of rivals of length n takes n rounds.
    """
    from draftloom.session import stage

    # a null key is a key of its own
    own = lambda key: F.coalesce(F.concat(F.lit("k"), c(key).cast("string")), F.concat(F.lit("n"), c(order).cast("string")))
    open_rows = stage(rows.select("*", own(first_key).alias("key_1"), own(second_key).alias("key_2"), F.lit(0).alias("state")), "greedy")
    while True:
        def rivals(key: str) -> DataFrame:
            o = open_rows.groupBy(key).agg(F.min(F.when(c("state") == 0, c(order))).alias(f"open_{key}"), F.min(F.when(c("state") == 1, c(order))).alias(f"kept_{key}"))
            return o

        x = open_rows.join(rivals("key_1"), "key_1").join(rivals("key_2"), "key_2")
        kept = F.least("kept_key_1", "kept_key_2")
        turn = (c(order) == c("open_key_1")) & (c(order) == c("open_key_2"))
        state = F.when(c("state") != 0, c("state")).when(kept.isNotNull(), F.lit(2)).when(turn, F.lit(1)).otherwise(F.lit(0))
        open_rows = stage(x.select(*rows.columns, "key_1", "key_2", state.alias("state")), "greedy")
        if open_rows.where("state = 0").isEmpty():
            return open_rows.where("state = 1").select(*rows.columns)


def adjacent_pairs(rows: DataFrame, group: list[str], order: list, key: str, value: str, most: float) -> DataFrame:
    """Rows 1-2, 3-4, ... of each group in order, where their values lie at most ``most`` apart."""
    x = rows.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
    p = x.groupBy(*group, F.floor(c("n") / 2).alias("pair")).agg(F.min_by(F.struct(key, value), "n").alias("a"), F.max_by(F.struct(key, value), "n").alias("b"), F.count(F.lit(1)).alias("rows"))
    return p.where((c("rows") == 2) & (F.abs(c(f"a.{value}") - c(f"b.{value}")) <= most)).select(*group, c(f"a.{key}").alias("first"), c(f"b.{key}").alias("second"), c(f"a.{value}").alias("first_value"), c(f"b.{value}").alias("second_value"))
